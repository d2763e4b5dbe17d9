"""Registered queries of keyword, title and path search, routing and reranking, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import retrieval
from lorebase.operators.common import top
from lorebase.plans.queries import DOCS, TOP5, WORDS, kb_docs, query, read, vector_queries, vectors, words

#: Keywords of a question: the first five distinct long words of a benchmark text, weighted by their length.
KW = f"""kw AS (SELECT query_id, kw, length(kw) % 3 + 1 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw) AS n FROM (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS kw FROM benchmark)) WHERE n <= 5)"""


def _keywords(spark, d):
    all_words = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words(F.col("text"))).alias("kw")).distinct()
    return top(all_words, ["query_id"], [F.col("kw")], 5).withColumn("weight", F.length("kw") % 3 + 1)


def _passages(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book"), F.col("text").alias("content"), (F.pmod("doc_id", F.lit(10)) + 1000).alias("doc_id"), F.concat(F.lit("part "), "text").alias("section_path"))


LIKE = f"""{KW}, s AS (SELECT query_id, doc_id AS id, source AS book, sum(weight) AS score FROM kw JOIN documents ON contains(lower(text), lower(kw)) GROUP BY 1, 2, 3 HAVING sum(weight) >= 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY score DESC, id) AS n FROM s),
  found AS (SELECT query_id, id, book, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE n <= 4) WHERE rank <= 10)"""


@query(f"WITH {LIKE} SELECT * FROM found")
def keyword_search_ilike(spark, d):
    return retrieval.keyword_search_ilike(_keywords(spark, d), _passages(spark, d), 10)


@query(f"""WITH {KW}, o AS (SELECT query_id, kw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw) AS n FROM kw) WHERE n <= 2), h AS (SELECT o.query_id, doc_id AS id, count(DISTINCT kw) AS score FROM o JOIN documents ON contains(lower(text), lower(kw)) GROUP BY 1, 2),
  st AS (SELECT h.* FROM h JOIN (SELECT query_id, count(*) AS n FROM o GROUP BY 1) USING (query_id) WHERE score = n), r AS (SELECT kw.query_id, doc_id AS id, count(DISTINCT kw) AS score FROM kw JOIN documents ON contains(lower(text), lower(kw)) WHERE kw.query_id NOT IN (SELECT query_id FROM st) GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT *, 'strict' AS mode FROM st UNION ALL SELECT *, 'relaxed' FROM r)) WHERE rank <= 3""")
def keyword_strict_relaxed(spark, d):
    k = _keywords(spark, d)
    return retrieval.keyword_strict_relaxed(top(k, ["query_id"], [F.col("kw")], 2), k, _passages(spark, d))


#: Keywords of titles: long ones, of which some match nothing, and short ones that only the broad step takes (six, one too many).
TITLE_KW = """kw AS (SELECT p_partkey AS query_id, unnest(CASE p_partkey % 40 WHEN 0 THEN ['NATION_' || p_size % 25, 'er#', 'ZZ'] WHEN 20 THEN ['#' || p_size % 10, 'N_' || p_size % 7, 'u', 'p'] WHEN 7 THEN ['nowhere', 'A_' || p_size % 3, 'N_' || p_size % 4, 'qa', 'qb', 'qc', '_24'] ELSE ['nothing', 'zz', 'ic'] END) AS kw, p_size % 3 + 1 AS weight FROM part WHERE p_partkey % 20 IN (0, 7))"""


@query(f"""WITH {DOCS}, {TITLE_KW}, t AS (SELECT DISTINCT query_id, docs.id AS doc_id, level FROM kw JOIN docs ON contains(lower(title), lower(kw)) WHERE length(kw) >= 4),
  f AS (SELECT query_id, doc_id, level FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, doc_id) AS n FROM t) WHERE n <= 8),
  few AS (SELECT query_id, kw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, length(kw) DESC, kw) AS n FROM kw WHERE length(kw) >= 2 AND query_id NOT IN (SELECT query_id FROM f)) WHERE n <= 5),
  b AS (SELECT query_id, doc_id, level FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level = 2 DESC, doc_id) AS n FROM (SELECT DISTINCT query_id, docs.id AS doc_id, level FROM few JOIN docs ON contains(lower(title), lower(kw)))) WHERE n <= 8),
  hit AS (SELECT * FROM f UNION ALL SELECT * FROM b), own2 AS (SELECT hit.query_id, p.doc_id AS id FROM hit JOIN documents p ON p.doc_id % 10 + 1000 = hit.doc_id),
  und AS (SELECT hit.query_id, p.doc_id AS id FROM hit JOIN docs c ON c.parent_id = hit.doc_id JOIN documents p ON p.doc_id % 10 + 1000 = c.id WHERE hit.level = 1 AND hit.query_id NOT IN (SELECT query_id FROM own2))
  SELECT query_id, id, id % 10 + 1000 AS doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM (SELECT * FROM own2 UNION SELECT * FROM und)) WHERE rank <= 5""")
def title_search(spark, d):
    n = lambda m: (F.col("p_size") % m).cast("string")
    said = lambda start, m: F.concat(F.lit(start), n(m))
    kind = F.col("p_partkey") % 40
    kws = F.when(kind == 0, F.array(said("NATION_", 25), F.lit("er#"), F.lit("ZZ"))).when(kind == 20, F.array(said("#", 10), said("N_", 7), F.lit("u"), F.lit("p")))
    kws = kws.when(kind == 7, F.array(F.lit("nowhere"), said("A_", 3), said("N_", 4), *map(F.lit, ("qa", "qb", "qc", "_24")))).otherwise(F.array(*map(F.lit, ("nothing", "zz", "ic"))))
    kw = read(spark, d, "part").where("p_partkey % 20 IN (0, 7)").select(F.col("p_partkey").alias("query_id"), F.explode(kws).alias("kw"), (F.col("p_size") % 3 + 1).alias("weight"))
    return retrieval.title_search(kw, kb_docs(spark, d), _passages(spark, d))


@query(f"""WITH {KW}, h AS (SELECT DISTINCT query_id, doc_id AS id FROM kw JOIN documents ON contains(lower('part ' || text), lower(kw))) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM h) WHERE rank <= 10""")
def section_path_search(spark, d):
    return retrieval.section_path_search(_keywords(spark, d), _passages(spark, d))


@query(f"""WITH {KW}, w AS (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark), e AS (SELECT CASE item_id % 3 WHEN 0 THEN ws[1] WHEN 1 THEN ws[1][1:4] ELSE ws[1] || ws[2] END AS canonical_name,
    [upper(ws[1]), ws[2], ws[3] || 'x'] AS synonyms FROM w WHERE item_id % 5 <> 4),
  n AS (SELECT *, unnest(list_prepend(canonical_name, synonyms)) AS name FROM e),
  h AS (SELECT query_id, kw, canonical_name, synonyms, row_number() OVER (PARTITION BY query_id, kw ORDER BY canonical_name, synonyms) AS r FROM (SELECT DISTINCT query_id, kw, canonical_name, synonyms FROM kw JOIN n ON contains(lower(kw), lower(name)) OR contains(lower(name), lower(kw))))
  SELECT query_id, kw, canonical_name, array_to_string(list_filter(synonyms, lambda x: lower(x) <> lower(kw)), '|') AS added FROM h WHERE r = 1""")
def expand_synonyms(spark, d):
    b = read(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("ws"))
    w = lambda i: F.get("ws", F.lit(i))
    name = F.when(F.col("item_id") % 3 == 0, w(0)).when(F.col("item_id") % 3 == 1, F.left(w(0), F.lit(4))).otherwise(F.concat(w(0), w(1)))
    s = b.select(name.alias("canonical_name"), F.array(F.upper(w(0)), w(1), F.concat(w(2), F.lit("x"))).alias("synonyms"), (F.col("item_id") % 5 != 4).alias("enabled"))
    return retrieval.expand_synonyms(_keywords(spark, d).select("query_id", "kw"), s).withColumn("added", F.array_join("added", "|"))


@query("""WITH i AS (SELECT 'I' || lpad((p_partkey % 40)::VARCHAR, 2, '0') AS code, p_type AS system, p_name AS words FROM part), q AS (SELECT p_partkey AS query_id, 'about ' || p_name || ' and I' || lpad((p_partkey % 50)::VARCHAR, 2, '0') AS t FROM part WHERE p_partkey % 20 = 0),
  w AS (SELECT code, system, unnest(list_distinct(list_prepend(code, list_filter(string_split(words, ' '), lambda x: length(x) >= 2)))) AS word FROM i), h AS (SELECT DISTINCT query_id, code, system FROM q JOIN w ON contains(lower(t), lower(word)))
  SELECT query_id, array_to_string(list_sort(list(DISTINCT system)), ',') AS systems, array_to_string(list_sort(list(DISTINCT code))[1:20], ',') AS codes FROM h GROUP BY 1""")
def lookup_icd(spark, d):
    p = read(spark, d, "part")
    icd = p.select(F.concat(F.lit("I"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0")).alias("icd_code"), F.col("p_type").alias("body_system"), F.col("p_name").alias("search_text"))
    q = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("about "), "p_name", F.lit(" and I"), F.lpad((F.col("p_partkey") % 50).cast("string"), 2, "0")).alias("text"))
    return retrieval.lookup_icd(q, icd).select("query_id", F.array_join("systems", ",").alias("systems"), F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {TOP5}, {LIKE}, q AS (SELECT item_id AS query_id FROM benchmark), v AS (SELECT query_id // 20 AS query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims WHERE similarity >= 0.5 AND id <> query_id) WHERE rank <= 5),
  one AS (SELECT *, 'vector' AS stage FROM v WHERE query_id IN (SELECT query_id FROM q)), two AS (SELECT query_id, id, rank, 'keyword' AS stage FROM found WHERE query_id NOT IN (SELECT query_id FROM one))
  SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT query_id, -1, 1, 'none' FROM q WHERE query_id NOT IN (SELECT query_id FROM one) AND query_id NOT IN (SELECT query_id FROM two)""")
def degrade_chain(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    near = retrieval.vector_search(vector_queries(spark, d), vectors(spark, d), 6, 0.5).where("id <> query_id")
    first = top(near.drop("rank"), ["query_id"], [F.col("similarity").desc(), F.col("id")], 5, "rank").select(F.expr("query_id div 20").alias("query_id"), "id", "rank")
    k, p = _keywords(spark, d), _passages(spark, d)
    return retrieval.degrade_chain(q, [("vector", first), ("keyword", lambda rest: retrieval.keyword_search_ilike(k.join(rest, "query_id", "left_semi"), p, 10)), ("none", lambda rest: rest.select("query_id", F.lit(-1).cast("long").alias("id"), F.lit(1).alias("rank")))])


@query(f"""WITH {DOCS}, k AS (SELECT p_partkey AS query_id, unnest(['NATION_' || p_size % 25, 'asia', 'Supplier#00000000' || p_size % 10, 'key' || p_size % 5]) AS kw FROM part WHERE p_partkey % 20 = 0), b AS (SELECT id, id AS book_id, title || ' dom' || ' key' || id AS t, 2 AS points FROM docs WHERE level = 0 UNION ALL SELECT c.id, c.parent_id, c.title || ' dom', 1 FROM docs c WHERE level = 1
    UNION ALL SELECT s.id, c.parent_id, s.title, 3 FROM docs s JOIN docs c ON c.id = s.parent_id WHERE s.level = 2), s AS (SELECT query_id, book_id, sum(points)::DOUBLE AS score FROM k JOIN b ON contains(lower(t), lower(kw)) GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS rank FROM s) WHERE rank <= 10""")
def coarse_books(spark, d):
    n = lambda m: (F.col("p_size") % m).cast("string")
    kws = F.array(F.concat(F.lit("NATION_"), n(25)), F.lit("asia"), F.concat(F.lit("Supplier#00000000"), n(10)), F.concat(F.lit("key"), n(5)))
    k = read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(kws).alias("kw"))
    docs = kb_docs(spark, d).withColumn("domain", F.lit("dom")).withColumn("keywords", F.array(F.concat(F.lit("key"), F.col("id").cast("string"))))
    return retrieval.coarse_books(k, docs)


@query(f"""WITH three AS (SELECT doc_id % 50 AS doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n FROM documents) WHERE n <= 3), r AS (SELECT DISTINCT 'c' || item_id % 7 AS code, item_id % 60 AS doc_id, text FROM benchmark),
  w AS (SELECT code, doc_id, unnest([split_part(text, ' ', 2), split_part(text, ' ', 3)]) AS kw FROM r), m AS (SELECT 'c' || item_id % 7 AS code, item_id % 60 AS doc_id FROM benchmark WHERE item_id % 4 = 0)
  SELECT DISTINCT w.code AS note_qc_code, w.doc_id, 2 AS relevance FROM w JOIN three USING (doc_id) WHERE contains(text, kw) AND (w.code, w.doc_id) NOT IN (SELECT (code, doc_id) FROM m)""")
def route_writeback(spark, d):
    b = read(spark, d, "benchmark")
    code = F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string"))
    routes = b.select(code.alias("code"), (F.col("item_id") % 60).alias("doc_id"), F.array(F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3))).alias("keywords"))
    known = b.where("item_id % 4 = 0").select(code.alias("note_qc_code"), (F.col("item_id") % 60).alias("doc_id"))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("doc_id"), F.col("text").alias("content"))
    return retrieval.route_writeback(routes, p, known)


JUDGED = TOP5 + """, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top5), j AS (SELECT *, CASE WHEN n <= 2 THEN 2 WHEN rank % 2 = 1 AND query_id % 3 <> 0 THEN (query_id + rank) % 3 ELSE 2 END AS level FROM n), kept AS (SELECT query_id, rank, id, level, sum((level = 2)::INT) OVER (PARTITION BY query_id)::BIGINT AS level2 FROM j)"""


def _reranked(spark, d):
    found = retrieval.vector_search(vector_queries(spark, d), vectors(spark, d), 5, 0.2)
    item = lambda r: F.concat(F.lit('{"id": '), F.lit(str(r)), F.lit(', "level": '), ((F.col("query_id") + r) % 3).cast("string"), F.lit("}"))
    said = F.concat(F.lit('so: {"judgments": ['), item(1), F.lit(", "), item(3), F.lit(", "), item(5), F.lit(', {"id": 99, "level": 0}]} done'))
    judged = vector_queries(spark, d).where("query_id % 3 <> 0").select("query_id", said.alias("json"))
    return found, retrieval.apply_rerank(found.withColumn("content", F.lit("")), judged)


@query(f"WITH {JUDGED} SELECT query_id, rank, id, level, level2 FROM kept WHERE level >= 1")
def apply_rerank(spark, d):
    return _reranked(spark, d)[1].select("query_id", "rank", "id", "level", "level2")


@query(f"""WITH {JUDGED}, k AS (SELECT query_id, rank, id, label AS book FROM kept JOIN embeddings ON vec_id = id WHERE level = 2 AND rank <= 3), c AS (SELECT query_id, rank, id, label AS book FROM top5 JOIN embeddings ON vec_id = id),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY rank, id) AS n FROM c WHERE rank > 3 AND (query_id, book) NOT IN (SELECT (query_id, book) FROM k)) WHERE n = 1)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY added, rank, id) AS place FROM (SELECT *, 0 AS added FROM k UNION ALL SELECT query_id, rank, id, book, 1 FROM l)) WHERE place <= 4""")
def ensure_book_coverage(spark, d):
    found, kept = _reranked(spark, d)
    books = vectors(spark, d).select("id", F.col("doc_id").alias("book"))
    return retrieval.ensure_book_coverage(kept.where("level = 2 AND rank <= 3").join(books, "id"), found.join(books, "id"), 4, 3)


@query(f"""WITH {TOP5}, s AS (SELECT t.query_id, t.id, round(list_cosine_similarity(q.embedding::DOUBLE[], list_reverse(p.embedding)::DOUBLE[]), 6) AS similarity FROM top5 t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings p ON p.vec_id = t.id)
  SELECT * FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) < 0.3 AS weak, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 3""")
def second_stage_rerank(spark, d):
    found = retrieval.vector_search(vector_queries(spark, d), vectors(spark, d), 5, 0.2).select("query_id", "id")
    pairs = found.join(vector_queries(spark, d).select("query_id", F.col("vec").alias("qvec")), "query_id").join(vectors(spark, d).select("id", F.reverse("vec").alias("tvec")), "id")
    return retrieval.second_stage_rerank(pairs)


@query(f"""WITH {TOP5} SELECT query_id, string_agg('【参考' || rank || '】《b' || id || '》' || CASE WHEN id % 2 = 0 THEN ' s' || id ELSE '' END || chr(10) || 'c' || id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top5 GROUP BY 1""")
def numbered_context(spark, d):
    n = F.col("id").cast("string")
    found = retrieval.vector_search(vector_queries(spark, d), vectors(spark, d), 5, 0.2)
    return retrieval.numbered_context(found.select("query_id", "rank", F.concat(F.lit("b"), n).alias("title"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), n)).otherwise("").alias("section"), F.concat(F.lit("c"), n).alias("content")))


@query(f"""WITH {DOCS}, {TOP5}, t AS (SELECT top5.*, label % 10 + CASE WHEN id % 3 = 0 THEN 100 ELSE 1000 END AS doc_id FROM top5 JOIN embeddings ON vec_id = id)
  SELECT query_id, t.id, similarity, rank, t.doc_id, d.title AS doc_title, coalesce(b.title, c.title, d.title) AS book_title FROM t LEFT JOIN docs d ON d.id = t.doc_id LEFT JOIN docs c ON c.id = d.parent_id LEFT JOIN docs b ON b.id = c.parent_id""")
def vector_search_titles(spark, d):
    """R2 with the titles of documents (chapters and sections) and books."""
    p = vectors(spark, d).select("id", (F.col("doc_id") % 10 + F.when(F.col("id") % 3 == 0, 100).otherwise(1000)).alias("doc_id"))
    return retrieval.with_titles(retrieval.vector_search(vector_queries(spark, d), vectors(spark, d), 5, 0.2), p, kb_docs(spark, d))
