"""Registered queries of feedback, evaluation, training data, graph, web and tree operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import answers
from lorebase.operators import dataset, evaluate, feedback, graph, tree, web
from lorebase.plans.queries import DOCS, HOPS, PASSAGES, TOP5, feedback_events, graph_edges, k_hop_seeds, kb_docs, kb_passages, query, read, vector_queries, vectors

# ---- tree ----------------------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, {PASSAGES}, p AS (SELECT *, coalesce(sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 40000 AS part_no FROM passages)
  SELECT docs.id, docs.title, coalesce(part_no, 0)::BIGINT AS part_no, count(p.id) AS n, string_agg(p.id::VARCHAR, ',' ORDER BY p.id) AS ids, md5(coalesce(string_agg(p.content, '|' ORDER BY p.id), '')) AS h FROM docs LEFT JOIN p ON p.doc_id = docs.id GROUP BY 1, 2, 3""")
def kb_structure(spark, d):
    out = tree.kb_structure(kb_docs(spark, d), kb_passages(spark, d).drop("enabled"), 40_000)
    held = F.coalesce("passages", F.array().cast("array<struct<id:bigint,content:string>>"))
    ids = F.array_join(F.transform(held, lambda x: x["id"].cast("string")), ",")
    return out.select("id", "title", "part_no", F.size(held).alias("n"), F.nullif(ids, F.lit("")).alias("ids"), F.md5(F.array_join(F.transform(held, lambda x: x["content"]), "|")).alias("h"))


@query(f"WITH {DOCS} SELECT 'level ' || level AS kind, count(*) AS n FROM docs GROUP BY 1 UNION ALL SELECT 'passages', count(*) FROM documents")
def structure_totals(spark, d):
    return tree.structure_totals(kb_docs(spark, d), kb_passages(spark, d))


OFF = f"WITH RECURSIVE {DOCS}, {PASSAGES}, t AS (SELECT id FROM docs WHERE level = 0 AND id < 2 UNION SELECT docs.id FROM t JOIN docs ON docs.parent_id = t.id)"


@query(f"{OFF} SELECT 'doc' AS kind, id, enabled AND id NOT IN (SELECT id FROM t) AS enabled FROM docs UNION ALL SELECT 'passage', id, enabled AND doc_id NOT IN (SELECT id FROM t) FROM passages")
def set_enabled(spark, d):
    docs = kb_docs(spark, d)
    a, b = tree.set_enabled(docs, kb_passages(spark, d), docs.where("level = 0 AND id < 2"), False)
    return a.select(F.lit("doc").alias("kind"), "id", "enabled").unionByName(b.select(F.lit("passage").alias("kind"), "id", "enabled"))


# ---- web and answers -----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id % 20 AS query_id, page_id AS ord, url, html AS snippet, q.embedding AS qvec, t.embedding AS tvec FROM pages LEFT JOIN embeddings q ON q.vec_id = page_id % 20 AND page_id % 2 = 1 LEFT JOIN embeddings t ON t.vec_id = page_id),
  s AS (SELECT *, len(list_filter(['example', '.org', 'lang="en"', 'utm_'], lambda w: contains(url || snippet, w))) AS hits FROM p),
  c AS (SELECT query_id, ord, round(CASE WHEN qvec IS NOT NULL THEN coalesce(list_cosine_similarity(qvec::DOUBLE[], tvec::DOUBLE[]), 0) WHEN hits > 0 THEN 0.5 + least(hits / 3.0, 0.4) ELSE 0 END, 6) AS sim FROM s)
  SELECT query_id, ord, sim::DOUBLE AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ord) AS rank FROM c WHERE sim >= 0.1""")
def filter_relevance(spark, d):
    e = read(spark, d, "embeddings")
    rows = read(spark, d, "pages").select((F.col("page_id") % 20).alias("query_id"), F.col("page_id").alias("ord"), F.col("url").alias("title"), F.col("html").alias("snippet"))
    rows = rows.join(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec")), (F.col("q") == F.col("query_id")) & (F.col("ord") % 2 == 1), "left").join(e.select(F.col("vec_id").alias("t"), F.col("embedding").alias("tvec")), F.col("t") == F.col("ord"), "left")
    return web.filter_relevance(rows.withColumn("terms", F.array(*map(F.lit, ("example", ".org", 'lang="en"', "utm_")))), 0.1).select("query_id", "ord", "sim", "rank")


BOOKS = """t AS (SELECT page_id % 10 AS query_id, page_id AS ord, ['内科学第9版教材', '诊疗指南', '科普问答', '概览', 'PDF规范'][page_id % 5 + 1] AS title, url || CASE WHEN page_id % 3 = 0 THEN '.pdf' ELSE '' END AS link FROM pages),
  s AS (SELECT query_id, ord, CASE page_id5 WHEN 0 THEN 'book' ELSE CASE WHEN pdf THEN 'pdf' ELSE 'article' END END AS type, CASE WHEN pdf THEN 3 ELSE 0 END + CASE page_id5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END - CASE page_id5 WHEN 2 THEN 2 ELSE 0 END AS score FROM (SELECT *, ord % 5 AS page_id5, link LIKE '%.pdf%' OR title LIKE '%PDF%' AS pdf FROM t)),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS n FROM s) WHERE n <= 10)"""


def _book_results(spark, d):
    title = F.element_at(F.array(*map(F.lit, ("内科学第9版教材", "诊疗指南", "科普问答", "概览", "PDF规范"))), (F.col("page_id") % 5 + 1).cast("int"))
    p = read(spark, d, "pages").select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("ord"), title.alias("title"), F.concat("url", F.when(F.col("page_id") % 3 == 0, ".pdf").otherwise("")).alias("link"))
    return web.rank_book_results(p)


@query(f"WITH {BOOKS} SELECT query_id, ord, type, score FROM k")
def rank_book_results(spark, d):
    return _book_results(spark, d).select("query_id", "ord", "type", "score")


@query(f"WITH {BOOKS} SELECT query_id, ord, type, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (type = 'article'), score DESC, ord) AS place FROM k) WHERE place <= 5")
def final_books(spark, d):
    return web.final_books(_book_results(spark, d)).select("query_id", "ord", "type", "score", "place")


@query("""SELECT conv_id, turn, len(bad) > 0 AND (len(bad) / 3 >= 0.5 OR len(bad) >= 2) AS retry FROM (SELECT *, list_filter([turn, conv_id % 9, 1], lambda n: n < 1 OR n > 5) AS bad FROM conversations)""")
def needs_retry(spark, d):
    mark = lambda c: F.concat(F.lit("[参考"), c.cast("string"), F.lit("]"))
    a = read(spark, d, "conversations").withColumn("answer", F.concat(mark(F.col("turn")), mark(F.col("conv_id") % 9), F.lit("x[参考1]")))
    return a.select("conv_id", "turn", answers.needs_retry(answers.validate_citations(F.col("answer"), F.lit(5))).alias("retry"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN '钠:' || l_quantity::INT || ';钾:' || l_linenumber || '.5' ELSE '' END AS found FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS ln FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_linenumber FROM lineitem))")
def parse_abnormal(spark, d):
    said = F.when(F.col("l_quantity") > 25, F.concat(F.lit("异常项目共2项：钠："), F.col("l_quantity").cast("int").cast("string"), F.lit("，钾"), F.col("l_linenumber").cast("string"), F.lit(".5，其余正常。"))).otherwise("未见异常。")
    pairs = answers.parse_abnormal(said)
    name = F.array_join(F.transform(pairs, lambda x: F.concat(x["name"], F.lit(":"), F.regexp_replace(x["value"].cast("string"), r"\.0$", ""))), ";")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("found"))


# ---- feedback ------------------------------------------------------------------------------------------------

FOLD = """SELECT question, reason, count(*) AS hit_count, max_by(a, ts) FILTER (WHERE a IS NOT NULL) AS answer, max_by(m, ts) FILTER (WHERE m IS NOT NULL) AS model, min(ts) AS created_at, max(ts) AS updated_at FROM e WHERE reason IS NOT NULL AND event_id % 2 = {0} GROUP BY 1, 2"""
BAD = """e AS (SELECT 'q' || (user_id % 40) AS question, CASE event_type WHEN 'error' THEN 'no_result' WHEN 'view' THEN 'weak_hit' WHEN 'click' THEN 'feedback_dislike' END AS reason, event_id, ts,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS m FROM events)"""


def _numbered(spark, d):
    return feedback_events(spark, d).withColumn("answer", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_id").cast("string")))


@query(f"""WITH {BAD}, s AS ({FOLD.format(0)}), n AS ({FOLD.format(1)})
  SELECT question, reason, coalesce(s.hit_count, 0) + coalesce(n.hit_count, 0) AS hit_count, coalesce(n.answer, s.answer) AS answer, coalesce(n.model, s.model) AS model, least(s.created_at, n.created_at) AS created_at, greatest(s.updated_at, n.updated_at) AS updated_at FROM s FULL JOIN n USING (question, reason)""")
def badcase_upsert(spark, d):
    e = _numbered(spark, d)
    state = feedback.badcase_events(e.where("event_id % 2 = 0"))
    return feedback.badcase_upsert(state, e.where("event_id % 2 = 1")).select("question", "reason", "hit_count", F.col("answer").cast("long").alias("answer"), "model", "created_at", "updated_at")


@query("""WITH e AS (SELECT *, 'q' || (user_id % 40) AS question FROM events), f AS (SELECT question, event_id % 2 AS part, count(*) AS hit_count, max_by(event_type, ts) AS domain, min(ts) AS created_at, max(ts) AS updated_at FROM e GROUP BY 1, 2),
  s AS (SELECT * FROM f WHERE part = 0), n AS (SELECT * FROM f WHERE part = 1)
  SELECT question, coalesce(s.hit_count, 0) + coalesce(n.hit_count, 0) AS hit_count, coalesce(n.domain, s.domain) AS domain, least(s.created_at, n.created_at) AS created_at, greatest(s.updated_at, n.updated_at) AS updated_at FROM s FULL JOIN n USING (question)""")
def request_log_upsert(spark, d):
    e = feedback_events(spark, d)
    return feedback.request_log_upsert(feedback.request_events(e.where("event_id % 2 = 0")), e.where("event_id % 2 = 1")).select("question", "hit_count", "domain", "created_at", "updated_at")


@query(f"""WITH {BAD}, f AS (SELECT question, reason, count(*) AS hit_count FROM e WHERE reason IS NOT NULL GROUP BY 1, 2) SELECT question, reason, hit_count, NULL::VARCHAR AS book, count(*) OVER (PARTITION BY reason) AS reason_total FROM f WHERE hit_count % 2 = 0""")
def export_badcases(spark, d):
    b = feedback.badcase_events(_numbered(spark, d)).withColumn("status", F.when(F.col("hit_count") % 2 == 0, "pending").otherwise("done"))
    return feedback.export_badcases(b, "pending").select("question", "reason", "hit_count", "book", "reason_total")


@query("SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def newest(spark, d):
    return feedback.newest(read(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"))


@query("SELECT 'q' || user_id AS question, 'feedback_dislike' AS reason, event_type AS note, ts FROM events WHERE event_id % 3 = 0")
def dislikes_to_badcases(spark, d):
    f = read(spark, d, "events").select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("rating"), F.lit("a").alias("answer"), F.array("event_type").alias("sources"), F.lit("m").alias("model"), F.col("event_type").alias("reason"), "ts")
    return feedback.dislikes_to_badcases(f).select("question", "reason", "note", "ts")


@query("""WITH f AS (SELECT 'q' || (user_id % 40) AS question, count(*) AS hit_count, min(ts) AS created_at FROM events GROUP BY 1) SELECT * FROM f WHERE hit_count % 3 <> 0 ORDER BY hit_count DESC, created_at DESC, question LIMIT 15""")
def request_queue(spark, d):
    r = feedback.request_events(feedback_events(spark, d)).withColumn("status", F.when(F.col("hit_count") % 3 != 0, "pending").otherwise("done"))
    return feedback.request_queue(r, k=15).select("question", "hit_count", "created_at")


@query("""WITH RECURSIVE e AS (SELECT event_type || (user_id % 50) AS key, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type || (user_id % 50) ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT key, event_id, n, t AS kept, false AS hit FROM e WHERE n = 1 UNION ALL SELECT e.key, e.event_id, e.n, CASE WHEN e.t - kept <= 3600 THEN kept ELSE e.t END, e.t - kept <= 3600 FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
  SELECT key, event_id, hit FROM r""")
def dedupe_questions(spark, d):
    return feedback.dedupe_questions(read(spark, d, "events").withColumn("key", F.concat("event_type", (F.col("user_id") % 50).cast("string"))))


@query("""SELECT event_type AS path, count(*) AS requests, count(*) FILTER (WHERE user_id % 10 = 0) AS errors, round(avg(value), 6) AS mean_ms, count(*) FILTER (WHERE value > 50) AS slow, true AS p50_near, true AS p99_near FROM events GROUP BY 1""")
def merged_latency(spark, d):
    """Sketches of five-minute windows merged by path, and whether their quantiles' ranks among all times are within the stated error."""
    log = read(spark, d, "events").select(F.col("event_type").alias("path"), F.col("value").alias("elapsed_ms"), F.when(F.col("user_id") % 10 == 0, 500).otherwise(200).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    merged = feedback.merged_latency(feedback.latency_sketches(log, slow_ms=50.0))
    both = log.join(merged.select("path", "p50_ms", "p99_ms"), "path").groupBy("path").agg(*(F.avg((F.col("elapsed_ms") <= F.col(f"p{p}_ms")).cast("int")).alias(f"r{p}") for p in (50, 99)), F.count("*").alias("n"))
    near = [(F.abs(F.col(f"r{p}") - p / 100) <= feedback.rank_error(400) + 1 / F.col("n")).alias(f"p{p}_near") for p in (50, 99)]
    return merged.join(both, "path").select("path", "requests", "errors", "mean_ms", "slow", *near)


@query(f"WITH {PASSAGES} SELECT id FROM passages WHERE enabled AND id % 3 <> 0")
def new_passages(spark, d):
    p = kb_passages(spark, d)
    return feedback.new_passages(p, p.where("id % 3 = 0")).select("id")


#: White space as Python strips it.
BLANKS = "' ' || " + " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


@query(f"""SELECT doc_id AS id, CASE WHEN length(t) < 4 THEN 'skipped' ELSE 'ok' END AS state, CASE WHEN length(t) >= 4 THEN length(t[1:500]) END AS n, CASE WHEN length(t) >= 4 THEN unicode(t[1]) END AS first, CASE WHEN length(t) >= 4 THEN unicode(t[1:500][-1]) END AS last FROM (SELECT doc_id, trim(coalesce(text, ''), {BLANKS}) AS t FROM documents)""")
def embed(spark, d):
    """Vectors of a stub: the length and the outer characters of what it was given."""
    out = feedback.embed(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), lambda batch: [[float(len(t)), float(ord(t[0])), float(ord(t[-1]))] for t in batch])
    return out.select("id", "state", *(F.get("vec", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("n", "first", "last"))))


# ---- evaluation ----------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_type <> 'error' AS ok, event_id, value, event_id % 3 AS n, event_id % 7 = 0 AS none, event_id % 4 AS books, event_id % 5 AS total, event_id % 2 AS invalid, length(props) AS len FROM events)
  SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, count(*) FILTER (WHERE ok AND none) AS no_result, round(count(*) FILTER (WHERE ok AND none) / count(*) FILTER (WHERE ok), 2) AS no_result_rate, count(*) FILTER (WHERE ok AND n > 0) AS with_sources,
  round(avg(n) FILTER (WHERE ok), 2) AS mean_sources, round(avg(books) FILTER (WHERE ok), 2) AS mean_books, round(avg(value) FILTER (WHERE ok), 2) AS mean_duration, round(avg(len) FILTER (WHERE ok), 2) AS mean_length, sum(total) FILTER (WHERE ok)::BIGINT AS citations, sum(invalid) FILTER (WHERE ok)::BIGINT AS invalid,
  round(avg(total / 5) FILTER (WHERE ok AND total > 0), 2) AS mean_coverage, 'v0,v1,v2' AS prompt_versions FROM r""")
def summarize_eval(spark, d):
    i = F.col("event_id")
    r = read(spark, d, "events").select(
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"), F.col("props").alias("answer"), F.slice(F.array(F.struct(F.lit("a").alias("bookTitle")), F.struct(F.lit("b").alias("bookTitle"))), F.lit(1), (i % 3).cast("int")).alias("sources"),
        (i % 7 == 0).alias("no_result"), (i % 4).alias("book_count"), F.concat(F.lit("v"), (i % 3).cast("string")).alias("prompt_version"), (i % 5).alias("citation_total"), (i % 2).alias("citation_invalid"), (i % 5 / 5).alias("coverage"),
    )
    return evaluate.summarize_eval(r)


def _hits(spark, d):
    name = lambda n: F.concat(F.lit("s"), (F.col("doc_id") % n).cast("string"))
    return evaluate.book_hits(read(spark, d, "documents").select(F.col("doc_id").alias("id"), name(4).alias("book_title"), F.array(F.struct(name(3).alias("bookTitle")), F.struct(name(5).alias("bookTitle"))).alias("sources")))


@query("SELECT count(*) FILTER (WHERE h) AS hits, count(*) AS total, round(avg(h::INT), 6) AS rate FROM (SELECT doc_id % 4 IN (doc_id % 3, doc_id % 5) AS h FROM documents)")
def book_hits(spark, d):
    return _hits(spark, d)[0]


@query("SELECT doc_id AS id, 's' || doc_id % 4 AS book_title, CASE WHEN doc_id % 3 = doc_id % 5 THEN 's' || doc_id % 3 ELSE 's' || doc_id % 3 || ',s' || doc_id % 5 END AS got FROM documents WHERE doc_id % 4 NOT IN (doc_id % 3, doc_id % 5)")
def book_misses(spark, d):
    return _hits(spark, d)[1].withColumn("got", F.array_join("got", ","))


def _scores(spark, d, part=None):
    e = read(spark, d, "events") if part is None else read(spark, d, "events").where(F.col("event_id") % 2 == part)
    return evaluate.judge_means(e.select(F.col("value").alias("accuracy"), (F.col("event_id") % 5).alias("completeness"), (F.col("user_id") % 7).alias("citation"), F.length("props").alias("format")))


MEANS = "SELECT round(avg(value), 2) AS accuracy, round(avg(event_id % 5), 2) AS completeness, round(avg(user_id % 7), 2) AS citation, round(avg(length(props)), 2) AS format, round((avg(value) + avg(event_id % 5) + avg(user_id % 7) + avg(length(props))) / 4, 2) AS overall FROM events"


@query(MEANS)
def judge_means(spark, d):
    return _scores(spark, d)


@query(f"WITH a AS ({MEANS} WHERE event_id % 2 = 0), b AS ({MEANS} WHERE event_id % 2 = 1) SELECT 'accuracy' AS metric, a.accuracy AS a, b.accuracy AS b, round(b.accuracy - a.accuracy, 6) AS difference FROM a, b UNION ALL SELECT 'overall', a.overall, b.overall, round(b.overall - a.overall, 6) FROM a, b")
def compare_runs(spark, d):
    return evaluate.compare_runs(_scores(spark, d, 0), _scores(spark, d, 1), ["accuracy", "overall"])


@query("SELECT 'm' || conv_id % 3 AS model, round(avg((turn % 2)::INT), 6) AS share FROM conversations GROUP BY 1")
def citation_presence(spark, d):
    return evaluate.citation_presence(read(spark, d, "conversations").select(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.concat("text", F.when(F.col("turn") % 2 == 1, "[参考 3]").otherwise("")).alias("answer")))


@query("""WITH c AS (SELECT item_id AS case_id, [text[1:6], 'zzz'] AS keywords FROM benchmark), r AS (SELECT 'e' || doc_id % 3 AS engine, doc_id % (SELECT count(*) FROM benchmark) AS case_id, text AS path FROM documents),
  h AS (SELECT engine, case_id, max((contains(path, keywords[1]) OR contains(path, keywords[2]))::INT) AS hit FROM r JOIN c USING (case_id) GROUP BY 1, 2)
  SELECT engine, coalesce(sum(hit), 0)::BIGINT AS passed, round(coalesce(sum(hit), 0) / (SELECT count(*) FROM c), 6) AS rate FROM (SELECT DISTINCT engine FROM r) LEFT JOIN h USING (engine) GROUP BY 1""")
def path_recall(spark, d):
    b = read(spark, d, "benchmark")
    r = read(spark, d, "documents").select(F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("engine"), (F.col("doc_id") % b.count()).alias("case_id"), F.col("text").alias("path"))
    return evaluate.path_recall(r, b.select(F.col("item_id").alias("case_id"), F.array(F.left("text", F.lit(6)), F.lit("zzz")).alias("keywords")))


@query(f"""WITH {TOP5}, g AS (SELECT DISTINCT vec_id AS case_id, 'b' || label % 3 AS expected_path FROM embeddings WHERE vec_id % 20 = 0 OR vec_id < 7), f AS (SELECT t.query_id AS case_id, 'b' || e.label AS path, t.similarity FROM top5 t JOIN embeddings e ON e.vec_id = t.id WHERE rank = 1),
  j AS (SELECT g.case_id, CASE WHEN path IS NULL THEN 'no result' ELSE concat_ws('; ', CASE WHEN NOT (contains(path, expected_path) OR contains(expected_path, path)) THEN 'other path' END, CASE WHEN similarity < 0.9 THEN 'low similarity' END) END AS reason FROM g LEFT JOIN f USING (case_id)) SELECT case_id, reason = '' AS passed, reason FROM j""")
def golden_regression(spark, d):
    from lorebase.operators.retrieval import vector_search

    v = vectors(spark, d)
    path = lambda c: F.concat(F.lit("b"), c.cast("string"))
    found = vector_search(vector_queries(spark, d), v, 5, 0.2).join(v.select("id", path(F.col("doc_id")).alias("path")), "id").withColumnRenamed("query_id", "case_id")
    golden = v.where("id % 20 = 0 OR id < 7").select(F.col("id").alias("case_id"), path(F.col("doc_id") % 3).alias("expected_path"), F.lit(0.9).alias("min_similarity"))
    return evaluate.golden_regression(found, golden)


@query("""WITH g AS (SELECT l_orderkey AS item_id, 'n' || l_partkey AS name, l_quantity::DOUBLE AS value FROM lineitem), p AS (SELECT l_orderkey AS item_id, 'n' || l_partkey || CASE WHEN l_suppkey % 3 = 0 THEN 'x' ELSE '' END AS name, l_quantity + (l_suppkey % 4) * 0.2 AS value FROM lineitem WHERE (l_partkey + l_suppkey) % 5 <> 0),
  ng AS (SELECT item_id, count(*) AS ng FROM g GROUP BY 1), np AS (SELECT item_id, count(*) AS np FROM p GROUP BY 1),
  t AS (SELECT p.item_id, count(DISTINCT (g.name, g.value)) AS tp FROM p JOIN g USING (item_id) WHERE (contains(p.name, g.name) OR contains(g.name, p.name)) AND abs(p.value - g.value) < 0.5 GROUP BY 1),
  a AS (SELECT item_id, coalesce(ng, 0) AS ng, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM ng FULL JOIN np USING (item_id) LEFT JOIN t USING (item_id))
  SELECT item_id, round(CASE WHEN tp + greatest(np - ng, 0) > 0 THEN tp / (tp + greatest(np - ng, 0)) ELSE 0 END, 6) AS precision, round(CASE WHEN ng > 0 THEN tp / ng ELSE 1 END, 6) AS recall, tp = ng AND np = ng AS exact FROM a""")
def extraction_prf(spark, d):
    li = read(spark, d, "lineitem")
    name = F.concat(F.lit("n"), F.col("l_partkey").cast("string"))
    gold = li.select(F.col("l_orderkey").alias("item_id"), name.alias("name"), F.col("l_quantity").cast("double").alias("value"))
    pred = li.where("(l_partkey + l_suppkey) % 5 <> 0").select(F.col("l_orderkey").alias("item_id"), F.concat(name, F.when(F.col("l_suppkey") % 3 == 0, "x").otherwise("")).alias("name"), (F.col("l_quantity") + (F.col("l_suppkey") % 4) * 0.2).alias("value"))
    return evaluate.extraction_prf(pred, gold)


# ---- training data -------------------------------------------------------------------------------------------

TITLES = "['胸部CT检查', '肺炎诊断标准', '高血压用药', '心律失常', '糖尿病分级', '超声解读', '头痛'][{0} % 7 + 1]"


def _title(c):
    return F.element_at(F.array(*map(F.lit, ("胸部CT检查", "肺炎诊断标准", "高血压用药", "心律失常", "糖尿病分级", "超声解读", "头痛"))), (F.col(c) % 7 + 1).cast("int"))


ASKED = """SELECT {0} AS id, title, 'diagnosis' AS category, title || '的临床意义是什么？' AS question, 0 AS pos FROM t WHERE k IN (0, 5) UNION ALL
  SELECT {0}, title, CASE WHEN k IN (1, 4) THEN 'diagnosis' ELSE 'treatment' END, title || '有哪些要点？', 0 FROM t WHERE k IN (1, 2, 4) UNION ALL
  SELECT {0}, title, 'diagnosis', title || '的诊断标准是什么？', 0 FROM t WHERE k IN (3, 6) UNION ALL SELECT {0}, title, 'treatment', title || '的治疗原则是什么？', 1 FROM t WHERE k IN (3, 6)"""


@query(f"WITH t AS (SELECT p_partkey, p_partkey % 7 AS k, {TITLES.format('p_partkey')} AS title FROM part), a AS ({ASKED.format('p_partkey')}) SELECT id, category, question FROM a")
def gen_questions(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), _title("p_partkey").alias("title"))
    return p.select("id", F.inline(dataset.gen_questions(F.col("title"))))


@query(f"""WITH t AS (SELECT p_partkey AS id, p_size % 10 AS book, p_partkey % 7 AS k, 1 + p_partkey % 2 AS level, {TITLES.format('p_partkey')} AS title FROM part WHERE p_partkey IN (SELECT doc_id % 500 FROM documents)),
  a AS ({ASKED.format('id')}), n AS (SELECT id, book, level, count(*) AS n FROM a JOIN (SELECT id, book, level FROM t) USING (id) GROUP BY ALL),
  b AS (SELECT *, sum(n) OVER (PARTITION BY book ORDER BY id ROWS UNBOUNDED PRECEDING) - n AS before FROM n), c AS (SELECT book, id, level, title, category, pos, CASE WHEN level = 1 THEN '《b' || book || '》' || question ELSE question END AS question FROM a JOIN b USING (id) WHERE before < 6)
  SELECT row_number() OVER (ORDER BY book, id, pos) AS id, book AS book_id, 'b' || book AS book_title, title AS chapter, category, question FROM c""")
def golden_questions(spark, d):
    leaves = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") % 10).alias("book_id"), F.concat(F.lit("b"), (F.col("p_size") % 10).cast("string")).alias("book_title"), (F.col("p_partkey") % 2 + 1).alias("level"), _title("p_partkey").alias("title"))
    p = read(spark, d, "documents").select((F.col("doc_id") % 500).alias("doc_id"), F.lit(True).alias("enabled"))
    return dataset.golden_questions(leaves, p)


@query("""WITH o AS (SELECT doc_id + 1 AS id, md5(text) AS q FROM documents WHERE doc_id % 3 = 0), n AS (SELECT md5(text) AS q, min(doc_id) AS ord FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
  SELECT id, q AS question FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY ord, q), q FROM n WHERE q NOT IN (SELECT q FROM o)""")
def append_new_questions(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("question"))
    return dataset.append_new_questions(docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1).alias("id"), "question"), docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("ord"), "question"))


@query("""SELECT p_partkey AS code, replace(t, '%s', p_name) AS question, '【' || p_name || '】' || chr(10) || p_type AS answer FROM part, (SELECT unnest(['%s要求什么？', '如何判定%s？']) AS t) WHERE p_partkey % 9 <> 0""")
def rule_qa(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).otherwise("").alias("body"))
    return dataset.rule_qa(p, ["%s要求什么？", "如何判定%s？"])


@query("""WITH i AS (SELECT 'A' || p_partkey AS code, p_name AS name, p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || '豁免：' || p_brand ELSE '' END AS answer FROM part WHERE p_partkey % 5 <> 0) SELECT code, code || ' ' || name || '的判定要点是什么？' AS question, answer FROM i UNION ALL SELECT code, name || '如何判定？', answer FROM i""")
def checklist_qa(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).otherwise("").alias("points"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("exempt"))
    return dataset.checklist_qa(p)


@query("""SELECT doc_id, 'answer from the sources' AS instruction, md5('c' || doc_id || chr(10) || chr(10) || '问题：' || q) AS h, md5(text) AS o FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN text[1:4] ELSE text END AS q FROM documents) WHERE length(q) >= 5 AND length(text) >= 20""")
def rag_samples(spark, d):
    docs = read(spark, d, "documents")
    contexts = docs.select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("context"))
    qa = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.left("text", F.lit(4))).otherwise(F.col("text")).alias("question"), F.col("text").alias("answer"))
    out = dataset.rag_samples(contexts.withColumn("key", F.col("doc_id")), qa, "answer from the sources")
    return out.select(F.regexp_extract("input", "^c([0-9]+)\n", 1).cast("long").alias("doc_id"), "instruction", F.md5("input").alias("h"), F.md5("output").alias("o"))


OUTPUTS = """o AS (SELECT p_partkey AS id, p_name AS n, p_type AS t, chr(10) AS l, p_partkey % 5 AS k FROM part), r AS (SELECT id, n, CASE k WHEN 0 THEN '1. ' || n || l || '2. ' || t WHEN 1 THEN '- ' || n || l || '- ' || t WHEN 2 THEN '包括：' || l || '- ' || n || l || '• ' || t WHEN 3 THEN n || l || '- ' || t ELSE n || '。' END AS before,
  CASE k WHEN 0 THEN '- ' || n || l || '- ' || t WHEN 1 THEN n || '；' || t || '。' WHEN 2 THEN '包括：' || n || '；' || t || '。' END AS rewritten FROM o)"""


def _outputs(spark, d):
    n, t, k, line = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 5, F.lit("\n")
    text = F.when(k == 0, F.concat(F.lit("1. "), n, line, F.lit("2. "), t)).when(k == 1, F.concat(F.lit("- "), n, line, F.lit("- "), t)).when(k == 2, F.concat(F.lit("包括："), line, F.lit("- "), n, line, F.lit("• "), t)).when(k == 3, F.concat(n, line, F.lit("- "), t)).otherwise(F.concat(n, F.lit("。")))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), n.alias("name"), text.alias("output"))


@query(f"WITH {OUTPUTS} SELECT id, rewritten FROM r")
def rewrite_output(spark, d):
    return _outputs(spark, d).select("id", dataset.rewrite_output(F.col("output")).alias("rewritten"))


@query(f"WITH {OUTPUTS}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS q, count(rewritten) AS o FROM r) SELECT n AS originals, q AS questions, o AS outputs, n + q + o AS samples, round((n + q + o) / n, 2) AS growth FROM s")
def augment(spark, d):
    s = _outputs(spark, d).withColumn("input", F.concat("name", F.when(F.col("id") % 2 == 0, "有哪些？").otherwise("很好")))
    return dataset.augment_counts(dataset.augment(s))


@query("SELECT doc_id, '说法：' || chr(10) || chr(10) || source || doc_id AS input, '判定：' || CASE WHEN doc_id % 2 = 0 THEN '正确' ELSE '不正确' END || chr(10) || '理由：' || lang AS output FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def judge_samples(spark, d):
    docs = read(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat("source", F.col("doc_id").cast("string")).alias("claim"), F.when(F.col("doc_id") % 2 == 0, "正确").otherwise("不正确").alias("verdict"), F.col("lang").alias("reason"), "source", "doc_id")
    out = dataset.judge_samples(docs)
    ids = docs.select("doc_id", F.concat(F.lit("说法：\n\n"), "claim").alias("input"))
    return out.join(ids, "input").select("doc_id", "input", "output")


@query("SELECT count(*) AS n, true AS complete, true AS disjoint, true AS near_share FROM documents")
def train_test_parts(spark, d):
    """The parts of D17: all rows, none twice, and about a tenth of them in the test part."""
    train, test = dataset.train_test_split(read(spark, d, "documents").select(F.col("doc_id").alias("id")))
    both = train.select("id", F.lit(0).alias("t")).unionByName(test.select("id", F.lit(1).alias("t"))).groupBy("id").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    all_rows = read(spark, d, "documents").agg(F.count("*").alias("n"))
    return all_rows.join(both.agg(F.count("*").alias("ids"), F.max("n").alias("most"), F.avg("t").alias("share"))).select("n", (F.col("ids") == F.col("n")).alias("complete"), (F.col("most") == 1).alias("disjoint"), F.col("share").between(0.03, 0.2).alias("near_share"))


@query("""WITH s AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN '' ELSE role END AS ins, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS past FROM conversations)
  SELECT conv_id, turn, CASE WHEN trim(ins) = '' THEN '你是一个专业的助手。' ELSE trim(ins) END AS system, 3 + CASE WHEN length(trim(past)) > 0 AND role IN ('user', 'assistant', 'system') THEN 1 ELSE 0 END AS n, md5(text) AS last FROM s""")
def to_messages(spark, d):
    from pyspark.sql import Window

    past = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    s = read(spark, d, "conversations").withColumn("history", F.array(F.struct("role", past.alias("content")))).withColumn("instruction", F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.col("role"))).withColumn("input", F.lit("q")).withColumn("output", F.col("text"))
    return dataset.to_messages(s).select("conv_id", "turn", F.get("messages", F.lit(0))["content"].alias("system"), F.size("messages").alias("n"), F.md5(F.element_at("messages", -1)["content"]).alias("last"))


@query("""WITH n AS (SELECT *, md5('7:' || doc_id) AS o FROM documents WHERE source NOT IN ('src1') ORDER BY o, doc_id LIMIT 1200) SELECT doc_id AS id, source AS book FROM n WHERE regexp_matches(text, 'a[^ ]e') ORDER BY o, doc_id LIMIT 200""")
def sample_passages(spark, d):
    p = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book"), F.col("text").alias("content"))
    return dataset.sample_passages(p, 1200, 200, "a[^ ]e", ("src1",)).select("id", "book")


@query(f"""WITH t AS (SELECT d.doc_id AS id, p_partkey AS doc_id, p_size % 10 AS book_id, {TITLES.format('p_partkey')} AS title, text AS content FROM documents d JOIN part ON p_partkey = d.doc_id % 500 WHERE length(text) >= 20),
  pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS nth FROM t) WHERE nth <= 2), pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || id), id) AS r FROM t) WHERE r = 1),
  ring AS (SELECT doc_id, book_id, content, row_number() OVER (PARTITION BY book_id ORDER BY md5('7:' || doc_id), doc_id) - 1 AS slot, count(*) OVER (PARTITION BY book_id) AS n FROM pool),
  near AS (SELECT a.doc_id, b.content AS near FROM ring a JOIN ring b ON b.book_id = a.book_id AND b.slot = (a.slot + 1) % a.n WHERE a.n > 1),
  books AS (SELECT book_id, content AS far, row_number() OVER (ORDER BY md5('7:' || book_id), book_id) - 1 AS b, count(*) OVER () AS total FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY md5('8:' || id), id) AS place FROM pool) WHERE place = 1),
  away AS (SELECT *, unnest([1, 2]) AS i FROM books), fars AS (SELECT a.book_id, string_agg(b.far, '|' ORDER BY i) AS fars, count(*) AS k FROM away a JOIN books b ON b.b = (a.b + i) % a.total WHERE b.book_id <> a.book_id GROUP BY 1)
  SELECT title AS query, md5(content) AS positive, md5(concat_ws('|', near, fars)) AS negatives, (near IS NOT NULL)::BIGINT + coalesce(k, 0) AS n FROM pos LEFT JOIN near USING (doc_id) LEFT JOIN fars USING (book_id)""")
def triplets(spark, d):
    chapters = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("book_id"), _title("p_partkey").alias("title"))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 500).alias("doc_id"), F.col("text").alias("content"))
    return dataset.triplets(chapters, p).select("query", F.md5("positive").alias("positive"), F.md5(F.array_join("negatives", "|")).alias("negatives"), F.size("negatives").cast("long").alias("n"))


# ---- graph ---------------------------------------------------------------------------------------------------


@query(f"""WITH {TOP5}, near AS (SELECT query_id, id, 'vector' AS source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM sims WHERE similarity >= 0.3 AND id % 4 <> 0 AND id % 10 / 10 >= 0.5) WHERE n <= 10),
  m AS (SELECT p_size AS code, p_partkey AS entity_id, p_partkey % 3 AS relevance FROM part WHERE p_partkey % 2 = 0), r AS (SELECT query_id, entity_id AS id, 'rule' AS source FROM (SELECT vec_id AS query_id, entity_id, row_number() OVER (PARTITION BY vec_id ORDER BY relevance DESC, entity_id) AS n FROM embeddings JOIN m ON m.code = vec_id % 50 WHERE vec_id % 20 = 0) WHERE n <= 20)
  SELECT query_id, id, min(source) AS source FROM (SELECT * FROM near UNION ALL SELECT * FROM r) GROUP BY 1, 2""")
def seed_entities(spark, d):
    q = vector_queries(spark, d).withColumn("note_qc_code", F.col("query_id") % 50)
    e = vectors(spark, d).withColumns({"enabled": F.col("id") % 4 != 0, "confidence": F.col("id") % 10 / 10, "entity_type": F.lit("x")})
    m = read(spark, d, "part").select(F.col("p_size").alias("note_qc_code"), F.col("p_partkey").cast("long").alias("entity_id"), (F.col("p_partkey") % 3).alias("relevance"), (F.col("p_partkey") % 2 == 0).alias("enabled"))
    return graph.seed_entities(q, e, m, 0.3)


COMMUNITIES = "c AS (SELECT o_orderkey AS id, o_orderkey % 3 AS level, [o_custkey, o_custkey + 1, o_orderkey % 100] AS members FROM orders WHERE o_orderkey % 5 <> 0)"


def _communities(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("level"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("summary"), F.array(F.col("o_custkey").cast("long"), F.col("o_custkey").cast("long") + 1, (F.col("o_orderkey") % 100).cast("long")).alias("entity_ids"), (F.col("o_orderkey") % 5 != 0).alias("enabled"))


@query(f"WITH {COMMUNITIES}, n AS (SELECT p_size AS query_id, p_partkey AS id FROM part), h AS (SELECT DISTINCT query_id, c.id, level FROM n JOIN c ON list_contains(members, n.id)) SELECT * FROM (SELECT *, 's' || id AS summary, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, id) AS rank FROM h) WHERE rank <= 5")
def community_summaries(spark, d):
    return graph.community_summaries(read(spark, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").cast("long").alias("id")), _communities(spark, d))


@query(f"""WITH {HOPS}, nodes AS (SELECT * FROM seeds UNION SELECT * FROM hop1 UNION SELECT * FROM hop2), {COMMUNITIES}, l AS (SELECT DISTINCT l_partkey AS id, l_orderkey % 500 AS passage_id FROM lineitem),
  s AS (SELECT query_id, passage_id AS id, round(sum(0.5), 6) AS score FROM nodes JOIN l USING (id) GROUP BY 1, 2), p AS (SELECT query_id, 'passage' AS kind, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r, 0 AS s FROM s),
  h AS (SELECT DISTINCT query_id, c.id, level FROM nodes n JOIN c ON list_contains(members, n.id)), m AS (SELECT query_id, 'community' AS kind, id, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, id) AS r, 1 AS s FROM h)
  SELECT query_id, kind, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, r) AS rank FROM (SELECT * FROM p WHERE r <= 3 UNION ALL SELECT * FROM m WHERE r <= 3)) WHERE rank <= 3""")
def graph_search(spark, d):
    links = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), (F.col("l_orderkey") % 500).alias("passage_id"))
    return graph.graph_search(k_hop_seeds(spark, d), graph_edges(spark, d), links, _communities(spark, d))


@query("SELECT DISTINCT p_partkey AS entity_id, doc_id AS passage_id FROM part JOIN documents ON doc_id % 50 = p_size")
def link_entities(spark, d):
    e = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("doc_id"))
    return graph.link_entities(e, read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("doc_id")))


@query("WITH n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1) SELECT DISTINCT a.id AS source_id, b.id AS target_id, p.p_type AS relation_type FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 JOIN n a ON a.name = p.p_name JOIN n b ON b.name = q.p_name")
def resolve_edges(spark, d):
    p = read(spark, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("target"))
    return graph.resolve_edges(p.join(after, "p_partkey").select(F.col("p_name").alias("source"), "target", F.col("p_type").alias("relation_type")), p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("SELECT DISTINCT o_orderpriority AS note_qc_code, p_partkey AS entity_id FROM orders JOIN part ON p_size = o_custkey % 60 WHERE NOT (o_orderpriority LIKE '1%' AND p_partkey % 2 = 0)")
def rule_entity_map(spark, d):
    rules = read(spark, d, "orders").select(F.col("o_orderpriority").alias("note_qc_code"), (F.col("o_custkey") % 60).alias("doc_id"))
    e = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("doc_id"))
    known = rules.where("note_qc_code LIKE '1%'").distinct().join(e.where("id % 2 = 0"), "doc_id").select("note_qc_code", F.col("id").alias("entity_id")).distinct()
    return graph.rule_entity_map(rules, e, known)


def _paths(spark, d):
    return read(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("key"), "page_id")


LAST = "regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^.*/', '')"


@query(f"WITH k AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS key, {LAST} AS last FROM pages), m AS (SELECT last, min(page_id) AS doc_id FROM k WHERE page_id % 3 = 0 GROUP BY 1) SELECT key, doc_id FROM k LEFT JOIN m USING (last)")
def match_doc_paths(spark, d):
    p = _paths(spark, d)
    return graph.match_doc_paths(p.select("key"), p.where("page_id % 3 = 0").select(F.col("key").alias("path"), F.col("page_id").alias("doc_id")))


@query("SELECT doc_id, 'k' || doc_id AS key, md5(CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END) AS h FROM documents WHERE doc_id % 4 = 0 AND doc_id % 7 <> 0")
def chunks_by_docs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("content"))
    out = graph.chunks_by_docs(docs.where("doc_id % 4 = 0").select("doc_id"), docs.where("doc_id % 7 <> 0").select("doc_id", "key"), docs.select("key", "content"))
    return out.select("doc_id", "key", F.md5("content").alias("h"))


@query("""WITH r AS (SELECT doc_id % 9 AS query_id, 'p' || doc_id % 13 AS path, doc_id AS rank FROM documents), f AS (SELECT *, (query_id < 6 AND (doc_in = query_id % 3)) AS inside FROM (SELECT *, rank % 13 % 3 AS doc_in FROM r)), a AS (SELECT *, bool_or(inside) OVER (PARTITION BY query_id) AS any_in FROM f)
  SELECT query_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, path) AS n FROM a WHERE inside = any_in) WHERE n <= 5""")
def filter_allowed_paths(spark, d):
    rows = read(spark, d, "documents").select((F.col("doc_id") % 9).alias("query_id"), F.concat(F.lit("p"), (F.col("doc_id") % 13).cast("string")).alias("path"), F.col("doc_id").alias("rank"))
    scope = rows.where("query_id < 6").where(F.col("rank") % 13 % 3 == F.col("query_id") % 3).select("query_id", "path").distinct()
    return graph.filter_allowed_paths(rows, scope, 5)


@query("WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS entity FROM lineitem) SELECT doc, count(*) AS entities FROM p GROUP BY 1")
def entities_of_docs(spark, d):
    return graph.doc_entities(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity")))[0]
