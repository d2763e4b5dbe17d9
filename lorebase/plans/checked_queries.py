"""Queries of text functions and small operators over combined inputs, whose SQL computes each answer from the same fixed patterns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions import answers, text
from lorebase.operators import dataset, graph, structure
from lorebase.plans.queries import DOCS, HOPS, graph_edges, k_hop_seeds, kb_docs, query, read
from lorebase.plans.text_queries import title_sql
from lorebase.workers import stored


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


Part = tuple[str, Callable[[], Column]]


def picks(values: tuple[str, ...], place: int, key: str = "p_partkey") -> Part:
    """One of ``values`` by the digit ``place`` of a key written in as many digits: as SQL and as a column."""
    n = len(values)
    at = lambda: F.pmod(F.floor(F.col(key) / n**place), F.lit(n)).cast("int") + 1
    return f"[{', '.join(map(quoted, values))}][{key} // {n**place} % {n} + 1]", lambda: F.element_at(F.array(*map(F.lit, values)), at())


def matches(sql: str, pattern: str) -> str:
    return f"regexp_matches({sql}, {quoted(pattern)})"


def _said(spark, d, *parts: Part):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(*(c() for _, c in parts)).alias("t"))


def _texts(*parts: Part) -> str:
    return f"t AS (SELECT p_partkey AS id, {' || '.join(s for s, _ in parts)} AS t FROM part)"


NAME, TYPE = ("p_name", lambda: F.col("p_name")), ("p_type", lambda: F.col("p_type"))

# ---- questions and titles ------------------------------------------------------------------------------------

_ASKED = ("鉴别", "区分", "诊断", "标准", "分期", "治疗", "控制", "用药", "药", "剂量", "禁忌", "是什么", "")
_QUESTION = (picks(_ASKED, 0), NAME, picks(_ASKED, 1), picks(_ASKED, 2))


@query(f"WITH {_texts(*_QUESTION)} SELECT id, CASE {' '.join(f'WHEN {matches("t", p)} THEN {quoted(k)}' for k, p in text.QUESTION_KINDS)} ELSE 'general' END AS kind FROM t")
def classify_question(spark, d):
    """Three words of all kinds at once: precedence decides."""
    return _said(spark, d, *_QUESTION).select("id", text.classify_question(F.col("t")).alias("kind"))


_OPENS = ("第三章 ", "第12节", "A12.5 ", "B7", "3、", "12）", "二、", "（附）", "《", "“", "")
_TITLE = (picks(_OPENS, 0), picks(_OPENS, 1), TYPE, picks(("》", "”", " ", "(二)"), 2))


def _cleaned(t: str) -> str:
    out = f"trim({t})"
    for p in text.TITLE_STARTS:
        out = f"regexp_replace({out}, {quoted(p)}, '', 'g')"
    return f"trim({out})"


@query(f"WITH {_texts(*_TITLE)} SELECT id, {_cleaned('t')} AS title FROM t")
def clean_title(spark, d):
    """Two openings of all kinds one after the other: each is taken off once, in its turn."""
    return _said(spark, d, *_TITLE).select("id", text.clean_title(F.col("t")).alias("title"))


_NAMED = ("概述", "系统", "外科", "医学", "专类质控", "，。", "序", "肺炎", "长的题目名称", "x", "")
_TITLED = (picks(_NAMED, 0), picks(_NAMED, 1), picks(("", "、", "诊断", "学"), 2))


@query(f"""WITH {_texts(*_TITLED)} SELECT id, length(t) BETWEEN 2 AND 12 AND NOT ({' OR '.join(f'contains(t, {quoted(w)})' for w in text.SKIP_WORDS)}) AND NOT {matches('t', text.NO_TITLES[0])} AND NOT {matches('t', text.NO_TITLES[1])} AS meaningful FROM t""")
def meaningful_title(spark, d):
    return _said(spark, d, *_TITLED).select("id", text.meaningful_title(F.col("t")).alias("meaningful"))


_LACKS = ("关于【", "关于「", "关于“", "关于", "未涉及", "以下未涉及", "有")
_LACKED = (picks(("根据现有资料，以下内容可供参考，请结合临床情况综合判断使用。", "短。"), 0), picks(_LACKS, 0), picks(("热病", "12 3", " 药 ", "一段比较长但是还在三十个字以内的内容名称", ""), 0), picks(("】的内容有限。", "的内容有限", "」的内容有限；", "，其余从略", "。未涉及别的，"), 1))


@query(f"""WITH {_texts(*_LACKED)}, g AS (SELECT id, t, trim(coalesce(nullif(regexp_extract(t, {quoted(text.GAPS[0])}, 1), ''), nullif(regexp_extract(t, {quoted(text.GAPS[1])}, 1), ''))) AS gap FROM t)
  SELECT id, CASE WHEN length(t) >= 30 AND gap <> '' AND NOT regexp_matches(gap, '^[\\d\\s]+$') THEN gap END AS gap FROM g""")
def coverage_gap(spark, d):
    return _said(spark, d, *_LACKED).select("id", text.coverage_gap(F.col("t")).alias("gap"))


_VERDICTS = ("判定： 正确。", "判定:不正确", "说法：不正确", "说法 正确", "该说法成立", "依据不足", "不能认定", "过于绝对", "无")
_VERDICT = (("'x '", lambda: F.lit("x ")), picks(_VERDICTS, 0), picks(_VERDICTS, 1))


@query(f"""WITH {_texts(*_VERDICT)} SELECT id, coalesce(nullif(regexp_extract(t, {quoted(answers.VERDICTS[0])}, 1), ''), nullif(regexp_extract(t, {quoted(answers.VERDICTS[1])}, 1), ''), CASE WHEN {matches('t', answers.NEGATIVE)} THEN '不正确' WHEN {matches('t', answers.POSITIVE)} THEN '正确' END) AS verdict FROM t""")
def parse_verdict(spark, d):
    """Two phrases that agree or not: the named verdict, then the claim, then no before yes."""
    return _said(spark, d, *_VERDICT).select("id", answers.parse_verdict(F.col("t")).alias("verdict"))


def _asked_by(pattern: str) -> str:
    """A question that the pattern fits: its own words, with a name where it takes any."""
    out = re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", pattern.strip("^$")).replace("[?？]?", "？").replace("[应，,、]*", "应")
    return out.replace("(.+?)", "某药", 1).replace("(.+?)", "某病")


#: A question for each pattern, some that two patterns fit, and some that none fits.
_ASKS = (*(_asked_by(p) for p, _ in dataset.QUESTION_FORMS), "热病有哪些临床获益有哪些", "如何治疗是什么?", "为什么能否停药？", "很好", "", "治疗有哪些影响")
_ASK = (picks(("", "糖尿病", " 患者的"), 2), picks(_ASKS, 0))


def _rewritten(t: str) -> str:
    tries = []
    for p, r in dataset.QUESTION_FORMS:
        put = f"regexp_replace({t}, {quoted(p)}, {quoted(re.sub(r'[$]([12])', r'\\\1', r))})"
        tries.append(f"CASE WHEN {matches(t, p)} AND {put} <> {t} THEN {put} END")
    return f"coalesce({', '.join(tries)})"


@query(f"WITH {_texts(*_ASK)} SELECT id, t, {_rewritten('trim(t)')} AS rewritten FROM t")
def rewrite_question(spark, d):
    """All forty forms."""
    return _said(spark, d, *_ASK).select("id", "t", dataset.rewrite_question(F.col("t")).alias("rewritten"))


# ---- answers and reports -------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT conv_id, turn, role, [turn, conv_id % 9, (turn * 3 + conv_id) % 8, 2] AS refs FROM conversations), s AS (SELECT *, '[参考' || refs[1] || ']，[参考' || refs[2] || ']。' || role || '（[参考 ' || refs[3] || ']；）([参考' || refs[3] || '])[参考2]、' AS answer, list_filter(refs[1:3] || refs[3:4], lambda n: n < 1 OR n > 5) AS bad FROM a),
  w AS (SELECT *, list_reduce([answer] || list_transform(bad, lambda n: n::VARCHAR), lambda x, n: replace(replace(x, '[参考' || n || ']', ''), '[参考 ' || n || ']', '')) AS without FROM s)
  SELECT conv_id, turn, len(bad) AS invalid, round(len(bad) / 5, 6) AS invalid_ratio, round(len(list_distinct(list_filter(refs, lambda n: n BETWEEN 1 AND 5))) / 5, 6) AS coverage,
    CASE WHEN len(bad) > 0 THEN regexp_replace(regexp_replace(without, '(?:[，。；、]\\s*)+([，。；、])', '\\1', 'g'), '\\(\\s*\\)', '', 'g') ELSE answer END AS text, len(bad) > 0 AS fixed FROM w""")
def validate_citations(spark, d):
    """Five marks of each answer, one twice, with what is left of the text."""
    mark = lambda c: F.concat(F.lit("[参考"), c.cast("string"), F.lit("]"))
    third = (F.col("turn") * 3 + F.col("conv_id")) % 8
    said = F.concat(mark(F.col("turn")), F.lit("，"), mark(F.col("conv_id") % 9), F.lit("。"), "role", F.lit("（[参考 "), third.cast("string"), F.lit("]；）("), mark(third), F.lit(")[参考2]、"))
    out = read(spark, d, "conversations").withColumn("c", answers.validate_citations(said, F.lit(5)))
    return out.select("conv_id", "turn", F.size("c.invalid").alias("invalid"), F.round("c.invalid_ratio", 6).alias("invalid_ratio"), F.round("c.coverage", 6).alias("coverage"), "c.text", "c.fixed")


@query("""WITH r AS (SELECT l_orderkey AS report_id, l_returnflag AS item, l_quantity::DOUBLE AS value, CASE l_returnflag WHEN 'A' THEN 'g' WHEN 'N' THEN 'mg' END AS unit, CASE WHEN l_quantity > 40 THEN '偏高' WHEN l_quantity < 10 THEN '偏低' END AS flag FROM lineitem),
  s AS (SELECT *, item || value || coalesce(unit, '') || '（' || flag || '）' AS s FROM r)
  SELECT report_id, CASE WHEN count(flag) > 0 THEN '异常项目共' || count(flag) || '项：' || string_agg(s, '，' ORDER BY item, s) FILTER (WHERE flag IS NOT NULL) || '。' ELSE '未见异常。' END AS text, count(flag) AS abnormal, count(*) AS items FROM s GROUP BY 1""")
def lab_flags(spark, d):
    r = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_returnflag").alias("item"), F.col("l_quantity").cast("double").alias("value"))
    unit = F.when(F.col("item") == "A", "g").when(F.col("item") == "N", "mg")
    ranges = r.select("item").distinct().select("item", F.lit(10.0).alias("low"), F.lit(40.0).alias("high"), unit.alias("unit"))
    return dataset.lab_flags(r, ranges)


@query("""WITH c AS (SELECT source, doc_id, lang, text, 'ch ' || doc_id AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
  SELECT source AS doc_id, count(*) FILTER (WHERE lang = 'en') AS chapters, count(*) FILTER (WHERE lang <> 'en') AS sections, count(*) AS passages, sum(length(text))::BIGINT AS chars, string_agg(title, ',' ORDER BY doc_id) FILTER (WHERE n <= 30) AS preview FROM c GROUP BY 1""")
def ingest_report(spark, d):
    """With the preview of the first thirty titles."""
    p = read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.when(F.col("lang") == "en", 1).otherwise(2).alias("level"), F.col("text").alias("content"), F.col("doc_id").alias("ord"), F.concat(F.lit("ch "), F.col("doc_id").cast("string")).alias("title"))
    return structure.ingest_report(p, p.select("doc_id", "content")).withColumn("preview", F.array_join("preview", ","))


_GIVEN = picks(("", " ", " 内科学 ", "x"), 0)
_STEMS = ("7", "内科", "x", "abcdefghijkl12", "abcdefghijk", "指南.第三版", "12345678901234")
_STEM, _BODY = picks(_STEMS, 0), picks(("12\n\n第一章 总论\n题名\nx", "1", "", "\n\n www.x\n  A title of the text  \nmore", "（一）\n一、\nISBN 1\n2020年\n好书"), 1)


@query(f"""WITH t AS (SELECT p_partkey AS id, {_GIVEN[0]} AS given, {_STEM[0]} AS stem, {_BODY[0]} AS body FROM part)
  SELECT id, coalesce(nullif(trim(given), ''), CASE WHEN length(stem) >= 2 AND NOT regexp_matches(stem, '^\\d+$') AND NOT regexp_matches(stem, '^[A-Za-z0-9]{{12,}}$') THEN stem END, {title_sql('body')}, '未命名书籍') AS title FROM t""")
def book_title(spark, d):
    """Given titles, file names and texts of all kinds together."""
    path = F.concat(F.lit("/a.b/"), _STEM[1](), F.lit(".txt"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), structure.book_title(_GIVEN[1](), path, _BODY[1]()).alias("title"))


@query("""WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:1 + doc_id % 3]) AS content, unnest(range(1, len(string_split(text, chr(10))[1:1 + doc_id % 3]) + 1)) AS ord FROM documents),
  nodes AS (SELECT doc_id, ord, 'toc' AS title, 1 AS level, content FROM n WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, ord, 'outline', 2, content FROM n WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0
    UNION ALL SELECT doc_id, 1, '正文', 1, text FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 <> 0 AND doc_id % 6 <> 0 UNION ALL SELECT doc_id, ord, 'heading', 1, content FROM n WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 0 AND doc_id % 5 <> 0)
  SELECT doc_id, ord, title, level, md5(content) AS h FROM nodes""")
def build_chapters(spark, d):
    """Nodes of one to three lines from each way of splitting; which way's nodes a document gets, whole."""
    docs = read(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("ord", "content")).withColumn("ord", F.col("ord") + 1)
    node = lambda df, title, level: df.select("doc_id", "ord", F.lit(title).alias("title"), F.lit(level).alias("level"), "content")
    shapes = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "nonbook").otherwise("book").alias("shape"))
    out = structure.build_chapters(node(lines.where("doc_id % 4 = 0"), "toc", 1), node(lines.where("doc_id % 6 = 0"), "outline", 2), node(lines, "heading", 1), shapes, docs.select("doc_id", F.col("text").alias("content")))
    return out.select("doc_id", "ord", "title", "level", F.md5("content").alias("h"))


# ---- training data and graph ---------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, ch AS (SELECT d.id AS doc_id, d.parent_id AS book_id, b.title AS book_title, d.title AS chapter FROM docs d JOIN docs b ON b.id = d.parent_id WHERE d.level > 0),
  txt AS (SELECT p.doc_id AS id, ch.doc_id, book_id, text AS content FROM documents p JOIN ch ON ch.doc_id = CASE WHEN p.doc_id % 2 = 0 THEN 100 + p.doc_id % 25 ELSE 1000 + p.doc_id % 10 END WHERE length(text) >= 20),
  one AS (SELECT book_title, chapter, min(doc_id) AS doc_id, arg_min(book_id, doc_id) AS book_id FROM ch GROUP BY 1, 2), pos AS (SELECT doc_id, arg_min(content, id) AS content FROM txt GROUP BY 1),
  ask AS (SELECT item_id, chapter, book_title FROM benchmark JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS total FROM ch) x ON n = item_id * 7 % total UNION ALL SELECT item_id, 'no such chapter', 'b' FROM benchmark),
  firsts AS (SELECT book_id, content FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY md5('7:' || id), id) AS r FROM txt) WHERE r = 1),
  ring AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || book_id), book_id) - 1 AS b, count(*) OVER () AS total FROM firsts),
  far AS (SELECT a.book_id, string_agg(o.content, '|' ORDER BY i) AS negatives FROM (SELECT *, unnest([1, 2]) AS i FROM ring) a JOIN ring o ON o.b = (a.b + i) % a.total WHERE o.book_id <> a.book_id GROUP BY 1)
  SELECT 'q ' || item_id AS query, md5(pos.content) AS positive, md5(coalesce(negatives, '')) AS negatives FROM ask JOIN one USING (book_title, chapter) JOIN pos USING (doc_id) LEFT JOIN far USING (book_id)""")
def question_triplets(spark, d):
    """Golden questions about chapters and sections, and some about none."""
    docs = kb_docs(spark, d)
    up = docs.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    ch = docs.where("level > 0").join(up, F.col("parent_id") == F.col("book_id")).select("id", "book_id", "book_title", "title")
    listed = ch.orderBy("id").select(F.col("title").alias("chapter"), "book_title").collect()  # a row per chapter of the tree
    numbered = spark.createDataFrame([(n, *r) for n, r in enumerate(listed)], "n int, chapter string, book_title string")
    b = read(spark, d, "benchmark").select(F.concat(F.lit("q "), F.col("item_id").cast("string")).alias("question"), (F.col("item_id") * 7 % len(listed)).alias("n"))
    asked = b.join(numbered, "n").select("question", "book_title", "chapter").unionByName(b.select("question", F.lit("b").alias("book_title"), F.lit("no such chapter").alias("chapter")))
    home = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 25 + 100).otherwise(F.col("doc_id") % 10 + 1000)
    p = read(spark, d, "documents").select(F.col("doc_id").alias("id"), home.alias("doc_id"), F.col("text").alias("content"))
    return dataset.question_triplets(asked, ch, p).select("query", F.md5("positive").alias("positive"), F.md5(F.array_join("negatives", "|")).alias("negatives"))


_ENTITIES = """ents AS (SELECT p_partkey AS id, p_name AS name, p_type AS entity_type FROM part WHERE p_partkey % 50 <> 3 UNION ALL SELECT -s_suppkey - 1, s_name, 'supplier' FROM supplier)"""


def _entities(spark, d):
    p = read(spark, d, "part").where("p_partkey % 50 <> 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    return p.unionByName(read(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type")))


@query(f"WITH {HOPS}, {_ENTITIES}, n AS (SELECT query_id, id, 0 AS hop FROM seeds UNION ALL SELECT query_id, id, 1 FROM hop1 UNION ALL SELECT query_id, id, 2 FROM hop2) SELECT query_id, n.id, hop, name, entity_type FROM n LEFT JOIN ents USING (id)")
def k_hop_node_details(spark, d):
    nodes, edges = graph.k_hop(k_hop_seeds(spark, d), graph_edges(spark, d))
    return graph.with_details(nodes, edges, _entities(spark, d), graph_edges(spark, d))[0].select("query_id", "id", "hop", "name", "entity_type")


@query(f"WITH {HOPS}, {_ENTITIES}, e AS (SELECT query_id, edge, min(hop) AS hop FROM (SELECT query_id, edge, 1 AS hop FROM step1 UNION ALL SELECT query_id, edge, 2 FROM step2) GROUP BY 1, 2) SELECT query_id, edge, hop, x.source_id, a.name AS source, x.target_id, b.name AS target, x.relation_type, x.weight FROM e JOIN edges x ON x.id = edge LEFT JOIN ents a ON a.id = x.source_id LEFT JOIN ents b ON b.id = x.target_id")
def k_hop_edge_details(spark, d):
    e = stored(graph_edges(spark, d), "graph-edges")  # what the walk and the details read is grouped once
    nodes, edges = graph.k_hop(k_hop_seeds(spark, d), e)
    return graph.with_details(nodes, edges, _entities(spark, d), e, hops=2)[1].select("query_id", "edge", "hop", "source_id", "source", "target_id", "target", "relation_type", "weight")

