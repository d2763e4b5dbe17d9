"""The remaining operators on small literal frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import dataset, evaluate, graph, health, retrieval, structure, tree
from lorebase.sources import io

DOCS = [(1, "心脏病学", 0, None, "心血管"), (2, "心力衰竭", 1, 1, "心血管"), (3, "慢性心力衰竭治疗", 2, 2, "心血管"), (4, "呼吸病学", 0, None, "呼吸"), (5, "肺炎", 1, 4, "呼吸")]


def docs(spark):
    d = spark.createDataFrame([(*r, True) for r in DOCS], "id long, title string, level int, parent_id long, domain string, enabled boolean")
    return d.withColumn("node_path", F.concat(F.lit("/"), F.col("id").cast("string"))).withColumn("file_path", F.lit(None).cast("string"))


def passages(spark):
    rows = [(10, 3, "心脏病学", "慢性心力衰竭治疗包括利尿剂等药物", "慢性心力衰竭治疗", [1.0, 0.0], ["心力衰竭", "利尿剂"]), (11, 3, "心脏病学", "另一段关于随访的文字内容", "慢性心力衰竭治疗", [0.9, 0.1], ["随访"]), (12, 5, "呼吸病学", "肺炎的诊断标准与影像检查", "肺炎", [0.0, 1.0], ["肺炎", "诊断"])]
    return spark.createDataFrame([(*r, True) for r in rows], "id long, doc_id long, book string, content string, section_path string, vec array<double>, terms array<string>, enabled boolean")


def queries(spark):
    return spark.createDataFrame([(1, "慢性心力衰竭治疗有哪些", [1.0, 0.0], ["心力衰竭", "治疗"], "A.1"), (2, "肺炎的诊断", [0.0, 1.0], ["肺炎", "诊断"], "B")], "query_id int, text string, vec array<double>, terms array<string>, note_qc_code string")


def test_title_and_path_search(spark):
    kw = retrieval.cap_keywords(retrieval.extract_keywords(queries(spark)))
    got = retrieval.title_search(kw, docs(spark), passages(spark)).collect()
    assert {r.id for r in got if r.query_id == 1} == {10, 11} and {r.id for r in got if r.query_id == 2} == {12}
    assert {r.id for r in retrieval.section_path_search(kw, passages(spark)).collect() if r.query_id == 1} == {10, 11}
    ilike = retrieval.keyword_search_ilike(kw, passages(spark), 3).collect()
    assert next(r for r in ilike if r.query_id == 1 and r["rank"] == 1).id == 10


def test_hybrid_search(spark):
    got = retrieval.hybrid_search(queries(spark), passages(spark), docs(spark)).collect()
    assert {r.query_id: r.id for r in got if r["rank"] == 1} == {1: 10, 2: 12}


def test_coverage_chain_and_context(spark):
    kept = spark.createDataFrame([(1, 1, 10, "a")], "query_id int, rank int, id int, book string")
    cand = spark.createDataFrame([(1, 1, 10, "a"), (1, 9, 20, "b"), (1, 10, 21, "b"), (1, 11, 22, "a")], "query_id int, rank int, id int, book string")
    assert [r.id for r in retrieval.ensure_book_coverage(kept, cand, 3).orderBy("place").collect()] == [10, 20]
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    a = spark.createDataFrame([(1, 5, 1)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 6, 1), (2, 7, 1)], "query_id int, id int, rank int")
    assert {(r.query_id, r.id, r.stage) for r in retrieval.degrade_chain(q, [("route", a), ("keyword", b)]).collect()} == {(1, 5, "route"), (2, 7, "keyword")}
    c = spark.createDataFrame([(1, 2, "乙", "", "y"), (1, 1, "甲", "第一节", "x")], "query_id int, rank int, title string, section string, content string")
    assert retrieval.numbered_context(c, "|").first().context == "【参考1】《甲》 第一节\nx|【参考2】《乙》\ny"
    two = spark.createDataFrame([(1, 1, [1.0, 0.0], [0.0, 1.0])], "query_id int, id int, qvec array<double>, tvec array<double>")
    assert [(r.similarity, r.weak) for r in retrieval.second_stage_rerank(two).collect()] == [(0.0, True)]


def test_coarse_books_and_writeback(spark):
    kw = spark.createDataFrame([(1, "心力衰竭"), (1, "心力衰竭"), (1, "肺炎")], "query_id int, kw string")
    got = {r.book_id: r.score for r in retrieval.coarse_books(kw, docs(spark)).collect()}
    assert got == {1: 8.0, 4: 1.0}
    routes = spark.createDataFrame([("A", 3, ["利尿剂"]), ("A", 5, ["无"]), ("B", 3, ["随访"])], "code string, doc_id long, keywords array<string>")
    known = spark.createDataFrame([("B", 3)], "note_qc_code string, doc_id long")
    assert [tuple(r) for r in retrieval.route_writeback(routes, passages(spark), known).collect()] == [("A", 3, 2)]


def test_more_graph(spark):
    e = spark.createDataFrame([(1, "甲", "t", 0.9, True, 3, [1.0, 0.0]), (2, "乙", "u", 0.2, True, 5, [1.0, 0.0]), (3, "丙", "t", 0.9, True, 5, [0.0, 1.0])], "id long, name string, entity_type string, confidence double, enabled boolean, doc_id long, vec array<double>")
    rules = spark.createDataFrame([("A.1", 3, 2, True)], "note_qc_code string, entity_id long, relevance int, enabled boolean")
    assert {(r.query_id, r.id, r.source) for r in graph.seed_entities(queries(spark), e, rules).collect()} == {(1, 3, "rule"), (1, 1, "vector"), (2, 3, "vector")}
    raw = spark.createDataFrame([("甲", "乙", "supports"), ("甲", "乙", "supports"), ("甲", "无", "x")], "source string, target string, relation_type string")
    assert [tuple(r) for r in graph.resolve_edges(raw, e).collect()] == [(1, 2, "supports")]
    assert graph.link_entities(e, passages(spark)).count() == 4
    m = spark.createDataFrame([("Q", 5)], "note_qc_code string, doc_id long")
    assert {r.entity_id for r in graph.rule_entity_map(m, e).collect()} == {2, 3}
    edges = spark.createDataFrame([(1, 1, 2, "confirms")], "id long, source_id long, target_id long, relation_type string")
    com = spark.createDataFrame([(1, 2, "s", [2], True), (2, 1, "t", [9], True)], "id long, level int, summary string, entity_ids array<long>, enabled boolean")
    seeds = spark.createDataFrame([(1, 1)], "query_id int, id long")
    links = spark.createDataFrame([(2, 77)], "entity_id long, passage_id long")
    assert [(r.kind, r.id) for r in graph.graph_search(seeds, edges, links, com).orderBy("rank").collect()] == [("passage", 77), ("community", 1)]
    assert {tuple(r) for r in graph.match_doc_paths(spark.createDataFrame([("x/y/",), ("z",)], "key string"), spark.createDataFrame([("a/y", 4)], "path string, doc_id long")).collect()} == {("x/y/", 4), ("z", None)}
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, path string, rank int")
    scope = spark.createDataFrame([(1, "b"), (2, "x")], "query_id int, path string")
    assert {(r.query_id, r.path) for r in graph.filter_allowed_paths(rows, scope, 5).collect()} == {(1, "b"), (2, "c")}
    ch = graph.chunks_by_docs(spark.createDataFrame([(1,)], "doc_id int"), spark.createDataFrame([(1, "k")], "doc_id int, key string"), spark.createDataFrame([("k", "x" * 10)], "key string, content string"), 4)
    assert ch.first().content == "xxxx..."
    assert [(r.path, r.n) for r in graph.merged_documents(docs(spark), passages(spark)).orderBy("path").collect()] == [("/3", 2), ("/5", 1)]


def test_pages_to_lines(spark):
    items = spark.createDataFrame([(1, 1, 0, "Hello", 100.0, 10.0), (1, 1, 1, "world", 99.0, 12.0), (1, 1, 2, "心", 80.0, 9.0), (1, 1, 3, "衰", 80.0, 9.0), (1, 1, 4, " ", 60.0, 9.0)], "doc_id int, page_no int, ord int, str string, y double, size double")
    assert [(r.text, r.size_max) for r in structure.lines_from_items(items).orderBy("line").collect()] == [("Hello world", 12.0), ("心衰", 9.0)]
    pages = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, ""), (1, 3, "c")], "doc_id int, page_no int, text string")
    assert [(r.line_no, r.page_no, r.text) for r in structure.line_page_map(pages).orderBy("line_no").collect()] == [(0, 1, "a"), (1, 1, "b"), (2, 1, ""), (3, 3, "c")]
    sized = spark.createDataFrame([(1, i, 0, t, 10.0, s) for i, (t, s) in enumerate([("第一章 甲", 15.0), ("正文", 10.0), ("第二章 乙", 8.0), ("正文", 10.0), ("第三节 丙", 12.0)])], "doc_id int, line_no int, page_no int, text string, size_min double, size_max double")
    assert structure.base_font_size(sized).first().base == 10.0
    assert [r.level for r in structure.drop_running_headers(sized).orderBy("line_no").collect()] == [1, None, None, None, 2]
    toc = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["第一章 甲....1", "第二章 乙....5", "第三章 丙....9", "第四章 丁....12", "第五章 戊....20"])] + [(1, 2, 9, "这是正文的一句很长的话，包含句号。")], "doc_id int, page_no int, line_no int, text string")
    assert {r.page_no: r.is_toc for r in structure.toc_pages(toc).collect()} == {1: True, 2: False}


def test_outline_and_choice(spark):
    outline = spark.createDataFrame([(1, 0, "第一章", 0, [("一节", 1)]), (1, 1, "第二章", 3, [])], "doc_id int, ord int, title string, page_idx int, items array<struct<title:string,page_idx:int>>")
    pages = spark.createDataFrame([(1, i, f"{i}" * 60) for i in range(5)], "doc_id int, page_idx int, text string")
    got = structure.split_by_outline(outline, pages)
    assert [(r.title, r.level, r.parent_ord, len(r.content)) for r in got.orderBy("ord").collect()] == [("第一章", 1, None, 60), ("一节", 2, 1, 121), ("第二章", 1, None, 121)]
    none = got.limit(0)
    heads = spark.createDataFrame([(1, 1, "h", 1, "c"), (2, 1, "h", 1, "c"), (3, 1, "h", 1, "c")], "doc_id int, ord int, title string, level int, content string")
    shapes = spark.createDataFrame([(2, "nonbook"), (3, "book")], "doc_id int, shape string")
    whole = spark.createDataFrame([(i, "w") for i in (1, 2, 3)], "doc_id int, content string")
    out = structure.build_chapters(none, got, heads, shapes, whole).collect()
    assert {(r.doc_id, r.content) for r in out if r.doc_id > 1} == {(2, "w"), (3, "c")} and sum(r.doc_id == 1 for r in out) == 3


def test_titles_rules_and_reports(spark):
    df = spark.createDataFrame([(None, "/x/1234.pdf", "12\n目录\n第一章 甲\n内科学\n"), (None, "/x/内科学.pdf", ""), (" 题 ", "a", ""), (None, "/x/1.txt", "")], "given string, path string, text string")
    assert [r.t for r in df.select(structure.book_title(F.col("given"), F.col("path"), F.col("text")).alias("t")).collect()] == ["目录", "内科学", "题", "未命名书籍"]
    rules = spark.createDataFrame([("甲类", "2", "乙", {"k": "v", "e": ""}), ("甲类", "1", "甲", {"a": "b"})], "cls string, code string, name string, fields map<string,string>")
    assert structure.rules_to_markdown(rules).first().text == "# 甲类（2条）\n\n## 1 甲\n- a：b\n\n## 2 乙\n- k：v"
    p = spark.createDataFrame([(1, "t", 1, 0, "x"), (1, "t", 1, 3, "y")], "doc_id int, title string, page_no int, chunk_index int, passage string")
    assert [r.chunk_index for r in structure.passage_rows(p).orderBy("chunk_index").collect()] == [0, 1]
    new = spark.createDataFrame([(9, "心脏病学", 0, None, "d", True, "/9", None)], docs(spark).schema)
    d, q = structure.replace_same_title(docs(spark), passages(spark), new)
    assert {r.id for r in d.where("enabled").collect()} == {4, 5, 9} and {r.id for r in q.where("enabled").collect()} == {12}
    assert structure.doc_shape(spark.createDataFrame([(1, f"{i}. 条目") for i in range(70)], "doc_id int, text string")).first().shape == "nonbook"


def test_golden_questions_and_qa(spark):
    leaves = tree.leaf_chapters(docs(spark))
    got = dataset.golden_questions(leaves, passages(spark)).orderBy("id").collect()
    assert [(r.id, r.question) for r in got] == [(1, "慢性心力衰竭治疗有哪些要点？"), (2, "《呼吸病学》肺炎的诊断标准是什么？"), (3, "《呼吸病学》肺炎的治疗原则是什么？")]
    old = spark.createDataFrame([(4, "a")], "id int, question string")
    new = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "ord int, question string")
    assert {tuple(r) for r in dataset.append_new_questions(old, new).collect()} == {(4, "a"), (5, "b"), (6, "c")}
    assert dataset.rule_qa(spark.createDataFrame([("1", "甲", "b"), ("2", "乙", "")], "code string, name string, body string"), ["什么是%s？", "%s？"]).count() == 2
    assert dataset.checklist_qa(spark.createDataFrame([("A", "n", "p", "e")], "code string, name string, points string, exempt string")).first().answer == "p\n豁免：e"
    assert dataset.sample_passages(passages(spark), 3, 2, "心力|肺炎").count() == 2
    ctx = dataset.rag_contexts(docs(spark), passages(spark), cut=4)
    assert {r.doc_id: r.context for r in ctx.collect()} == {3: "【参考1】慢性心力\n【参考2】另一段关", 5: "【参考1】肺炎的诊"}
    qa = spark.createDataFrame([(3, "问题问题问", "答" * 20), (5, "短", "答" * 20)], "doc_id long, question string, answer string")
    assert dataset.rag_samples(ctx, qa, "i").count() == 1
    assert dataset.judge_samples(spark.createDataFrame([("c", "正确", "r")], "claim string, verdict string, reason string")).first().output == "判定：正确\n理由：r"


def test_more_evaluation(spark):
    r = spark.createDataFrame([(1, True, 2.0, "ab", [("甲",)], False, 1, "v1", 2, 1, 0.5, "甲"), (2, False, 1.0, None, [], True, 0, "v1", 0, 0, 0.0, "乙"), (3, True, 4.0, "abcd", [("丙",), ("丙",)], True, 1, "v2", 0, 0, 0.0, "乙")], "id int, ok boolean, duration double, answer string, sources array<struct<bookTitle:string>>, no_result boolean, book_count int, prompt_version string, citation_total int, citation_invalid int, coverage double, book_title string")
    s = evaluate.summarize_eval(r).first()
    assert (s.total, s.ok, s.fail, s.no_result, s.no_result_rate, s.with_sources, s.mean_duration, s.citations, s.mean_coverage, s.prompt_versions) == (3, 2, 1, 1, 0.5, 2, 3.0, 2, 0.5, "v1,v2")
    hits, misses = evaluate.book_hits(r)
    assert hits.first().hits == 1 and {m.id: m.got for m in misses.collect()} == {2: [], 3: ["丙"]}
    assert evaluate.judge_means(spark.createDataFrame([(4.0, 3.0, 5.0, 4.0)], "accuracy double, completeness double, citation double, format double")).first().overall == 4.0
    a, b = spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([(1.5, 1.0)], "x double, y double")
    assert {c.metric: c.difference for c in evaluate.compare_runs(a, b, ["x", "y"]).collect()} == {"x": 0.5, "y": -1.0}
    res = spark.createDataFrame([("e", 1, "a/b"), ("e", 2, "c")], "engine string, case_id int, path string")
    cases = spark.createDataFrame([(1, ["b"]), (2, ["z"])], "case_id int, keywords array<string>")
    assert evaluate.path_recall(res, cases).first().rate == 0.5
    gold = spark.createDataFrame([(1, "a/b/c", 0.5), (2, "x", 0.9), (3, "y", 0.1)], "case_id int, expected_path string, min_similarity double")
    top1 = spark.createDataFrame([(1, 1, "a/b", 0.6), (2, 1, "x", 0.5)], "case_id int, rank int, path string, similarity double")
    assert {g.case_id: (g.passed, g.reason) for g in evaluate.golden_regression(top1, gold).collect()} == {1: (True, ""), 2: (False, "low similarity"), 3: (False, "no result")}
    assert evaluate.citation_presence(spark.createDataFrame([("m", "[参考1]"), ("m", "x")], "model string, answer string")).first().share == 0.5
    assert health.kb_health(docs(spark), passages(spark), 1, 1).where("passed").count() == 6


def test_read_kb(spark, tmp_path):
    docs(spark).select("id", "title", "enabled").withColumn("enabled", F.col("id") > 1).write.parquet(str(tmp_path / "docs"))
    got = io.read_kb(spark, str(tmp_path), ["docs"])["docs"]
    assert got.count() == 4 and "node_path" in got.columns
    io.write_jsonl(got.select("id", "title"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
