"""Operators on small literal frames: worked examples, empty rows, nulls, ties and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import answers, text
from lorebase.operators import dataset, dialog, evaluate, feedback, graph, retrieval, segmenter, structure, tree, web
from lorebase.sources import io
from lorebase.streaming import feedback as streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_keywords(spark):
    assert one(spark, lambda x: text.window_keywords(x, (4,)), "患者术后发热") == ["患者术后", "者术后发", "术后发热"]
    got = {r.kw: r.weight for r in retrieval.extract_keywords(spark.createDataFrame([(1, "肺炎的诊断标准")], "query_id int, text string")).collect()}
    assert got["肺炎"] == 3 and got["诊断标准"] == 3 and got["肺炎的诊断标准"] == 3 and got["断标"] == 1 and got["肺炎的诊"] == 2
    assert one(spark, lambda x: text.expand_aliases(F.split(x, ",")), "心衰,发热") == ["心衰", "心力衰竭", "发热"]


def test_questions_and_titles(spark):
    assert one(spark, text.classify_domain, "COPD 患者") == "呼吸" and one(spark, text.classify_domain, "天气") is None
    assert [one(spark, text.classify_question, q) for q in ("如何区分甲乙", "诊断依据", "用药方案", "剂量", "你好")] == ["differential", "diagnosis", "treatment", "drug", "general"]
    assert one(spark, text.clean_title, "第三章 《肺炎》") == "肺炎" and one(spark, text.clean_title, "二、疾病特点") == "疾病特点" and one(spark, text.clean_title, None) == ""
    assert one(spark, text.normalize_question, " 什么是 COPD？") == "什么是copd"
    assert one(spark, text.coverage_gap, "根据现有资料可以回答一部分问题，但是知识库中关于【儿童用药】的内容有限。") == "儿童用药"


def test_synonyms_and_codes(spark):
    syn = spark.createDataFrame([("头孢曲松", ["罗氏芬", "ceftriaxone"], True)], "canonical_name string, synonyms array<string>, enabled boolean")
    kw = spark.createDataFrame([(1, "罗氏芬"), (1, "无关")], "query_id int, kw string")
    assert [(r.kw, r.added) for r in retrieval.expand_synonyms(kw, syn).collect()] == [("罗氏芬", ["ceftriaxone"])]
    icd = spark.createDataFrame([("I10", "循环", "高血压 原发性高血压", True), ("J18", "呼吸", "肺炎", True)], "icd_code string, body_system string, search_text string, enabled boolean")
    q = spark.createDataFrame([(1, "高血压怎么办"), (2, "i10"), (3, "其他")], "query_id int, text string")
    assert {r.query_id: (r.systems, r.codes) for r in retrieval.lookup_icd(q, icd).collect()} == {1: (["循环"], ["I10"]), 2: (["循环"], ["I10"])}


def test_citations_and_verdicts(spark):
    df = spark.createDataFrame([("甲[参考0]，。乙[参考9]。丙[参考1]", 2), ("无", 3), (None, 1)], "a string, n int")
    got = [r.c for r in df.select(answers.validate_citations(F.col("a"), F.col("n")).alias("c")).collect()]
    assert (got[0].valid, got[0].invalid, got[0].coverage, got[0].fixed) == ([1], [0, 9], 0.5, True) and "[参考1]" in got[0].text and "，。" not in got[0].text
    assert (got[1].refs, got[1].fixed) == ([], False) and got[2].refs == []
    assert [one(spark, answers.parse_verdict, t) for t in ("判定：不正确", "说法：正确", "过于绝对", "成立", "也许")] == ["不正确", "正确", "不正确", "正确", None]
    assert [(r.name, r.value) for r in one(spark, answers.parse_abnormal, "异常项目共2项：白细胞12.5（偏高），血糖3。其余正常")][-1] == ("血糖", 3.0)


def test_merge_and_route(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.65), (1, 2, 2, 0.45), (1, 3, None, 0.9), (1, 4, None, 0.3)], "query_id int, id int, doc_id int, similarity double")
    assert [r.id for r in retrieval.merge_per_book(rows, 3).orderBy("rank").collect()][:3] == [3, 1, 2]
    rule = spark.createDataFrame([("QC001", 1, [10, 11], 3, True), ("QC001", 2, [12], 2, True), ("A004", 5, [], 1, True), ("X", 9, [], 1, False)], "note_qc_code string, doc_id long, passage_ids array<long>, relevance int, enabled boolean")
    got = {r.code: (r.doc_ids, r.passage_ids) for r in retrieval.page_route(spark.createDataFrame([("QC001",), ("A004.001",), ("QC002",), ("X",)], "code string"), rule).collect()}
    assert got == {"QC001": ([1, 2], [10, 11, 12]), "A004.001": ([5], []), "QC002": (None, None), "X": (None, None)}


def test_vector_search_matches_scalar_cosine(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0], True), (2, [0.6, 0.8], True), (3, [0.0, 0.0], True), (4, None, True), (5, [1.0, 0.0], False), (6, [2.0, 0.0], True)], "id int, vec array<double>, enabled boolean")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, None)], "query_id int, vec array<double>")
    assert [(r.query_id, r.id, r.similarity) for r in retrieval.vector_search(q, p, 2, 0.5).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 6, 1.0)]
    retry = retrieval.vector_search_fallback(spark.createDataFrame([(9, [0.5, -0.9])], "query_id int, vec array<double>"), p, 1, 0.9, 0.4)
    assert [r.id for r in retry.orderBy("rank").collect()] == [1, 6]


def test_fusion_and_prefixes(spark):
    ch = spark.createDataFrame([(1, "vector", 1, 7), (1, "keyword", 2, 7), (1, "keyword", 1, 8), (1, "title", 1, 9)], "query_id int, channel string, rank int, id int")
    got = retrieval.rrf_fuse(ch, weights={"title": 0.0}).orderBy("rank").collect()
    assert [(r.id, r.source) for r in got] == [(7, "both"), (8, "keyword")]
    rows = spark.createDataFrame([(1, 1, 1, "abcdefghij one"), (1, 2, 2, "abcdefghij two"), (1, 3, 3, "short"), (1, 4, 4, "short"), (1, 5, 5, "abc other words")], "query_id int, rank int, id int, content string")
    kept = retrieval.prefix_dedup(rows).collect()
    assert sorted(r.id for r in kept) == [1, 3, 4, 5]


def test_strict_then_relaxed(spark):
    p = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma")], "id int, content string")
    kw = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "gamma"), (2, "delta")], "query_id int, kw string")
    got = retrieval.keyword_strict_relaxed(kw, kw, p).collect()
    assert {(r.query_id, r.id, r.mode) for r in got} == {(1, 1, "strict"), (2, 3, "relaxed")}


def test_rerank(spark):
    c = spark.createDataFrame([(1, i, i, f"text {i} alpha beta") for i in (1, 2, 3, 4)], "query_id int, rank int, id int, content string")
    j = spark.createDataFrame([(1, 'x {"judgments":[{"id":1,"level":0},{"id":2,"level":1},{"id":9,"level":0},{"id":3,"level":7}]} y')], "query_id int, json string")
    got = {r.id: (r.level, r.level2) for r in retrieval.apply_rerank(c, j).collect()}
    assert got == {2: (1, 2), 3: (2, 2), 4: (2, 2)}
    kw = spark.createDataFrame([(1, "alpha"), (1, "beta")], "query_id int, kw string")
    assert 1 in {r.id for r in retrieval.apply_rerank(c, j, kw).collect()}


DOCS = "id long, title string, level int, parent_id long, enabled boolean, domain string, node_path string"


def test_trees(spark):
    docs = spark.createDataFrame([(1, "book", 0, None, True, "d", "1"), (2, "chapter", 1, 1, True, "d", "1.1"), (3, "section", 2, 2, True, "d", "1.1.1"), (4, "off", 0, None, False, "d", "2"), (5, "x", 1, 6, True, "d", "3"), (6, "y", 1, 5, True, "d", "4")], DOCS)
    got = {(r.root, r.id) for r in tree.subtree(docs, docs.where("id in (1, 5)")).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (5, 5), (5, 6)}
    assert {r.doc_id for r in tree.resolve_scope(docs, docs.where("id in (1, 4)")).collect()} == {1, 2, 3}
    assert [r.id for r in tree.leaf_chapters(docs).collect()] == [3]
    p = spark.createDataFrame([(1, 3, "t", True), (2, 99, "t", True)], "id long, doc_id long, content string, enabled boolean")
    assert {r.id: r.book_title for r in tree.with_book(p, docs).collect()} == {1: "book", 2: None}
    off, gone = tree.set_enabled(docs, p, docs.where("id = 1"), False)
    assert off.where("enabled").count() == 2 and gone.where("enabled").count() == 1


def test_graph(spark):
    e = spark.createDataFrame([(i, 1, 10 + i, "supports_diagnosis") for i in range(40)] + [(50, 11, 99, "confirms_diagnosis")], "id long, source_id long, target_id long, relation_type string")
    s = spark.createDataFrame([(1, 1)], "query_id int, id long")
    nodes, edges = graph.k_hop(s, e, 2, 30)
    n = nodes.collect()
    assert sum(r.hop == 1 for r in n) == 30 and {r.id for r in n if r.hop == 2} == {99} and edges.count() == 41
    links = spark.createDataFrame([(99, 7), (11, 7), (1, 8), (11, 7)], "entity_id long, passage_id long")
    assert [(r.id, r.score) for r in graph.related_passages(nodes, e, links).orderBy("rank").collect()] == [(7, 2.0), (8, 0.7)]


def test_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "x" * 300), (1, 2, "user", "b"), (1, 3, "user", "a"), (1, 4, "user", "c")], "conv_id int, turn int, role string, text string")
    assert [r.query for r in dialog.followup_query(t).orderBy("turn").collect()] == ["a", "a b", "b a", "b a c"]
    assert [r.turn for r in dialog.compact_history(t, 204).orderBy("turn").collect()] == [1, 2, 3, 4]
    assert [(r.turn, len(r.history)) for r in dialog.multi_turn_samples(t).collect()] == [(0, 0)]


EVENTS = "question string, reason string, answer string, sources array<string>, model string, note string, ts timestamp"


def events(spark):
    return spark.sql("SELECT * FROM VALUES ('q', 'weak_hit', 'a1', array('s', 's', 't'), 'm', null, timestamp'2024-01-01 00:00:00'), (' q ', 'weak_hit', '', array('u'), null, 'n', timestamp'2024-01-01 00:01:00'), ('q', 'other', 'z', array('s'), 'm', null, timestamp'2024-01-01 00:02:00'), ('r', 'no_result', null, array('s'), null, null, timestamp'2024-01-01 00:03:00') AS t(question, reason, answer, sources, model, note, ts)")


def test_badcases_in_batch_and_stream_agree(spark, tmp_path):
    got = {(r.question, r.reason): r for r in feedback.badcase_events(events(spark)).collect()}
    assert set(got) == {("q", "weak_hit"), ("r", "no_result")}
    r = got["q", "weak_hit"]
    assert (r.hit_count, r.answer, r.sources, r.model, r.note) == (2, "a1", "u", "m", "n")
    src = str(tmp_path / "in")
    for i in range(3):
        events(spark).where(F.minute("ts") == i if i < 2 else F.minute("ts") >= 2).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    back = {(r.question, r.reason): (r.hit_count, r.answer, r.model, r.note) for r in streams.read_upserts(spark, str(tmp_path / "out")).collect()}
    assert back == {k: (v.hit_count, v.answer, v.model, v.note) for k, v in got.items()}


def test_streams_run(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.sql("SELECT id AS user_id, CAST(id % 2 AS STRING) AS key, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, '/p' AS path, 200 AS status, 1.0 * id AS elapsed_ms FROM range(20)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for name, df in (("fresh", streams.fresh_questions(stream)), ("latency", streams.latency_stream(stream)), ("sessions", streams.session_stream(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("fresh").count() == 2


def test_answer_cache(spark):
    e = spark.sql("SELECT id AS event_id, 'k' AS key, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 40) AS ts FROM range(4)")
    assert [r.hit for r in feedback.dedupe_questions(e).orderBy("event_id").collect()] == [False, True, False, True]


def test_embedding_job(spark):
    def fn(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, " good text "), (2, "abc"), (3, "bad text"), (4, None)], "id int, text string").coalesce(1)
    assert {r.id: (r.state, r.vec) for r in feedback.embed(df, fn, batch=1).collect()} == {1: ("ok", [9.0]), 2: ("skipped", None), 3: ("failed", None), 4: ("skipped", None)}


def test_web(spark):
    df = spark.createDataFrame([(1, i, "标题", u, "s") for i, u in enumerate(["http://a.org/1", "http://a.org/1", "http://a.org/2", "http://a.org/3", "not a url", "http://b.net/x", ""])], "query_id int, ord int, title string, link string, snippet string")
    assert [r.ord for r in web.dedupe_by_link(df).orderBy("ord").collect()] == [0, 2, 3, 4, 5]
    assert [r.ord for r in web.dedupe_by_host(web.dedupe_by_link(df)).orderBy("ord").collect()] == [0, 2, 4, 5]
    assert [r.ord for r in web.prioritize(web.flag_authoritative(df, ["b.net"])).orderBy("rank").collect()] == [5, 0, 1]
    b = spark.createDataFrame([(1, 0, "内科学 第九版", "http://x/1"), (1, 1, "指南解读", "http://x/a.pdf"), (1, 2, "科普问答", "http://x/2")], "query_id int, ord int, title string, link string")
    assert {r.ord: (r.type, r.score) for r in web.rank_book_results(b).collect()} == {0: ("book", 2), 1: ("pdf", 4), 2: ("article", -2)}


def test_structure(spark):
    levels = {"# A": 1, "## A": 2, "第一章 总论": 1, "第二节 甲": 2, "附录 1": 1, "一、甲": 1, "1. 甲": 1, "1.1 甲": 2, "普通的一行": None, "x" * 61: None}
    assert {k: one(spark, structure.heading_level, k) for k in levels} == levels
    body = "这一章的内容足够长，超过二十个字符，所以不会被并入前面的节点。"
    lines = ["第一章 甲", body, "1. 小节", body, "第二章 乙", "短", "第三章 丙", body]
    df = spark.createDataFrame([(1, i, 0, t, 10.0, 10.0) for i, t in enumerate(lines)], "doc_id int, line_no int, page_no int, text string, size_min double, size_max double")
    got = [(r.title, r.level, r.parent_ord) for r in structure.split_chapters(df).orderBy("ord").collect()]
    assert got == [("第一章 甲", 1, None), ("1. 小节", 2, 1), ("第三章 丙", 1, None)]
    plain = spark.createDataFrame([(1, 0, 0, "abc", 0.0, 0.0)], df.schema)
    assert [(r.title, r.content) for r in structure.split_chapters(plain).collect()] == [("正文", "abc")]


def test_passages(spark):
    s600, s40 = "甲" * 599 + "。", "乙" * 39 + "。"
    df = spark.createDataFrame([("丙" * 19 + "\n\n" + "丁" * 20 + "\n\n" + "戊" * 800 + "\n\n" + s600 + s40 + s600,)], "content string")
    assert [len(r.passage) for r in structure.split_passages(df).orderBy("chunk_index").collect()] == [20, 800, 600, 640]
    c = spark.createDataFrame([("a" * 20 + "\n\n" + "b" * 21 + "\n\n" + "c" * 950,)], "text string")
    assert [len(r.chunk) for r in structure.chunk_sliding(c).orderBy("chunk_index").collect()] == [21, 500, 500, 50]


def test_toc(spark):
    lines = ["目录页", "第一章 绪论 ........ 1", "第二章 方法", "...... 12", "第三章 结果 30", "index word 5", "1 2"]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(lines)], "doc_id int, page_no int, line_no int, text string")
    assert [(r.title, r.target) for r in structure.toc_entries(df).orderBy("line_no").collect()] == [("第一章 绪论", 1), ("第二章 方法", 12), ("第三章 结果", 30)]
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate(["第一章 甲", "第一节 乙", "一、丙", "二、丁", "附录 一", "（一）戊", "一、己"])], "doc_id int, ord int, title string")
    assert [r.level for r in structure.infer_toc_levels(e).orderBy("ord").collect()] == [1, 2, 2, 2, 1, 2, 1]
    text_lines = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(["前言", "第一章 绪论", "x" * 30, "第二章 方法", "y" * 30, "第三章 结果", "z" * 30])], "doc_id int, line_no int, page_no int, text string")
    toc = spark.createDataFrame([(1, 0, "第一章 绪论", 1, 1), (1, 1, "第二章 方法", 1, 3), (1, 2, "第三章 结果", 1, 5)], "doc_id int, ord int, title string, level int, target int")
    assert [(r.title, len(r.content)) for r in structure.split_by_toc(toc, text_lines).orderBy("ord").collect()] == [("第一章 绪论", 30), ("第二章 方法", 30), ("第三章 结果", 30)]


def test_segmenter(spark):
    df = spark.createDataFrame([("急性心力衰竭的治疗",)], "text string")
    assert segmenter.segment(df, {"急性": 5, "心力衰竭": 9, "心力": 3, "衰竭": 3, "的": 50, "治疗": 8}, ("治疗",)).first().terms == ["急性", "心力衰竭"]
    assert segmenter.segment(df).first().terms[:2] == ["急性", "性心"]


def test_rewrites(spark):
    cases = {"高血压的诊断标准是什么？": "高血压的诊断标准包括哪些？", "如何治疗": "应该怎样治疗？", "患者应如何处理？": "患者应该怎样处理？", "为什么发热": "发热的原因是什么？", "陈述": None}
    assert {k: one(spark, dataset.rewrite_question, k) for k in cases} == cases
    outs = {"1. 甲\n2. 乙": "- 甲\n- 乙", "- 甲\n- 乙": "甲；乙。", "包括：\n- 甲\n• 乙": "包括：甲；乙。", "引言\n第二行\n- 甲": None, "无列表": None, "引言\n1. 甲": "引言\n- 甲"}
    assert {k: one(spark, dataset.rewrite_output, k) for k in outs} == outs
    s = spark.createDataFrame([("i", "如何治疗", "- 甲\n- 乙")], "instruction string, input string, output string")
    r = dataset.augment_counts(dataset.augment(s)).first()
    assert (r.originals, r.questions, r.outputs, r.growth) == (1, 1, 1, 3.0)


def test_training_data(spark):
    assert [len(one(spark, dataset.gen_questions, t)) for t in ("CT检查", "诊断标准", "肺炎")] == [1, 1, 2]
    df = spark.range(500).withColumnRenamed("id", "id")
    train, test = dataset.train_test_split(df)
    assert train.count() + test.count() == 500 and train.join(test, "id").count() == 0 and 20 < test.count() < 90
    t = spark.createDataFrame([("说法：\n\n甲",), ("说法：\n\n乙",)], "input string")
    assert dataset.eval_overlap(t, spark.createDataFrame([("甲",)], "claim string")).count() == 1
    m = dataset.to_messages(spark.createDataFrame([("", "u", "a", [("user", "x"), ("bad", "y"), ("assistant", " ")])], "instruction string, input string, output string, history array<struct<role:string,content:string>>")).first().messages
    assert [x.role for x in m] == ["system", "user", "user", "assistant"] and m[0].content == dataset.DEFAULT_SYSTEM
    chapters = spark.createDataFrame([(i, i % 3, f"标题{i}") for i in range(9)], "id int, book_id int, title string")
    p = spark.createDataFrame([(i, i % 9, f"passage {i} " + "x" * 20) for i in range(27)], "id int, doc_id int, content string")
    for r in dataset.triplets(chapters, p).collect():
        assert len(r.negatives) == 3 and r.positive not in r.negatives
    lab = dataset.lab_flags(spark.createDataFrame([(1, "a", 5.0), (1, "b", 1.0)], "report_id int, item string, value double"), spark.createDataFrame([("a", "g", 1.0, 4.0), ("b", "g", 1.0, 4.0)], "item string, unit string, low double, high double")).first()
    assert (lab.abnormal, lab.items) == (1, 2) and "偏高" in lab.text


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, "b", "a"), (1, 2, "a", "a"), (2, 6, "a", "a"), (3, 1, "b", "a")], "query_id int, rank int, book string, expected string")
    r = evaluate.hit_rate_mrr(ranked).first()
    assert (r.hit_rate, r.mrr) == (0.667, 0.1667)
    ch = spark.createDataFrame([(1, "vector", 1, 1), (1, "keyword", 1, 2)], "query_id int, channel string, rank int, id int")
    texts = spark.createDataFrame([(1, "wrong", "t1"), (2, "right", "t2")], "id int, book string, content string")
    want = spark.createDataFrame([(1, "right")], "query_id int, expected string")
    weights, _, best, _ = evaluate.tune_fusion(ch, texts, want, rounds=1)
    assert best == (1.0, 1.0) and weights["vector"] < weights["keyword"]
    prf = evaluate.extraction_prf(spark.createDataFrame([(1, "白细胞计数", 5.2), (1, "x", 1.0)], "item_id int, name string, value double"), spark.createDataFrame([(1, "白细胞", 5.0)], "item_id int, name string, value double")).first()
    assert (prf.precision, prf.recall, prf.exact) == (0.5, 1.0, False)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n', encoding="utf-8")
    good, bad = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int")
    assert sorted(r.x for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    (tmp_path / "m.json").write_text('{"d1": {"names": ["a", "b"], "n": 2}}', encoding="utf-8")
    assert io.read_json_map(spark, str(tmp_path / "m.json"), "struct<names:array<string>,n:int>").select("key", "value.n").first() == ("d1", 2)
    (tmp_path / "book.md").write_text("text", encoding="utf-8")
    assert io.read_books(spark, str(tmp_path / "book.md")).select("title", "text").first() == ("book", "text")
    rule = spark.createDataFrame([("p", "﻿name: 甲\nbody: |-\n  一\n  二\n\ncls: x")], "path string, text string")
    assert io.parse_rule_files(rule).first().fields == {"name": "甲", "body": "一\n二", "cls": "x"}
    check = spark.createDataFrame([("p", "A001.001 名称\n判定要点：甲\n乙\n豁免：丙\n- A001.002 其他\n质控要求\n丁")], "path string, text string")
    assert {r.code: (r.name, r.points, r.exempt) for r in io.parse_checklist(check).collect()} == {"A001.001": ("名称", "甲\n乙", "丙"), "A001.002": ("其他", "丁", "")}
    claims = spark.createDataFrame([('#1 甲说\n----------\n{"说法": "正确", "理由": "r"}\n#2 乙\n----------\n{bad}\n#3 丙\n-----------\n{"理由": "s"}\n',)], "text string")
    got = io.parse_claim_blocks(claims)
    assert [tuple(r) for r in got.collect()] == [("甲说", "正确", "r"), ("丙", "不正确", "s")]
