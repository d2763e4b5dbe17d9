"""Cases that once gave wrong answers."""

from __future__ import annotations

import random

from lorebase.operators import dataset, evaluate, feedback, retrieval, structure, tree


def test_deep_trees_are_whole(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i, i - 1 if i else None) for i in range(36)], "id long, title string, level int, parent_id long")
    assert tree.subtree(docs, docs.where("id = 0")).count() == 36


def test_vectors_of_several_dimensions(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "query_id long, vec array<float>")
    p = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [2.0, 0.0, 0.0]), (13, None)], "id long, vec array<float>")
    for queries in (q, q.orderBy("query_id"), q.orderBy(q.query_id.desc())):
        assert {(r.query_id, r.id) for r in retrieval.vector_search(queries, p, 5, 0.5).collect()} == {(1, 12), (2, 10)}


def test_weights_of_zero_or_less_drop_a_channel(spark):
    c = spark.createDataFrame([(1, "vector", 1, 5), (1, "keyword", 1, 6)], "query_id long, channel string, rank int, id long")
    assert [r.id for r in retrieval.rrf_fuse(c, weights={"vector": 1.0, "keyword": -1.0}).collect()] == [5]


def test_contents_match_without_signs_and_stop_at_the_first_equal_line(spark):
    entries = spark.createDataFrame([(1, 0, "第一章 绪论", 1, 9), (1, 1, "第二章 方法", 1, 9), (1, 2, "第三章 结果", 1, 9)], "doc_id long, ord int, title string, level int, target int")
    texts = ["x", "第一章|绪论", "y", "第一章绪论", "第二章 方法", "z" * 30, "第三章（结果）", "end"]
    lines = spark.createDataFrame([(1, i, 9, t) for i, t in enumerate(texts)], "doc_id long, line_no int, page_no int, text string")
    got = sorted((r.ord, r.start_line) for r in structure.split_by_toc(entries, lines).collect())
    assert got == [(0, 1), (1, 4), (2, 6)]


def test_numbered_items_are_sections_after_any_heading(spark):
    body = "正文内容足够长，超过二十个字符的一段话，用来避免合并。"
    texts = ["第一节 甲", body, "1. 乙", body]
    lines = spark.createDataFrame([(1, i, 1, t, 0.0, 0.0) for i, t in enumerate(texts)], "doc_id long, line_no int, page_no int, text string, size_min double, size_max double")
    assert [r.level for r in structure.split_chapters(lines).orderBy("ord").collect()] == [2, 2]


def test_one_book_still_gives_triplets(spark):
    chapters = spark.createDataFrame([(1, 7, "b", "甲章标题"), (2, 7, "b", "乙章标题")], "id long, book_id long, book_title string, title string")
    passages = spark.createDataFrame([(10, 1, "a" * 30), (11, 2, "b" * 30)], "id long, doc_id long, content string")
    assert {(r.query, tuple(r.negatives)) for r in dataset.triplets(chapters, passages).collect()} == {("甲章标题", ("b" * 30,)), ("乙章标题", ("a" * 30,))}
    asked = spark.createDataFrame([("问？", "b", "甲章标题")], "question string, book_title string, chapter string")
    assert [tuple(r) for r in dataset.question_triplets(asked, chapters, passages).collect()] == [("问？", "a" * 30, [])]


def test_keywords_of_books_count(spark):
    docs = spark.createDataFrame([(1, "书", "域", 0, None, ["心电图"])], "id long, title string, domain string, level int, parent_id long, keywords array<string>")
    k = spark.createDataFrame([(1, "心电图")], "query_id long, kw string")
    assert [(r.book_id, r.score) for r in retrieval.coarse_books(k, docs).collect()] == [(1, 2.0)]


def test_answers_are_stored_as_one_pass_would(spark):
    rng = random.Random(4)
    events = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 4000, 7)])) for i in range(600)]
    df = spark.createDataFrame(events, "event_id long, key string, s long").withColumn("ts", spark_time())
    for ttl in (0, 13, 60, 5000):
        want, stored = {}, {}
        for i, k, t in sorted(events, key=lambda e: (e[2] is None, e[2] or 0, e[0])):
            want[i] = None if t is None else t - stored.get(k, -1e18) <= ttl
            if want[i] is False:
                stored[k] = t
        got = feedback.dedupe_questions(df.repartition(3), ttl).collect()
        assert len(got) == len(events) and {r.event_id: r.hit for r in got} == want


def spark_time():
    from pyspark.sql import functions as F

    return F.timestamp_seconds("s")


def test_latencies_without_a_time_count_as_requests(spark):
    df = spark.createDataFrame([("a", 200, 4.0), ("a", 500, 4.0), ("a", 200, 1.0), ("a", 200, 10.0), ("a", 200, None), ("b", 500, None)], "path string, status int, elapsed_ms double")
    got = {r.path: tuple(r)[1:] for r in feedback.access_latency(df, 5.0).collect()}
    assert got == {"a": (5, 1, 4.75, 4.0, 9.82, 1), "b": (1, 1, None, None, None, 0)}
    got = {r.path: tuple(r)[1:] for r in evaluate.latency_stats(df, ["path"], "elapsed_ms").collect()}
    assert got == {"a": (5, 4.75, 4.0, 10.0), "b": (1, None, None, None)}


def test_new_questions_are_numbered_over_all_ranges(spark):
    old = spark.createDataFrame([(3, "q1")], "id long, question string")
    new = spark.range(500).selectExpr("id AS ord", "concat('q', id % 400) AS question").repartition(7)
    got = {r.question: r.id for r in dataset.append_new_questions(old, new).collect()}
    order = [f"q{i}" for i in range(400) if i != 1]
    assert got == {"q1": 3} | {q: 4 + i for i, q in enumerate(order)}
