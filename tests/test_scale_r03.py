"""Steps that once grew with the square of a group: the same rows, from bounded intermediate ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import common, graph, retrieval, structure
from lorebase.plans import QUERIES, SQL


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def metric_rows(df) -> int:
    """Most rows that a node of the executed plan puts out, by Spark's own metrics."""
    df.collect()
    plan, most, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_link_entities_is_distinct_before_the_join(spark):
    e = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 10), (3, None), (None, 10)], "id long, doc_id long")
    p = spark.createDataFrame([(7, 10), (7, 11), (7, 10), (8, 11), (9, None), (6, 10)], "id long, doc_id long")
    got = graph.link_entities(e, p).collect()
    want = {(a, b) for a, d in [(1, 10), (1, 11), (2, 10), (None, 10)] for b, x in [(7, 10), (7, 11), (8, 11), (6, 10)] if d == x}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    many = spark.range(0, 400).select((F.col("id") % 40).alias("id"), F.lit(1).alias("doc_id"))
    assert metric_rows(graph.link_entities(many, many)) <= 40 * 40  # 160,000 before


def test_rule_entity_map_is_distinct_before_the_join(spark):
    rules = spark.range(0, 2000).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("note_qc_code"), (F.col("id") % 2).alias("doc_id"))
    e = spark.range(0, 100).select("id", (F.col("id") % 2).alias("doc_id"))
    got = graph.rule_entity_map(rules, e)
    assert rows_of(got, "note_qc_code", "entity_id") == sorted((f"c{c}", i) for c in range(3) for i in range(100))
    assert metric_rows(got) <= 2000  # 100,000 before


def walk(seeds, edges, hops, cap):
    """Brute force of k_hop."""
    nodes, found = {q: {i: 0 for i in ids} for q, ids in seeds.items()}, {}
    for q, seen in nodes.items():
        frontier = list(seen)
        for hop in range(1, hops + 1):
            first = {}
            for e, s, t in edges:
                for a, b, side in ((s, t, 1), (t, s, 0)):
                    if a in frontier:
                        found.setdefault((q, e), hop)
                        if b not in seen:
                            first[b] = min(first.get(b, (e, side)), (e, side))
            frontier = sorted(first, key=lambda i: (first[i], i))[:cap]
            seen.update({i: hop for i in frontier})
    return {(q, i, h) for q, seen in nodes.items() for i, h in seen.items()}, {(q, e, h) for (q, e), h in found.items()}


def test_k_hop_as_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    for most in (1000, 2):  # lists of walked nodes, and the way of queries with more
        monkeypatch.setattr(graph, "WALKED", most)
        edges = [(rng.randrange(120), rng.choice([0, 0, rng.randrange(30)]), rng.randrange(30)) for _ in range(150)]
        edges += edges[:10]
        seeds = {1: [0], 2: [3, 4, 5], 3: [29]}
        e = spark.createDataFrame(edges, "id long, source_id long, target_id long")
        s = spark.createDataFrame([(q, i) for q, ids in seeds.items() for i in ids], "query_id int, id long")
        for hops, cap in ((2, 3), (3, 2)):
            nodes, found = graph.k_hop(s, e, hops, cap)
            want = walk(seeds, edges, hops, cap)
            assert rows_of(nodes, "query_id", "id", "hop") == sorted(want[0])
            assert rows_of(found, "query_id", "edge", "hop") == sorted(want[1])
            entities = spark.createDataFrame([(i, f"n{i}") for i in range(0, 30, 2)], "id long, name string")
            more = e.withColumn("weight", F.lit(1))
            columns = ("query_id", "edge", "hop", "source_id", "target_id", "weight")
            plain, fast = (graph.with_details(nodes, found, entities, more, h)[1] for h in (None, hops))
            assert rows_of(fast, *columns) == rows_of(plain, *columns)
            assert sorted(map(str, fast.select("edge", "source", "target").collect())) == sorted(map(str, plain.select("edge", "source", "target").collect()))


def test_a_hub_gives_a_query_few_rows(spark):
    e = spark.range(1, 3001).select("id", F.lit(0).cast("long").alias("source_id"), F.col("id").alias("target_id"))
    s = spark.range(1, 51).select(F.col("id").alias("query_id"), "id")
    steps, kept = [], graph.stored
    graph.stored = lambda df, what: (steps.append(metric_rows(df)) if what == "k-hop" else None, kept(df, what))[1]
    try:
        nodes, found = graph.k_hop(s, e, 2, 5)
    finally:
        graph.stored = kept
    assert nodes.count() == 50 * 7 and max(steps) <= 6050  # 150,000 before
    assert found.count() == 50 * 3000


def test_communities_of_an_entity_in_many(spark):
    com = spark.range(0, 2000).select("id", (F.col("id") % 3).alias("level"), F.lit("s").alias("summary"), F.array(F.col("id") % 2, F.lit(9).cast("long"), F.lit(9).cast("long")).alias("entity_ids"), F.lit(True).alias("enabled"))
    nodes = spark.range(0, 200).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("id"))
    got = graph.community_summaries(nodes, com, 4)
    assert {tuple(r) for r in got.select("id", "rank").collect()} == {(2, 1), (5, 2), (8, 3), (11, 4)} and got.count() == 800
    assert metric_rows(got) <= 6000  # 600,000 before


def test_hits_repeat_no_text(spark, monkeypatch):
    monkeypatch.setattr(common, "HITS", 5)
    words = [f"w{i}" for i in range(10, 40)]
    texts = spark.createDataFrame([(i, " ".join(words)) for i in range(6)], "id long, text string")
    got = common.contains_pairs(texts, "text", spark.createDataFrame([(w,) for w in words], "kw string"), "kw", ["id"])
    assert rows_of(got, "id", "kw") == sorted((i, w) for i in range(6) for w in words)


def test_title_search_takes_the_first_of_each_word_and_document(spark):
    docs = spark.createDataFrame([(1, "book", 0, None), (2, "chapter one", 1, 1)] + [(10 + i, f"section {i}", 2, 2) for i in range(200)], "id long, title string, level int, parent_id long")
    p = spark.range(0, 4000).select("id", (F.col("id") % 8 + 10).alias("doc_id"), F.concat(F.lit("part "), (F.col("id") % 3).cast("string")).alias("section_path"))
    kw = spark.range(0, 300).select(F.col("id").alias("query_id"), F.when(F.col("id") < 299, "SECTION").otherwise("chapter").alias("kw"), F.lit(1).alias("weight"))
    got = retrieval.title_search(kw, docs, p)
    assert {tuple(r) for r in got.select("query_id", "id", "rank").collect()} == {(q, i, i + 1) for q in range(300) for i in range(5)}
    assert metric_rows(got) <= 20_000  # 60,000 pairs of words and titles, 1,196,000 of queries and passages before
    path = retrieval.section_path_search(kw.withColumn("kw", F.lit("part")), p)
    assert path.count() == 3000 and metric_rows(path) <= 10_000  # 1,200,000 before


def test_lookup_icd_with_many_entries_of_a_word(spark):
    icd = spark.range(0, 4000).select(F.concat(F.lit("I"), F.lpad((F.col("id") % 30).cast("string"), 2, "0")).alias("icd_code"), (F.col("id") % 7).cast("string").alias("body_system"), F.lit("Pain acute").alias("search_text"))
    q = spark.range(0, 100).select(F.col("id").alias("query_id"), F.lit("acute pain").alias("text"))
    got = retrieval.lookup_icd(q, icd)
    assert {(r.query_id, tuple(r.systems), tuple(r.codes)) for r in got.collect()} == {(i, tuple("0123456"), tuple(f"I{n:02}" for n in range(20))) for i in range(100)}
    assert metric_rows(got) <= 10_000  # 800,000 before


def test_search_inside_groups(spark):
    rng = random.Random(1)
    vec = lambda: [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]
    p = spark.createDataFrame([(i, rng.choice(["a", "b", "c", None]), vec()) for i in range(300)] + [(300, "a", None), (301, "a", [0.0] * 4), (302, "a", [1.0])], "id long, doc_id string, vec array<double>")
    q = spark.createDataFrame([(i, vec(), [["a"], ["b", "c"], ["a", "a", "z"], []][i % 4], [[], [3, 5, 8]][i % 2]) for i in range(40)], "query_id long, vec array<double>, doc_ids array<string>, passage_ids array<long>")
    cos = F.round(retrieval.cosine(F.col("vec"), F.col("_p")), 6).alias("similarity")
    pv = p.select("id", "doc_id", F.col("vec").alias("_p"))
    one = q.select("query_id", "vec", F.explode("passage_ids").alias("id")).join(pv, "id").select("query_id", "id", "doc_id", F.lit(0).alias("mode"), cos)
    two = q.select("query_id", "vec", F.explode("doc_ids").alias("doc_id")).join(pv, "doc_id").select("query_id", "id", "doc_id", F.lit(1).alias("mode"), cos)
    rows, want = one.unionByName(two).where("similarity >= 0.5").distinct().collect(), []
    for r in q.collect():
        mine = [x for x in rows if x.query_id == r.query_id]
        mine = sorted((-x.similarity, x.id, x.doc_id or "") for x in mine if x["mode"] == min(y["mode"] for y in mine))
        want += [(r.query_id, i, d, -s, n) for n, (s, i, d) in enumerate(mine[: 3 * max(1, len(r.doc_ids))], 1)]
    got = retrieval.scoped_search(q, p, 3, 0.5)
    assert sorted((r.query_id, r.id, r.doc_id or "", r.similarity, r["rank"]) for r in got.collect()) == sorted(want)
    v = retrieval.verify_search(q.select("query_id", "vec", F.get("doc_ids", F.lit(0)).alias("note_qc_code")), p.withColumnRenamed("doc_id", "note_qc_code"), 3, 0.5)
    assert metric_rows(v) <= 2000  # every pair of a code before


def test_split_by_toc_as_a_scan_of_all_lines(spark):
    rng = random.Random(4)
    number = structure.re.compile(structure.TOC_NUMBER)

    def score(title, body, line):
        if line == title:
            return 100
        same = next((i for i, (x, y) in enumerate(zip(title, line)) if x != y), min(len(title), len(line)))
        if same >= 4 and same >= 0.6 * min(len(title), len(line)):
            return 60 + min(same, 30)
        return 55 if len(body) >= 4 and body in line else 0

    lines, entries, want = [], [], []
    for doc in range(60):
        text = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
        text[rng.randrange(60)] = "x" * 61
        titles = [rng.choice(["1.", "第2章", ""]) + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(9)]
        lines += [(doc, i, i // 4, t) for i, t in enumerate(text)]
        entries += [(doc, n, t, 1, n if n % 3 else None) for n, t in enumerate(titles)]
        at, found = 0, []
        for n, t in enumerate(titles):
            title, best, where = structure.re.sub(structure.TOC_LEFT_OUT, "", t), 0, -1
            for i in range(at, 60) if len(title) >= 3 else ():
                s = score(title, number.sub("", title), text[i]) if 3 <= len(text[i]) <= 60 else 0
                s += 15 if s and n % 3 and abs(i // 4 - n) <= 2 else 0
                if s > best:
                    best, where = s, i
                if s >= 100:
                    break
            if where >= 0:
                found.append((doc, n, where))
                at = where + 1
        want += found if len(found) >= 3 else []
    e = spark.createDataFrame(entries, "doc_id long, ord int, title string, level int, target int")
    x = spark.createDataFrame(lines, "doc_id long, line_no int, page_no int, text string")
    assert rows_of(structure.split_by_toc(e, x), "doc_id", "ord", "start_line") == sorted(want)
    assert len(want) > 60


def test_split_chapters_of_lines_like_headings(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    text = "\n".join(["1. a point of some length and more", "第3章 说明", "附录 一", "一、甲", "# head", "x" * 30] * 5)
    spark.createDataFrame([(1, text), (2, "1. a"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.connect().execute(SQL["split_chapters"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = QUERIES["split_chapters"](spark, str(tmp_path)).select("doc_id", "ord", "title", "level", "start_line", "h")
    assert sorted(map(tuple, got.collect())) == sorted(want)
