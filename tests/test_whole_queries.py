"""Registered queries without an SQL twin against brute force, over small tables of their own."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.operators import evaluate, retrieval
from lorebase.plans import queries
from lorebase.plans.queries import QUERIES


def stored(df, folder, name: str) -> str:
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def brute_chapters(text: str) -> list[tuple]:
    nodes: list[list] = []
    for i, line in enumerate(text.split("\n")):
        if i % 8 == 0:
            nodes.append([f"第{i // 8 + 1}章", i + i // 8, []])
        nodes[-1][2].append(line)
    out: list[list] = []
    for title, start, lines in nodes:
        content = "\n".join(lines).strip(" ")
        if out and len(content) < 20:
            out[-1][2] += [title] + [content] * bool(content)
        else:
            out.append([title, start, [content] * bool(content)])
    return [(n, title, start, hashlib.md5("\n".join(parts).encode()).hexdigest()) for n, (title, start, parts) in enumerate(out, 1)]


def test_split_chapters_keeps_every_character(spark, tmp_path):
    long = "a first line of far more than twenty characters, all of which count"
    texts = [long, "\n".join(f"{long} {i}" for i in range(20)), "\n".join([long] * 8 + ["short"]), "\n".join([long] * 16 + ["", "x", ""]), "", "\n".join(["ab"] * 9 + [long] * 30)]
    d = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    got = sorted((r.doc_id, r.ord, r.title, r.start_line, r.h) for r in QUERIES["split_chapters"](spark, d).collect())
    assert got == sorted((i, *row) for i, t in enumerate(texts) for row in brute_chapters(t))


def brute_prefixes(rows: list[tuple]) -> set[tuple]:
    kept: dict = {}
    for query, rank, i, text in sorted(rows, key=lambda r: r[1]):
        mine = kept.setdefault(query, [])
        n = [min(len(text or ""), len(t or "")) for _, _, t in mine]
        if text is None or not any(m >= 10 and text[: m * 6 // 10 + 1] == t[: m * 6 // 10 + 1] for m, (_, _, t) in zip(n, mine, strict=True)):
            mine.append((rank, i, text))
    return {(q, r, i) for q, mine in kept.items() for r, i, _ in mine}


def nested(seed: int, n: int) -> list[str | None]:
    """Texts that begin alike, at many lengths, with copies, short ones and a null."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(200)) for _ in range(3)]
    return [None, "", "short", "short", *(rng.choice(base)[: rng.randint(5, 200)] + "".join(rng.choice("xy") for _ in range(rng.randint(0, 90))) for _ in range(n))]


def test_prefix_dedup_over_whole_lists(spark, tmp_path):
    texts = nested(1, 500)
    docs = [(i, f"s{i % 3}" if i % 50 else None, t) for i, t in enumerate(texts)]
    d = stored(spark.createDataFrame(docs, "doc_id long, source string, text string"), tmp_path, "documents")
    seen: dict = {}
    ranked = []
    for i, source, text in docs:
        seen[source] = seen.get(source, 0) + 1
        ranked.append((source, seen[source], i, text))
    got = [tuple(r) for r in QUERIES["prefix_dedup"](spark, d).select("query_id", "rank", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_prefixes(ranked)
    assert max(r[1] for r in got) > 20


@pytest.fixture
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_prefix_dedup_in_any_order_of_ranks(spark, many_ranges):
    rng = random.Random(2)
    for n in (1, 400):
        texts = nested(n, n)
        ranks = rng.sample(range(len(texts)), len(texts))
        rows = [(i % 2, ranks[i], i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "query_id int, rank int, id long, content string")
        assert {tuple(r) for r in retrieval.prefix_dedup(df).select("query_id", "rank", "id").collect()} == brute_prefixes(rows)


def test_fusion_grid_has_the_whole_grid(spark):
    got = QUERIES["fusion_grid"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.param for r in got) == list(range(4 * len(evaluate.WEIGHT_GRID) + len(evaluate.K_GRID)))
    channels = {r.channel for r in queries._four_channels(spark, "/root/testdata/sf0.001").select("channel").distinct().collect()}
    assert channels == set(retrieval.WEIGHTS)


def test_replayed_fusions_equal_the_operators(spark):
    """Random channels: every parameter set gives what fusion, quota, deduplication and metrics give one after the other."""
    rng = random.Random(9)
    found = sorted({(q, c, r, rng.randrange(25)) for q in range(12) for c in ("vector", "keyword", "title", "path", "other") for r in range(1, rng.randint(1, 9))})
    ids: set = set()
    found = [(q, c, r, i) for q, c, r, i in found if (q, c, i) not in ids and not ids.add((q, c, i))]
    base = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(3)]
    texts = [(i, rng.choice(["x", "y", "z", "", None]), rng.choice([None, "short", rng.choice(base)[: rng.randint(5, 40)] + "".join(rng.choice("cd") for _ in range(rng.randint(0, 20)))])) for i in range(25)]
    channels = spark.createDataFrame(found, "query_id int, channel string, rank int, id int")
    text = spark.createDataFrame(texts, "id int, book string, content string")
    expected = spark.createDataFrame([(q, rng.choice("xyz")) for q in range(14)], "query_id int, expected string")
    params = [(retrieval.WEIGHTS, 60), ({"vector": 0.0, "keyword": 1.5}, 20), ({"vector": 0.3, "title": 2.0, "path": 0.0, "other": 0.0}, 100), ({c: 0.0 for c in ("vector", "keyword", "title", "path", "other")}, 60)]
    got = {r.param: (r.hit_rate, r.mrr) for r in evaluate.fusion_grid(channels, text, expected, params).collect()}
    for p, (weights, k) in enumerate(params):
        ranked = retrieval.book_quota(retrieval.rrf_fuse(channels, k, weights).join(text, "id"), 5)
        kept = retrieval.prefix_dedup(ranked).join(text.select("id", "book"), "id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        one = evaluate.hit_rate_mrr(expected.join(kept.select("query_id", "rank", "book"), "query_id", "left")).first()
        assert got[p] == (one.hit_rate, one.mrr)


def test_fusion_facts_are_made_in_many_tasks(spark):
    """Small rows of much work: all queries once met in one task."""
    channels = spark.createDataFrame([(q, c, r, q + r) for q in range(200) for c in ("vector", "keyword") for r in (1, 2, 3)], "query_id int, channel string, rank int, id int")
    text = spark.createDataFrame([(i, f"b{i % 3}", f"text {i}") for i in range(210)], "id int, book string, content string")
    expected = spark.createDataFrame([(q, f"b{q % 3}") for q in range(220)], "query_id int, expected string")
    facts = evaluate.fusion_facts(channels, text, expected)
    per = facts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in per) == 220
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert facts.where("books IS NULL").count() == 20
