"""Search by blocks and containment joins against brute force: several blocks and lanes, ties, hot terms, ids of other kinds."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lorebase.operators import blocks, common, retrieval


@pytest.fixture(params=["few", "lanes"])
def lanes(spark, request):
    """Query blocks sent to all passages, and dealt in lanes."""
    if request.param == "lanes":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vector_search_over_several_blocks(spark, lanes):
    rng = np.random.default_rng(1)
    q = [(i, rng.integers(-2, 3, 3 if i % 5 else 2).astype(float).tolist()) for i in range(1300)] + [(9000, None), (9001, [0.0, 0.0, 0.0]), (9002, [1.0, 0.0, 0.0, 0.0])]
    p = [(f"p{i:04}", rng.integers(-2, 3, 3 if i % 3 else 2).astype(float).tolist(), i % 7 != 1) for i in range(1500)] + [("none", None, True), ("zero", [0.0, 0.0], True)]
    got = retrieval.vector_search(spark.createDataFrame(q, "query_id long, vec array<double>").repartition(2), spark.createDataFrame(p, "id string, vec array<double>, enabled boolean").repartition(3), 4, 0.3)
    found: dict = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
    for i, v in q:
        sims = []
        for pid, w, on in p:
            if v and w and on and len(v) == len(w) and any(v) and any(w):
                s = float(np.round(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 6))
                if s >= 0.3:
                    sims.append((-s, pid))
        best = sorted(sims)[:4]
        mine = sorted(found.get(i, []))
        assert [x[0] for x in mine] == list(range(1, len(best) + 1))
        assert [round(x[2], 5) for x in mine] == [round(-s, 5) for s, _ in best]
        assert {x[1] for x in mine if x[2] > -best[-1][0] + 1e-6} == {pid for s, pid in best if -s > -best[-1][0] + 1e-6} if best else not mine


def test_keyword_search_with_a_hot_term(spark, lanes):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["a", "b", "é"]
    q = [(i, rng.sample(vocab, 4) + ["common", "common", None]) for i in range(60)] + [(100, []), (101, None), (102, ["a"])]
    p = [(i, rng.choice(["x", "y", None]), [*rng.sample(vocab, rng.randint(0, 6)), "common"] * (i % 50 > 0)) for i in range(2500)] + [(9999, "x", None)]
    got = retrieval.keyword_search(spark.createDataFrame(q, "query_id long, terms array<string>"), spark.createDataFrame(p, "id long, book string, terms array<string>").repartition(3), 7)
    want = set()
    for i, terms in q:
        mine = {t for t in (terms or []) if t}
        rows = sorted((-s, pid, b) for pid, b, ts in p if (s := sum(2 if len(t) >= 3 else 1 for t in mine & set(ts or []))) >= 2)
        used: dict = {}
        rank = 0
        for s, pid, b in rows:
            used[b] = used.get(b, 0) + 1
            if used[b] <= 3 and rank < 7:
                rank += 1
                want.add((i, pid, b, -s, rank))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_containment_matches_brute_force(spark, most):
    rng = random.Random(2)
    texts = [(i, i % 3, "".join(rng.choice("abcAB é术后") for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(7, 1, "twice abc"), (7, 1, "twice abc"), (8, 0, None), (9, 0, ""), (None, None, "no key ABC")]
    words = [(i, "".join(rng.choice("abcA é术后") for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(1, "abc"), (1, "abc"), (2, "ABC"), (3, ""), (4, None), (5, "术"), (6, "b")]
    got = common.contains_pairs(spark.createDataFrame(texts, "id long, g int, t string"), "t", spark.createDataFrame(words, "w long, word string"), "word", ["id", "g"], most)
    assert got.columns == ["id", "g", "w", "word"]
    want = [(i, g, w, x) for i, g, t in texts for w, x in words if t and x and x.lower() in t.lower()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_signatures_carry_no_text(spark):
    texts = spark.createDataFrame([(i, f"some text {i} with words") for i in range(50)], "id long, _text string")
    plan = common.by_signature(texts, spark.createDataFrame([("words",), ("text 7",)], "_word string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # the grams were exploded beside the keys and written


def test_sizes_are_read_with_their_units():
    assert [blocks.in_bytes(x) for x in ("256k", "10485760b", "-1", "3mb", "2 g", "0")] == [256 << 10, 10485760, -1, 3 << 20, 2 << 30, 0]


class _Views(blocks.Kernel):
    """Says of a block's ids whether they are a view of something larger."""

    def prepare(self, queries):
        return None

    def found(self, asked, passages, floor):
        return [np.zeros(1, np.int64), np.ones(1), np.zeros(1, np.int64)]

    def best(self, rows):
        return np.zeros(1, np.int64), np.zeros(1, bool)

    def output(self, ids, rows):
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0])), pa.array([any(b is not None and b.parent is not None for b in ids.buffers())])], ["query_id", "view"])


def test_ids_of_query_blocks_hold_no_batches(spark, lanes):
    """The ids that a task keeps were views once, which held the batch of pairs of each query block."""
    rows = spark.range(0, 5000, 1, 3)
    got = blocks.search(rows, rows, _Views, "query_id long, view boolean").collect()
    assert got and not any(r.view for r in got)
