"""Training of the secret network: every distinct candidate counts, however rows are dealt, and memory is bounded by pieces."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lorebase.llm import secret_scan as ss


def candidates(spark, n: int):
    """About ``n`` candidates of no kind and a fifth as many of the first one, with the place of each in a draw by hash."""
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice("abcdefgh0123456789") for _ in range(k))
    rows = [(f"key {text(8)} or", 4, 8, 0) for _ in range(n)] + [(f"key {text(12)} is", 4, 12, 1) for _ in range(n // 5)]
    return spark.createDataFrame(rows, "window string, before int, size int, bits int").withColumn("draw", F.pmod(F.xxhash64(F.lit(11), "window", "before"), F.lit(1 << 20)) / (1 << 20))


def same(a: ss.Network, b: ss.Network) -> bool:
    return all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("filters", "bias", "dense", "last", "scale", "shift", "threshold"))


def test_candidates_that_a_draw_left_out_count(spark, monkeypatch):
    monkeypatch.setattr(ss, "EPOCHS", 1, raising=False)
    rows = candidates(spark, 13_000).localCheckpoint()
    late = [r.window for bits in (0, 1) for r in rows.where((F.col("draw") > 0.8) & (F.col("bits") == bits)).orderBy("window").limit(100).collect()]
    swapped = rows.withColumn("bits", F.when(F.col("window").isin(late), 1 - F.col("bits")).otherwise(F.col("bits")))
    assert swapped.where("bits = 1").count() == rows.where("bits = 1").count()
    assert not same(ss.train(rows, rows.drop("draw")), ss.train(swapped, swapped.drop("draw")))


def test_network_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ss, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ss, "EPOCHS", 2)
    rows = candidates(spark, 900).drop("draw").localCheckpoint()
    one = ss.train(rows, rows.repartition(1))
    assert np.isfinite(one.threshold[0]) and same(one, ss.train(rows, rows.union(rows).repartition(7)))


def test_gradients_in_pieces(monkeypatch):
    rng = random.Random(2)
    windows = ["".join(rng.choice("abc019 =") for _ in range(rng.randint(6, 300))) for _ in range(20)]
    inside = [(2, len(w) - 1) for w in windows]
    y, weight = np.eye(3, dtype=np.float32)[[rng.randrange(3) for _ in windows]], np.full((20, 3), 2.0, np.float32)
    want = ss.Network.fresh()._gradients(windows, inside, y, weight)
    monkeypatch.setattr(ss, "PIECE", 64)
    for a, b in zip(want, ss.Network.fresh()._gradients(windows, inside, y, weight), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_steps_of_a_fit_are_bounded(monkeypatch):
    monkeypatch.setattr(ss, "STEP_ROWS", 4)
    monkeypatch.setattr(ss, "STEP_CHARS", 100)
    sizes = [10, 10, 10, 10, 10, 500, 60, 60, 1, 1]
    parts = [p.tolist() for p in ss._portions(np.arange(10), sizes)]
    assert parts == [[0, 1, 2, 3], [4], [5], [6], [7, 8, 9]]
    assert not list(ss._portions(np.arange(0), []))


def test_threshold_from_counts_matches_single_outputs():
    rng = np.random.default_rng(1)
    steps = np.unique(rng.integers(-3000, 3000, 200))
    good, other = rng.integers(0, 4, len(steps)) * (steps > -500), rng.integers(0, 30, len(steps)) * (steps < 400)
    keep = good + other > 0
    steps, good, other = steps[keep], good[keep], other[keep]
    net = ss.Network.fresh()
    net.calibrate(1, steps, good, other, 0.9)
    raw = np.r_[np.repeat(steps, good), np.repeat(steps, other)] / ss.GRID
    y = np.arange(len(raw)) < good.sum()
    p = ss._chance(raw, net.scale[1], net.shift[1])
    cuts = np.unique(p)
    recall, precision = np.array([(p[y] >= t).mean() for t in cuts]), np.array([y[p >= t].mean() for t in cuts])
    able = recall >= 0.9
    best = cuts[able & (precision == precision[able].max())]
    assert best[0] - 1e-3 <= net.threshold[1] <= best[-1] and np.isinf(net.threshold[[0, 2]]).all()
    assert (p[y] >= net.threshold[1]).mean() >= 0.9 and y[p >= net.threshold[1]].mean() == precision[able].max()
