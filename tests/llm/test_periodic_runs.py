"""Periodic runs and their longest common extensions against brute force, and the edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lorebase.llm import periodic_runs
from tests.llm.conftest import DOCS, rows


def brute_runs(w: list, least: int = 12) -> list[tuple]:
    best: dict = {}
    for q in range(1, len(w) // 2 + 1):
        start = None
        for i in range(len(w)):
            same = i + q < len(w) and w[i] == w[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(least, 2 * q):
                    best.setdefault((start, i - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def random_words(rng: random.Random, n: int) -> list[int]:
    w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        if n > 4:
            a = rng.randrange(n - 2)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least", [2, 12])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(600):
        w = random_words(rng, rng.randint(0, 110))
        assert list(map(tuple, periodic_runs.runs(np.array(w, np.int64), least).tolist())) == brute_runs(w, least), w


def test_grids_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    monkeypatch.setattr(periodic_runs, "SHORT", 0)
    rng = random.Random(5)
    for n in (13, 300, 700):
        w = random_words(rng, n)
        assert list(map(tuple, periodic_runs.runs(np.array(w, np.int64)).tolist())) == brute_runs(w)
    x, q = (np.concatenate(c) for c in zip(*periodic_runs.grid(60, 12), strict=True))
    assert sorted(zip(x.tolist(), q.tolist(), strict=True)) == sorted((x, q) for q in range(1, 31) for x in range(0, 60 - q, max(q, 12 - q)))


def test_extensions_match_brute_force():
    rng = random.Random(2)
    for n in (1, 2, 14, 40, 200):
        w = random_words(rng, n)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        if not pairs:
            continue
        i, j = np.array(pairs).T
        want = [next(k for k in range(n + 1) if b + k >= n or w[a + k] != w[b + k]) for a, b in pairs]
        assert periodic_runs.Extensions(np.array(w, np.int64))(i, j).tolist() == want


def test_digests_match_brute_force(docs, empty):
    spark = docs.sparkSession
    rng = random.Random(7)
    more = [(1000 + k, " ".join(f"w{x}" for x in random_words(rng, rng.randint(0, 90))) + rng.choice(["", " x", " é é", "\x1f"]), "en", "s", 1, 1, 1, "a", "b") for k in range(120)]
    data = rows() + more
    got = sorted((tuple(r) for r in periodic_runs.run_digests(docs.union(spark.createDataFrame(more, DOCS))).collect()), key=str)
    want, planted = [], 0
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        n, h = len(w), 1 if r[0] is None else zlib.crc32(str(r[0]).encode())
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        rest = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want.append((r[0], len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(rest).encode()).hexdigest()))
    assert got == sorted(want, key=str) and planted > 5
    assert periodic_runs.run_digests(empty).collect() == [] == periodic_runs.collapse_runs(empty).collect()


def test_collapsed_texts_keep_the_first_period(spark):
    d = spark.createDataFrame([(1, "so " + "a b c " * 5 + "end"), (2, None), (3, "one two"), (None, "x " * 30)], "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in periodic_runs.collapse_runs(d).collect()}
    assert got == {1: ("so a b c end", [(1, 15, 3)]), 2: ("", []), 3: ("one two", []), None: ("x", [(0, 30, 1)])}
