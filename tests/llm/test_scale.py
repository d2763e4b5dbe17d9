"""Steps whose rows once grew with the square of a group: the same results from fewer."""

from __future__ import annotations

import random

import numpy as np

from lorebase.llm import ngram_join
from lorebase.llm.components import components


def test_blocks_of_a_large_group_give_few_links(spark, monkeypatch):
    """Near copies of one text in many blocks: every pair of blocks once gave a spanning set of its rows."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(5)
    base, n = [f"w{i}" for i in range(400)], 160
    texts = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(n) for k in [rng.randrange(400)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    of_doc = ngram_join.classes(docs, 5).toPandas()
    members = spark.createDataFrame([(int(d), int(c), 1, int(k)) for d, c, k in zip(of_doc.doc_id, of_doc.cid, of_doc.n, strict=True)], "doc_id long, cid long, grp long, n long")
    found = ngram_join.links(docs, members, 5, 80).collect()
    edges = [(r.a, r.b) for r in found if r.b is not None]
    assert len(edges) < 160 + 20 * 21 / 2  # 20 blocks of about 8; every pair of them gave 15 before
    label = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(label) == n and len({r.label for r in label}) == 1
    counts: dict = {}
    for r in found:
        if r.b is None:
            counts[r.a] = counts.get(r.a, 0) + r.n
    assert list(counts.values()) == [n - 1] * n


def test_links_across_blocks_span_what_is_apart_inside():
    """Random units of two sides: with the links inside each side the links given connect what all links connect."""
    rng = np.random.default_rng(3)
    for percent in (50, 80):
        words = [rng.integers(0, 1 << 62, 30).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.r_[rng.choice(words[rng.integers(4)], rng.integers(12, 31), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)]) for _ in range(60)]
        side, cid = rng.integers(1, 3, 60), np.arange(60, dtype=np.int64)
        linked = [(i, j) for j in range(60) for i in range(j) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - o)]

        def parts(pairs):
            label = np.arange(60)
            for _ in range(60):
                for i, j in pairs:
                    label[[i, j]] = min(label[i], label[j])
            return label.tolist()

        a, b, n = ngram_join._product(np.zeros(60, np.int64), side, cid, sets, percent)
        inside, across = [p for p in linked if side[p[0]] == side[p[1]]], [p for p in linked if side[p[0]] != side[p[1]]]
        assert {tuple(sorted(p)) for p in zip(a, b, strict=True)} <= set(across)
        assert len(a) == len(set(parts(inside))) - len(set(parts(linked)))  # more before
        assert parts([*inside, *zip(a, b, strict=True)]) == parts(linked)
        assert n.tolist() == [sum(i in p for p in across) for i in range(60)]


def test_near_copies_give_few_candidate_pairs(spark, monkeypatch):
    """Every list of a group of near copies once gave its own pairs, 21 of them a copy here."""
    given = []

    def counted(edges):
        edges = edges.cache()
        given.append(edges.count())
        return components(edges)

    monkeypatch.setattr(ngram_join, "components", counted)
    rng = random.Random(7)
    base, n = [f"w{i}" for i in range(300)], 300
    texts = []
    for i in range(n):
        text = list(base)
        for j in range(6):
            text[rng.randrange(300)] = f"x{i}-{j}"
        texts.append(" ".join(text))
    far = [" ".join(f"y{i}-{j}" for j in range(60)) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate([*texts, *far, far[0] + " z"])), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.near_duplicates(docs, 5, 80).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    linked = [[100 * len(a & b) >= 80 * len(a | b) and a is not b for b in sets] for a in sets]
    assert [got[i][1] for i in range(n)] == [sum(x) for x in linked]
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if linked[i][j] and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert [got[i][0] for i in range(n)] == label
    assert [got[n + i][0] for i in range(6)] == [n, n + 1, n + 2, n + 3, n + 4, n]
    assert sum(given[:-1]) < 3 * n  # 6,376 before; the last are the links
