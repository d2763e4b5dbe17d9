"""Classifiers: held-out accuracy on planted labels, restoration, rules, and the edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lorebase.llm import quality, toxicity, url_filter
from tests.llm.conftest import words

BAD = ("gronkle", "vexibad", "sputrid")


def labelled(spark, seed: int = 3, n: int = 360):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, toxic, low = words(rng, 60).split(), i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        body = " ".join(text)
        docs.append((i, body.upper().replace(" ", "!! ") if low else body, "en", "s", len(body), 1, 1, "x", "y"))
        labels.append((i, int(not low), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (5, 1, 1)]
    from tests.llm.conftest import DOCS

    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((x[0], x) for x in labels[:n])


def accuracy(rows, truth, at: int) -> float:
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (3 if at == 2 else 4) == (1 if at == 2 else 2)) for r in rows)
    return float(np.mean([r.predicted == truth[r.doc_id][at] for r in held]))


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 360 and accuracy(got, truth, 2) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_disguised_words_are_restored(spark):
    docs, labels, _ = labelled(spark)
    costs, terms, base = toxicity.train(docs.select("doc_id", "text"), labels)
    restorer, scorer = toxicity.Restorer(costs), toxicity.Scorer(terms, base)
    for said in ("a gr0nkle b", "v3xib@d", "s p u t r i d", "grooonkkkle", "v.e.x.i.b.a.d", "$putr1d"):
        assert scorer.hits(said, restorer), said
    assert not scorer.hits("plain words of an ordinary kind, 12.5 and abc123", restorer)


def test_disguises_of_every_kind_together(spark):
    docs, labels, _ = labelled(spark)
    costs, terms, base = toxicity.train(docs.select("doc_id", "text"), labels)
    restorer, scorer = toxicity.Restorer(costs), toxicity.Scorer(terms, base)
    for said in ("$ p u t r i d", "v 3 x ! b @ d", "s, p, u, t, r, i, d", "s / p / u / t / r / i / d", "s    p    u    t    r    i    d", "$$ pp uu tt rr ii dd", "g - r - 0 - n - k - | - 3", "(v e x i b a d)!", "!f s ' p ' u ' t ' r ' 1 ' d, said they", "x" * 44 + "1gronkle1" + "y" * 60):
        assert scorer.hits(said, restorer), said
    ends = toxicity.Scorer({"=dumbass": 0.9, "^dumbas": 0.9, "=assess": 0.8}, base)
    for said in ("dumba$$", "a dumba$$.", "“dumba$$”,"):
        assert ends.hits(said, restorer), said
    assert not scorer.hits("a - b, c (d) e! plain words of an ordinary kind!", restorer)
    assert list(scorer.hits("sputrid!", restorer)) == ["sputrid"]


def test_toxicity_edge_cases(spark, docs, empty):
    _, labels, _ = labelled(spark)
    none = labels.limit(0)
    assert toxicity.score(empty, labels).collect() == []
    for lab in (labels, none):
        got = toxicity.score(docs, lab).collect()
        assert len(got) == docs.count() and all(r.score is not None for r in got)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    got = quality.score(docs, labels).collect()
    assert accuracy(got, truth, 1) > 0.97


def test_quality_edge_cases(spark, docs, empty):
    _, labels, _ = labelled(spark)
    assert quality.score(empty, labels).collect() == []
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert len(quality.score(docs, labels).collect()) == docs.count()


def test_the_cut_parts_the_classes(spark):
    """Few and weakly told poor documents: both classes are judged rightly at the cut, not only the frequent one."""
    rng = random.Random(6)
    text = lambda low: " ".join(rng.choice(["junk", "spam", "x"] if low and rng.random() < 0.35 else ["good", "plain", "words", "text", "of", "many"]) for _ in range(60))
    data = [(i, text(i % 10 == 0), 0 if i % 10 == 0 else 1) for i in range(700)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in data], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int")
    truth = {i: y for i, _, y in data}
    held = [(r.predicted, truth[r.doc_id]) for r in quality.score(docs, labels).collect() if r.held_out]
    for y in (0, 1):
        assert np.mean([p == y for p, t in held if t == y]) >= 0.85


def test_sum_of_squares_identity():
    m = quality.Machine()
    m.w[:] = np.linspace(-1, 1, quality.WIDTH)
    index, values = quality.features("some words and Some more", 7)
    pairs = sum(float(m.v[index[i]] @ m.v[index[j]]) * values[i] * values[j] for i in range(len(index)) for j in range(i))
    others, _ = quality.features("other words", 3)
    sizes = np.array([len(others), len(index), len(others)])
    raw = m.raws(np.r_[others, index, others], quality.values_of(sizes), sizes)[0]
    assert raw[1] == pytest.approx(m.bias + float(m.w[index] @ values) + pairs, abs=1e-4) and raw[0] == raw[2]


def test_scores_are_those_of_all_pairs_of_features(spark):
    docs, labels, _ = labelled(spark, n=60)
    m = quality.train(docs.select("doc_id", "text", "n_chars"), labels)
    want = {}
    for r in docs.collect():
        index, x = quality.features(r.text, r.n_chars)
        raw = m.bias + sum(float(m.w[i]) * v for i, v in zip(index, x, strict=True))
        for k in range(quality.RANK):
            f = [float(m.v[i, k]) * float(v) for i, v in zip(index, x, strict=True)]
            raw += sum(f[a] * f[b] for a in range(len(f)) for b in range(a))
        want[r.doc_id] = 1 / (1 + np.exp(-(m.slope * raw + m.shift)))
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_a_sample_of_long_texts_is_thinned(spark):
    docs, labels, truth = labelled(spark)
    m = quality.train(docs.select("doc_id", "text", "n_chars"), labels, most_features=4_000)
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(quality.features(r.text, r.n_chars)[0], truth[r.doc_id][1]) for r in docs.collect() if r.doc_id in held]
    assert np.mean([(s >= 0.7) == bool(y) for s, (_, y) in zip(m.scores([x for x, _ in rows]), rows, strict=True)]) > 0.9


URLS = [(0, "https://www.example.org/es/1"), (1, "http://example.org/en/12?x=1"), (2, "http://EXAMPLE.org/en/2"), (3, "ftp://a.com/fr/x#y"), (4, "https://b.com/de/9"), (5, "https://b.net/en/7"), (6, None), (7, "no scheme"), (8, "x://org"), (9, "x://org/"), (10, "https://notorg/de/"), (11, "https://spam-farm.net/en/1"), (5, "https://b.net/en/7"), (12, "https://ÄB.com/de/é?q"), (13, "")]


def brute_url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u[u.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(k, r) for k, r in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return (host, path, *max(((r, k) for k, r in fits), key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u in URLS * 8], "page_id long, url string, host string, verdict string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(URLS) * 8
    for r in got:
        host, path, rule, verdict = brute_url(dict(URLS)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_trees_learn_labels(spark):
    rng = random.Random(1)
    rows = [(i, f"https://{'cheap-' * 3 if i % 2 else ''}site{rng.randint(1, 99)}.net/{'a/' * (i % 2 * 3)}p?{'x=1&' * (i % 2 * 4)}", i % 2) for i in range(300)]
    known = spark.createDataFrame(rows[:200], "page_id long, url string, label int")
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, u, _ in rows[200:]], "page_id long, url string"), labelled=known).collect()
    assert np.mean([(r.verdict == "block") == bool(r.page_id % 2) for r in got]) > 0.97


def test_url_edge_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none).collect() == []
    only = spark.createDataFrame([(1, None)], "page_id long, url string")
    assert [tuple(r)[:5] for r in url_filter.judge(only).collect()] == [(1, "", "", None, "allow")]


def test_url_statistics_cover_all_suffixes(spark):
    n = 10_500
    known = spark.range(n).selectExpr("concat('http://a.com:', id) AS url", "concat('a.com:', id) AS host", "'' AS path", "0 AS label")
    model = url_filter.train(known)
    assert model.suffixes.count() == n and model.suffixes.agg({"share": "sum"}).first()[0] == pytest.approx(1.0)
    rates = {r.suffix: r.suffix_rate for r in url_filter.with_features(known.limit(20), model.suffixes).collect()}
    assert set(rates.values()) == {1 / 3}
