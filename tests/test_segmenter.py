"""The double-array segmenter against a plain search for the likeliest cut."""

from __future__ import annotations

import math
import random

import pytest

from lorebase.operators import segmenter


def slow(lexicon: dict, text: str) -> list[str]:
    total = sum(lexicon.values())
    known = {w: round(math.log(f / total) * segmenter.SCALE) for w, f in lexicon.items()}
    other, longest = round(math.log(0.5 / total) * segmenter.SCALE), max(map(len, lexicon))
    best = [(0, 0)] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        best[i] = max((known.get(text[i:j], other if j == i + 1 else -(10**18)) + best[j][0], j) for j in range(i + 1, min(len(text), i + longest) + 1))
    out, i = [], 0
    while i < len(text):
        out.append(text[i : best[i][1]])
        i = best[i][1]
    return [w for w in out if len(w) >= 2]


def test_cuts_match_a_plain_search():
    rng = random.Random(1)
    for _ in range(250):
        letters = "abcd病痛的药热 "[: rng.randint(2, 10)]
        lexicon = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(rng.randint(1, 40))}
        texts = ["".join(rng.choice(letters + "zé😀") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        assert segmenter.Trie(lexicon).words(texts) == [slow(lexicon, t) for t in texts]


def test_long_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(segmenter, "CHARS", 10)
    rows = [(1, "病痛病痛" * 3000), (2, None), (3, ""), (4, "病\0痛"), (5, "abc"), (6, "热药 药热")]
    got = {r.id: r.terms for r in segmenter.segment(spark.createDataFrame(rows, "id long, text string").coalesce(1), {"病痛": 5, "热药": 2, "药热": 2, "bc": 1}, ("药热",)).collect()}
    assert got == {1: ["病痛"], 2: [], 3: [], 4: [], 5: [], 6: ["热药"]}
    with pytest.raises(ValueError):
        segmenter.segment(spark.createDataFrame(rows, "id long, text string"), {"a\0": 1})
