"""The pipeline's stages on nulls, repeated ids, repeated rows, extra columns and the empty table."""

from __future__ import annotations

import pytest

from lorebase.llm import ngram_join, suffix_dedup, toxicity
from lorebase.llm.shingles import shingle_set
from tests.llm.conftest import rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_one_row_of_each_component_stays(docs, empty):
    kept = [tuple(r) for r in ngram_join.keep_one(docs, 5, 80).collect()]
    data = rows()
    sets = [set(shingle_set(r[1], 5).tolist()) for r in data]
    part = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                part = [part[j] if p == part[i] else p for p in part]
    want = [min((data[k] for k in range(len(data)) if part[k] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in set(part)]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert ngram_join.keep_one(empty, 5, 80).collect() == []


def test_rows_without_ids_are_judged_by_their_own_text(docs, empty):
    spark = docs.sparkSession
    word = lambda i: "".join(chr(97 + int(c)) for c in str(1000 + i))  # noqa: E731  # a term counts its contexts: each its own word before
    toxic = [(i, f"some plain words and {word(i)} gronkle at the end", 1) for i in range(40)]
    clean = [(100 + i, f"some plain words and {word(i)} garden at the end", 0) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in toxic + clean], "doc_id long, quality int, toxic int")
    table = [(i, t, "x") for i, t, _ in toxic + clean] + [(None, "another gronkle word", "x"), (None, "another garden word", "x"), (0, "a garden under a used id", "x"), (None, None, "x")]
    d = spark.createDataFrame(table, "doc_id long, text string, score string")
    kept = [tuple(r) for r in toxicity.drop_toxic(d, labels).collect()]
    assert all("gronkle" not in (t or "") for _, t, _ in kept)
    assert {(None, "another garden word", "x"), (0, "a garden under a used id", "x"), (None, None, "x")} <= set(kept) and len(kept) == 83
    assert toxicity.drop_toxic(empty, labels).collect() == []


def test_large_groups_are_handed_on(docs, monkeypatch):
    whole = sorted(map(tuple, suffix_dedup.dedup_digests(docs).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 2)
    assert sorted(map(tuple, suffix_dedup.dedup_digests(docs).collect()), key=str) == whole


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "bpe_encoding"]
