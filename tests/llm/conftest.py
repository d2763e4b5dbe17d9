"""Fixtures of documents with the cases that every operator must define."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, cid int, first string, TEXT_ID string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows; columns that clash with inner names."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 40)
    texts = [base, base, base + " end", base.replace(" ", "  ", 3), words(rng, 80) + " " + passage, words(rng, 90) + " " + passage + " " + words(rng, 10), passage, "", None, "one", "One two", "one two", "é" * 300 + " ñandú " + passage, "x" * 250, words(rng, 9000), passage + " " + words(rng, 5) + " " + passage, " \n\t ", "😀 " * 80]
    out = [(i * 3, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 1, 2, "f", "t") for i, t in enumerate(texts)]
    return [*out, out[4], (None, base + " more", None, None, None, None, None, None, None)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
