"""Bounded, repeatable samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held: int, most: tuple[int, int], seed: int = 5) -> tuple[DataFrame, tuple[int, int]]:
    """Rows of ``docs`` with their 0/1 ``label`` as column y, and how many labelled rows there are of 0 and of 1.

    Left out: rows whose remainder is ``held``, null ids and null labels; of several labels of an id the
    largest counts. About ``most[y]`` rows of each class at most, drawn by a hash of the id, so a rerun draws
    the same; smaller classes are taken whole. The drawn ids are a table of bounded size and are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), of) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    found = known.agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b")).first()
    counts = (int(found["a"] or 0), int(found["b"] or 0))
    parts = 1 << 20
    cut = [int(min(1.0, m / max(n, 1)) * parts) for m, n in zip(most, counts, strict=True)]
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(parts)) < F.when(F.col("y") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0])))
    return docs.join(F.broadcast(drawn), "doc_id"), counts
