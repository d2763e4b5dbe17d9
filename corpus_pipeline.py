"""A training corpus from documents: reject toxic texts, drop near copies, cut repeats, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs`` (the last one token ids); its rows are
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from lorebase.llm.common import documents, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score 0.7 or more."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Cuts strings of 100 bytes or more that occur earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Repeats and leaves out documents so that the sources weigh 5, 2, 1 in turn; a document taken n times is n rows."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Token ids of what the mix took: doc_id, n_tokens, ids."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encode_stage),
]

#: No SQL: stages 1, 3 and 5 are a learned score, a suffix array and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
