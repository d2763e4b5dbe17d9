"""Q: health of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kb_health(docs: DataFrame, passages: DataFrame, min_passages: int = 1000, min_docs: int = 10) -> DataFrame:
    """Q1: check, value, passed: totals against minima, passages without vector, without document, without content, disabled ones."""
    p = passages.agg(F.count("*").alias("n"), F.count_if(F.col("vec").isNull()).alias("no_vec"), F.count_if(F.coalesce(F.trim("content"), F.lit("")) == "").alias("empty"), F.count_if(~F.col("enabled")).alias("off"))
    row = lambda name, value, passed: F.struct(F.lit(name).alias("check"), F.col(value).alias("value"), passed.alias("passed"))
    rows = p.select(F.inline(F.array(
        row("passages", "n", F.col("n") >= min_passages), row("without_vector", "no_vec", F.col("no_vec") == 0),
        row("empty_content", "empty", F.col("empty") == 0), row("disabled", "off", F.lit(True)),
    )))
    lost = passages.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").agg(F.count("*").alias("value")).select(F.lit("missing_document").alias("check"), "value", (F.col("value") == 0).alias("passed"))
    held = docs.agg(F.count("*").alias("value")).select(F.lit("documents").alias("check"), "value", (F.col("value") >= min_docs).alias("passed"))
    return rows.unionByName(lost).unionByName(held)


def embedding_status(table: DataFrame, name: str, scope: str = "true") -> DataFrame:
    """Q2: table, rows, with_vector, dimension, lacking (rows of ``scope``, a SQL condition, without a vector)."""
    return table.agg(F.count("*").alias("rows"), F.count("vec").alias("with_vector"), F.max(F.size("vec")).alias("dimension"), F.count_if(F.expr(scope) & F.col("vec").isNull()).alias("lacking")).select(F.lit(name).alias("table"), "*")


def content_lengths(rows: DataFrame) -> DataFrame:
    """Q3: query_id, rows, mean characters, all characters."""
    return rows.groupBy("query_id").agg(F.count("*").alias("rows"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"), F.sum(F.length("content")).alias("chars"))


def verify_profile(verify: DataFrame) -> DataFrame:
    """Q4: sentences per rule code and source with subtotals per code and in all."""
    return verify.rollup("note_qc_code", "source").agg(F.count("*").alias("sentences"))
