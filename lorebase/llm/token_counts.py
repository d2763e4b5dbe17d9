"""Token counts: an exact histogram of encoded lengths and the sums over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm import bpe
from lorebase.llm.common import table

#: Lengths to a block: suffix sums run inside blocks, and over one row per block.
BLOCK = 1024


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs of a table with column n_tokens (nulls are left out); map-side counts, one row per length."""
    return lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, and so for a context limit of L tokens.

    Adds docs_at_least and tokens_at_least (documents of L tokens or more, and their tokens), truncated_total
    (tokens left when every document is cut to L), lost_tokens (cut off by that), and share_up_to (share of
    documents of at most L tokens: L is the q-quantile for the smallest L with share_up_to >= q). ``at_limits``
    answers the limits between.

    Sums run in blocks of 1,024 lengths, so no window gets more than a block's rows or one row per block. No
    rows: no rows.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    after = Window.orderBy(F.col("block").desc())
    later, whole = after.rowsBetween(Window.unboundedPreceding, -1), after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = h.join(blocks, "block")
    out = out.withColumn("docs_at_least", F.col("d_later") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("t_later") + F.sum("tokens").over(inside))
    truncated = F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    share = F.when(F.col("d_all") > 0, F.round((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all"), 9))
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", truncated.alias("truncated_total"), (F.col("t_all") - truncated).alias("lost_tokens"), share.alias("share_up_to"))


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """n_tokens and truncated_total of any context limits (column n_tokens of ``limits``); null limits and those below 0 are left out.

    A limit joins the histogram as a length of 0 documents, so its own suffix sums give the answer.
    """
    asked = limits.select(F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens >= 0").distinct()
    both = histogram.select("n_tokens", "n_docs").unionByName(asked.withColumn("n_docs", F.lit(0).cast("long"))).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return with_suffix_sums(both).join(asked, "n_tokens", "left_semi").select("n_tokens", "truncated_total")


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Encode every text, count lengths, and sum from the end: the columns of ``with_suffix_sums``.

    Null and empty texts have 0 tokens; repeated rows are documents of their own; other columns, whatever their names, are
    not read; an empty table gives no rows. The histogram, one row per length, is written once and read for both the
    blocks and the rows, so every text is encoded once.
    """
    return with_suffix_sums(table(length_histogram(bpe.count_tokens(docs, path, text_col)), "token-histogram"))
