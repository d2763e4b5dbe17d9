"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import ROW, table, word_count

#: Hash ranges a source is cut into, so that its running sum never needs all of its documents in one task.
RANGE_BITS = 10


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, total_share: float = 1.0) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): source, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn and share ``total_share`` of all sizes. A
    target stops at ``max_epochs`` times its source's size, and the excess is shared again by weight until no
    target is above. That fixed point is found in one sorted pass: a source is clamped when the level all
    sources before it leave (what remains over the weights that remain) reaches its own cap over weight.

    The windows run over one row per source. No sources: no rows; all sizes 0: all targets 0.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    out = out.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    out = out.withColumn("level", F.first(free, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("source", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _range(h):
    return F.shiftrightunsigned(h, 64 - RANGE_BITS)


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, total_share: float = 1.0) -> DataFrame:
    """What each source's documents are taken: source, source_size, target, whole, cut_range, cut_hash.

    ``sized`` has (source, size, h), h a seeded hash of the document. Every document is repeated ``whole``
    times; the fraction left goes to the documents first in hash order, up to the words it stands for. The
    order's running sum is cut in two steps: sums by hash range (rows: sources x 1024), then the documents of
    the one range that holds the cut. So a source's taken words miss the target by half a document at most.
    """
    by_range = table(sized.groupBy("source", _range("h").alias("range")).agg(F.sum("size").alias("size")), "mix-ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, total_share)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(epochs).cast("int"))
    goal = table(goal.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("range"))
    ranges = by_range.withColumnRenamed("source", "s").withColumn("upto", upto)
    cut = ranges.join(goal, F.col("s").eqNullSafe(F.col("source"))).where((F.col("want") > 0) & (F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("size") < F.col("want")))
    cut = table(cut.select(F.col("s"), F.col("range").alias("cut_range"), (F.col("want") - F.col("upto") + F.col("size")).alias("need")), "mix-cuts")
    inside = sized.join(cut, F.col("source").eqNullSafe(F.col("s")) & (_range("h") == F.col("cut_range"))).groupBy("s", "need", "h").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("h"))
    inside = inside.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("need")).groupBy("s").agg(F.max("h").alias("cut_hash"))
    named = cut.select(F.col("s").alias("cut_source"), "cut_range")
    out = goal.join(named, F.col("source").eqNullSafe(F.col("cut_source")), "left").join(inside, F.col("source").eqNullSafe(F.col("s")), "left")
    return table(out.select("source", "source_size", "target", "whole", "cut_range", "cut_hash"), "mix-plan")


def _repeats():
    """Whole repetitions, and one more before the cut."""
    extra = (_range("h") < F.col("cut_range")) | ((_range("h") == F.col("cut_range")) & (F.col("h") <= F.col("cut_hash")))
    return F.col("whole") + F.coalesce(extra.cast("int"), F.lit(0))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, source, repeats.

    size is the number of words between white space. Null or empty texts have size 0 and take nothing from a
    target; a null source is a source of its own, last in order; null ids are documents like any other;
    repeated rows are taken alike. An empty table gives no rows. Other columns of ``docs`` are left out.

    The texts are read once; what follows runs on (id, source, size, hash). The plan is a written table with
    one row per source: Spark broadcasts it while it is small and else joins by sorted runs, which split a
    hot source.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    slim = table(slim, "mix-sizes")
    chosen = plan(slim, weights, max_epochs).withColumnRenamed("source", "plan_source")
    out = slim.join(chosen, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("repeats", _repeats())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, all their columns, each as often as the mix takes it.

    Same decisions as ``mix_sizes``; a document taken 0 times is left out.
    """
    keyed = docs.select(F.struct("*").alias(ROW), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    slim = table(docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")), "mix-sizes")
    chosen = plan(slim, weights, max_epochs).withColumnRenamed("source", "plan_source")
    out = keyed.join(chosen, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("repeats", _repeats()).where("repeats > 0")
    return out.select(ROW, F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("repeat")).select(f"{ROW}.*")
