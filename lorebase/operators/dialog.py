"""C: conversations as rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.common import top


def _in_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def _before():
    return _in_turn().rowsBetween(Window.unboundedPreceding, -1)


def followup_query(turns: DataFrame) -> DataFrame:
    """conv_id, turn, query of each user turn: up to two earlier user turns of different text, and the turn."""
    users = turns.where("role = 'user'").withColumn("_before", F.collect_list("text").over(_before()))
    other = F.filter("_before", lambda t: t != F.col("text"))
    last = F.slice(other, F.greatest(F.size(other) - 1, F.lit(1)), F.lit(2))
    return users.select("conv_id", "turn", F.array_join(F.concat(last, F.array("text")), " ").alias("query"))


def compact_history(turns: DataFrame, budget: int = 2000, cut: int = 200) -> DataFrame:
    """The newest turns whose texts, assistant ones cut to ``cut`` characters and "…", fit the budget; the walk back ends at the first that does not."""
    text = F.when((F.col("role") == "assistant") & (F.length("text") > cut), F.concat(F.left("text", F.lit(cut)), F.lit("…"))).otherwise(F.col("text"))
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("text", text).withColumn("used", F.sum(F.length("text")).over(back)).where(F.col("used") <= budget)


def trim_sessions(turns: DataFrame, n: int = 60) -> DataFrame:
    """Last n turns of every conversation."""
    return top(turns, ["conv_id"], [F.col("turn").desc()], n)


def round_no(turns: DataFrame) -> DataFrame:
    """C4: adds round: half of the turns before, rounded down, plus one."""
    return turns.withColumn("round", (F.floor((F.row_number().over(_in_turn()) - 1) / 2) + 1).cast("int"))


def multi_turn_samples(turns: DataFrame) -> DataFrame:
    """conv_id, turn, history, input, output of each user turn that an assistant turn follows."""
    said = turns.withColumn("_h", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(_before())).withColumn("_next", F.lead(F.struct("role", "text")).over(_in_turn()))
    return said.where("role = 'user' AND _next.role = 'assistant'").select("conv_id", "turn", F.col("_h").alias("history"), F.col("text").alias("input"), F.col("_next.text").alias("output"))
