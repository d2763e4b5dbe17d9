"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lorebase.functions.text import pieces
from lorebase.workers import stored


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group, numbered as ``rank`` if asked; Spark prunes groups before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def small(df: DataFrame) -> DataFrame:
    """A join's lesser side, computed once and written, so that Spark knows its bytes and sends it to all tasks if they are few."""
    return stored(df, "side")


def seeded(seed: int, column: str) -> Column:
    """A hash of a column's text with a seed, to order or draw rows by; null for null."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` dealt in ranges of group and order, written, with ``_part`` (the range) and ``_id`` (grows along the order).

    A group of any size is spread over ranges. They are written once, since Spark finds them by sampling.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    return stored(out.withColumn("_part", F.shiftright("_id", 33)), "ranged")


def before(df: DataFrame, group: Sequence[str], what: Column, how: Callable[[Column], Column]) -> DataFrame:
    """For each range and group of a ``ranged`` table ``_before``: the aggregate ``how`` of ``what`` over the group's earlier ranges.

    One row for a range of a group is kept, so the window is as long as there are ranges.
    """
    per = df.groupBy(*group, "_part").agg(how(what).alias("_own"), F.min("_id").alias("_first"))
    along = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_before", (F.sum if how is F.count else how)("_own").over(along)).drop("_own")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its group by ``order``, from 0, whatever the size of a group; group columns are not null."""
    dealt = ranged(df, group, order)
    starts = before(dealt, group, F.lit(1), F.count)
    out = dealt.join(starts, [*group, "_part"])
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")


#: Bytes of text that a row of joined texts may hold, and a row more.
PART_BYTES = 8 << 20


def part_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], size: Column, budget: int = PART_BYTES) -> DataFrame:
    """``df`` with ``part_no``: how many times ``budget`` goes into the sizes of the group's earlier rows by ``order``, and ``_id``, which grows along it.

    Rows of one part so have at most the budget and a row more. Running sums go over ranges of rows, so a group of any size is
    spread; a row above the budget leaves numbers out. Rows of a null group are left out.
    """
    rows = df.where(F.lit(True) if not group else reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in group)))
    dealt = ranged(rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))), group, order)
    starts = before(dealt, group, F.col("_size"), F.sum).drop("_first")
    own = F.sum("_size").over(Window.partitionBy("_part", *group).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    at = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return dealt.withColumn("_own", own).join(starts, [*group, "_part"]).withColumn("part_no", F.floor(at / budget)).drop("_part", "_size", "_own", "_before")


#: Bytes of words up to which every task gets them all.
AUTOMATON_BYTES = 8 << 20
#: Hits that a task holds before it passes them on.
HITS = 1 << 16
#: Characters of a word's signature.
GRAM = 3


def contains_pairs(texts: DataFrame, text: str, words: DataFrame, word: str, key: Sequence[str], most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Pairs of rows whose lower-cased ``text`` contains the lower-cased ``word``: the columns ``key`` of the text's row and those of the word's.

    Distinct words of ``most_bytes`` or less go to all tasks, which search each text once for all of them (Aho-Corasick), so
    nothing but the pairs is shuffled. More words meet the texts by their rarest gram (``by_signature``). Null and empty
    words and null texts meet nothing; repeated rows of either side give repeated pairs.
    """
    listed = small(words.select(F.lower(F.col(word)).alias("_word")).where(F.length("_word") > 0).distinct())
    size = listed.agg(F.sum(F.octet_length("_word"))).first()[0] or 0
    slim = texts.select(*key, F.lower(F.col(text)).alias("_text")).where(F.col("_text").isNotNull())
    found = by_automaton(slim, [r["_word"] for r in listed.collect()]) if size <= most_bytes else by_signature(slim, listed)
    keyed = words.withColumn("_word", F.lower(F.col(word)))
    return found.join(keyed, "_word").drop("_word")


def first_texts(texts: DataFrame, text: str, words: DataFrame, word: str, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows of ``words`` with the columns ``key`` of the first ``k`` distinct rows by ``order`` whose text contains the word; any case.

    What a query finds first by any of its words is among the first of one of them. Each distinct word is so searched and ranked once, whatever
    the number of its rows, and a word that all texts contain gives k rows to each.
    """
    lowered = F.lower(F.col(word)).alias("_lower")
    pairs = contains_pairs(texts, text, words.select(lowered).distinct(), "_lower", key).distinct()
    return words.withColumn("_lower", F.lower(F.col(word))).join(top(pairs, ["_lower"], order, k), "_lower").drop("_lower")


def by_automaton(texts: DataFrame, words: list[str]) -> DataFrame:
    """Columns of ``texts`` but _text, and _word, for each of ``words`` in a text; one pass over the texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(words)
    kept = [f for f in texts.schema.fields if f.name != "_text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            slim = batch.select(names)  # hits repeat a row's key, never its text
            rows, hits = [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index("_text"))):
                found = {w for _, w in automaton.iter(t.as_py())}
                rows += [i] * len(found)
                hits += found
                if len(rows) >= HITS:
                    part = slim.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.string())], [*names, "_word"])
                    rows, hits = [], []
            if rows:
                part = slim.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.string())], [*names, "_word"])

    return texts.mapInArrow(run, StructType([*kept, StructField("_word", StringType())]))


def by_signature(texts: DataFrame, words: DataFrame) -> DataFrame:
    """As ``by_automaton`` for a table of words of any size.

    A word's signature is the gram of it that fewest texts hold, counted over all texts; a gram has three characters, or is the
    word if that is shorter. Keys of texts meet signatures by their grams; texts are fetched once, for the keys that met.
    """
    keys = [F.col(c) for c in texts.columns if c != "_text"]
    grams = F.array_distinct(F.concat(*(pieces(F.col("_text"), n) for n in range(1, GRAM + 1))))
    own = words.select("_word", F.explode(F.when(F.length("_word") >= GRAM, F.array_distinct(pieces(F.col("_word"), GRAM))).otherwise(F.array("_word"))).alias("_gram"))
    own = small(own)
    numbered = texts.select(F.struct(*keys).alias("_key"), "_text")
    held = numbered.select("_key", F.explode(grams).alias("_gram")).join(small(own.select("_gram").distinct()), "_gram", "left_semi")
    held = stored(held, "grams")
    rare = own.join(held.groupBy("_gram").agg(F.count("*").alias("_n")), "_gram").groupBy("_word").agg(F.min(F.struct("_n", "_gram")).alias("_least")).select("_word", F.col("_least._gram").alias("_gram"))
    near = held.join(rare, "_gram").select("_key", "_word").distinct()
    sure = numbered.join(near, numbered["_key"].eqNullSafe(near["_key"])).where(F.contains("_text", F.col("_word"))).select(numbered["_key"], "_word")
    return sure.select("_key.*", "_word")
