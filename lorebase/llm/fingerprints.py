"""Document fingerprints: SimHash votes and permuted block tables, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import SPACE, n_partitions, table

BITS = 64
#: Terms per block of votes: a counter has 16 bits, four counters share a long.
BLOCK = 65_535
#: One bit in each of the four counters.
LANES = 0x0001000100010001


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the 64-bit SimHash of column ``text`` as long column ``name``.

    Terms are lower-cased words together with the word before them; a term weighs as often as it occurs. Each
    term's 64-bit hash votes +1 or -1 on every bit, and a bit is set when its votes are above zero. Texts
    without words, and null, give 0. All words vote: long texts are counted in blocks of 65,535 terms, since
    the 64 counters of a block are packed four to a long.
    """
    words, terms, blocks = f"{name}_words", f"{name}_terms", f"{name}_blocks"
    split = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")
    df = df.withColumn(words, split)
    df = df.withColumn(terms, F.transform(F.col(words), lambda w, i: F.xxhash64(w, F.get(F.col(words), i - 1)))).drop(words)

    def add(shift: int):
        return lambda a, h: a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(LANES))

    def votes(part: Column) -> Column:
        return F.array(*(F.aggregate(part, F.lit(0).cast("long"), add(i)) for i in range(16)))

    starts = F.sequence(F.lit(0), F.greatest(F.size(terms) - 1, F.lit(0)), F.lit(BLOCK))
    df = df.withColumn(blocks, F.transform(starts, lambda s: votes(F.slice(F.col(terms), s + 1, F.lit(BLOCK)))))
    n = F.size(terms)

    def count(bit: int) -> Column:
        lane, packed = divmod(bit, 16)
        return F.aggregate(F.col(blocks), F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(F.element_at(x, packed + 1), 16 * lane).bitwiseAND(F.lit(0xFFFF)))

    value = F.lit(0).cast("long")
    for bit in range(BITS):
        value = value.bitwiseOR(F.when(count(bit) * 2 > n, F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.withColumn(name, value).drop(terms, blocks)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _buckets(docs: DataFrame, n: int) -> Column:
    """Number of the range of doc_id that a row is in: n ranges with about as many rows each, nulls in the last."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    cuts = F.array(*(F.lit(int(x)) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    inside = F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(inside)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", search_every: int | None = None, radius: int = 3) -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter taken from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the next in order of id (null ids last, equal ids in order of their text, repeated rows one
    after the other), after the last the first; one document is its own next. Null texts count as empty; an
    empty text has fingerprint 0. An empty table gives no rows; other columns are left out.

    No task sees all rows: ids are cut into ranges of about equal row counts, the next document is found
    inside a range, and the last row of a range takes the first row of the following one from a table of one
    row per range. That table is joined on the ranges' own partitioning, so texts are shuffled once.

    With ``search_every``, n_near follows: for ids that it divides the number of other documents whose fingerprint is at
    most ``radius`` bits from theirs, as the block tables find them; null for other ids and null ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("part", _buckets(docs, 4 * n_partitions(spark)))
    firsts = docs.groupBy("part").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("part", "first_part")
    heads = docs.join(F.broadcast(firsts), (F.col("part") == F.col("first_part")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("part").agg(F.min("text").alias("head"))  # one row per range: a size this sets itself
    heads = table(with_fingerprint(heads, "head", "head_fp"), "fingerprint-heads")
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("part"), *(F.coalesce(F.lead(c).over(along), F.first(c).over(whole)).alias(f"{c}_next") for c in ("head", "head_fp")))

    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    out = docs.withColumn("n", F.row_number().over(inside)).withColumn("next_text", F.lead("text").over(inside)).join(heads.hint("merge"), "part")
    out = out.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    kept, added = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring(F.coalesce("next_text", "head_next"), F.lit(1), F.col("cut"))
    out = out.select("part", "doc_id", "n", "n_chars", "text", "head_fp_next", F.concat(kept, added).alias("edited"))
    out = out.withColumn("edited_sha256", F.sha2("edited", 256))
    out = with_fingerprint(with_fingerprint(out, "text", "fp"), "edited", "efp").drop("text", "edited")
    after = Window.partitionBy("part").orderBy("n")
    out = out.withColumn("next_fp", F.coalesce(F.lead("fp").over(after), F.col("head_fp_next")))
    more = []
    if search_every:
        out = _with_near(table(out.select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "next_fp"), "fingerprints"), search_every, radius)
        more = ["n_near"]
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), *more,
    )


def _with_near(found: DataFrame, every: int, radius: int) -> DataFrame:
    """Adds n_near to the written rows (doc_id, fp, ...). Documents are counted by fingerprint first, so copies don't multiply pairs, and only the asking rows are joined."""
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = table(found.groupBy("fp").agg(F.count("*").alias("n"), F.max(asks).alias("asks")), "fingerprint-counts")
    pairs = within_radius(counts.where("asks"), counts, radius)
    others = pairs.join(counts.select(F.col("fp").alias("stored_fp"), "n").hint("merge"), "stored_fp").groupBy(F.col("query_fp").alias("fp")).agg(F.sum("n").alias("others"))
    near = table(counts.where("asks").join(others, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")), "fingerprint-near")
    return found.where(asks).join(near.hint("merge"), "fp").unionByName(found.where(~asks).withColumn("n_near", F.lit(None).cast("long")))


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (query, stored) pairs of different fingerprints (long column ``fp``) at most ``radius`` bits apart.

    Returns query_fp, stored_fp, distance, one row per pair of distinct values; join them back to ids to get
    documents, so copies never multiply. Nulls match nothing; an empty side gives no rows.

    Two fingerprints within the radius agree on at least ``blocks - radius`` of the blocks, so each choice of
    that many blocks is one table: its key is those blocks' bits moved to the front. Both sides go into all
    tables, meet by equal keys, and are compared there; a pair that meets in several tables counts in the first. More
    blocks make longer keys and more tables.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << b) for i in kept for b in range(edges[i], edges[i + 1])) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fp").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)))
        return one.select(name, F.explode(keys).alias("k")).select(name, "k.t", "k.key")

    pairs = tables(queries, "query_fp").join(tables(stored, "stored_fp").hint("merge"), ["t", "key"])
    differ = F.col("query_fp").bitwiseXOR(F.col("stored_fp"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(signed)))
    far = F.bit_count(differ)
    return pairs.where((F.col("query_fp") != F.col("stored_fp")) & (far <= radius) & (F.col("t") == first)).select("query_fp", "stored_fp", far.alias("distance"))
