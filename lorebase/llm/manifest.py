"""Merkle manifest of a dataset: a postorder append log that aligned builders write, and proofs read from it.

A tree over n leaves has ceil(n / 2**l) nodes on level l; every two consecutive ones, or a last one alone, become
their digest. Builders take aligned blocks of ``2**LEVELS`` leaves, so a block's own tree is a subtree of the whole one, and
append its nodes as they are completed: leaves in order, and each parent right after its last child. A node's place
in such a log follows from the sizes of the complete subtrees before it, so no index is written. The roots of the
blocks are the leaves of the next stage, until one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import frugal, n_partitions
from lorebase.workers import ship, stored

#: Levels of a builder's block: 1,024 leaves, whose log has 131 KB.
LEVELS = 10
#: Characters of a digest.
HEX = 64


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields in order."""
    return F.sha2(F.concat(*map(field, values)), 256)


def position(level: int, i: int, n: int) -> int:
    """Place of node ``i`` of a level in the log of a tree over ``n`` leaves.

    Before a node come all nodes completed up to its last leaf j: one per leaf and per pair, quadruple ... of leaves
    before j, which is 2j less the ones in j's binary form; then the nodes that j itself completed below it.
    """
    last = min((i + 1) << level, n) - 1
    return 2 * last - last.bit_count() + level


def height(n: int, most: int) -> int:
    """Levels that a builder adds to its leaves: ``most`` where the tree goes on in other blocks."""
    return min((n - 1).bit_length(), most)


def append(leaves: list[str], levels: int) -> list[str]:
    """The log of one block: nodes in order of completion."""
    log: list[str] = []
    n = len(leaves)
    for j, one in enumerate(leaves):
        log.append(one)
        level, i = 0, j
        while level < levels and (i & 1 or j == n - 1):
            log.append(digest(log[position(level, i - 1, n)], log[-1]) if i & 1 else digest(log[-1]))
            level, i = level + 1, i >> 1
    return log


def path(log: str, i: int, n: int, levels: int) -> list[str]:
    """A leaf's siblings upwards, read from a block's log at their closed-form places.

    Each step is ``L`` or ``R`` (the sibling's side) and its digest; the empty step stands for a node alone.
    """
    out = []
    for level in range(levels):
        other = i ^ 1
        if other << level < n:
            at = position(level, other, n) * HEX
            out.append(("L" if i & 1 else "R") + log[at : at + HEX])
        else:
            out.append("")
        i >>= 1
    return out


def fold(value: str, steps: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in steps:
        value = digest(step[1:], value) if step[:1] == "L" else digest(value, step[1:])
    return value


def numbered(rows: DataFrame, order: list[str], what: str) -> DataFrame:
    """``rows`` with ``at``, the place in its tree by ``order`` from 0, and ``n``, the tree's rows.

    Rows are ranged by tree and order, so a tree of any size is spread; places come from each range's own numbers and
    the counts of the ranges before it. The ranged rows are written: places can't move when a task is repeated.
    """
    ranged = rows.repartitionByRange(n_partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), what)
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    runs = runs.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(runs, ["tree", "_part"]).withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


SEGMENT = "tree string, block long, n long, log string"


def build_logs(leaves: DataFrame, what: str, levels: int) -> list[DataFrame]:
    """The log of all trees, a table of segments for each stage; ``leaves`` has tree, at, n and hash.

    A segment is what one builder wrote: tree, block, n (the tree's leaves at this stage), log. Each stage has one row for
    ``2**levels`` of the one below.
    """
    ship(leaves.sparkSession)
    size = 1 << levels

    def builder(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        log = "".join(append(block["hash"].to_pylist(), height(block["n"][0].as_py(), levels)))
        return pa.table({"tree": block["tree"][:1], "block": block["block"][:1], "n": block["n"][:1], "log": pa.array([log])})

    stages: list[DataFrame] = []
    while True:
        blocks = leaves.select("tree", F.shiftright("at", levels).alias("block"), "at", "n", "hash")
        stages.append(stored(blocks.groupBy("tree", "block").applyInArrow(builder, SEGMENT), f"{what}-log{len(stages)}"))
        most = stages[-1].agg(F.max("n")).first()[0]
        if most is None or most <= size:
            return stages
        leaves = stages[-1].where(F.col("n") > size).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).alias("n"), F.right("log", F.lit(HEX)).alias("hash"))


def tree_roots(stages: list[DataFrame], levels: int) -> DataFrame:
    """tree and hash of every tree's root: the last node of its only segment of a stage."""
    ends = [s.where(F.col("n") <= 1 << levels).select("tree", F.right("log", F.lit(HEX)).alias("hash")) for s in stages]
    return reduce(DataFrame.union, ends)


def unit_paths(segments: DataFrame, levels: int) -> DataFrame:
    """A row for each leaf of the segments: tree, block (the leaf's number), steps (its siblings inside and those above), subroot."""
    size = 1 << levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * size
                n = min(size, row["n"] - first)
                paths = [path(row["log"], i, n, height(row["n"], levels)) + row["steps"] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array(paths, pa.list_(pa.string())), pa.array([row["subroot"]] * n, pa.string())], ["tree", "block", "steps", "subroot"])

    return segments.mapInArrow(frugal(run), "tree string, block long, steps array<string>, subroot string")


def segments_with_steps(stages: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """The first stage's segments with the siblings above each, from the last stage down.

    ``ends`` has, for each tree, ``steps`` above its root and ``subroot``. Each stage is joined with the one above by block,
    one row a segment.
    """
    columns, found = ["tree", "block", "n", "log", "steps", "subroot"], None
    for segments in reversed(stages):
        here = segments.where(F.col("n") <= 1 << levels).join(ends, "tree").select(columns)
        if found is not None:
            here = here.union(segments.where(F.col("n") > 1 << levels).join(unit_paths(found, levels), ["tree", "block"]).select(columns))
        found = here
    return found


@dataclass
class Manifest:
    """Leaves (tree, at, n, hash and the rows' other columns), the logs of their trees and of the tree of subroots."""

    leaves: DataFrame
    logs: list[DataFrame]
    top_logs: list[DataFrame]
    subroots: DataFrame
    root: str | None
    levels: int


def build(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> Manifest:
    """Numbers ``leaves`` (tree, hash, other columns) in each tree by ``order`` and writes the logs.

    Trees are ordered by their name's bytes. Only the root, one digest, comes to the driver; it is null for no leaves.
    """
    leaves = numbered(leaves, order, "manifest-leaves")
    logs = build_logs(leaves, "manifest", levels)
    subroots = numbered(tree_roots(logs, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"], "manifest-subroots")
    top_logs = build_logs(subroots, "manifest-top", levels)
    root = tree_roots(top_logs, levels).first()
    return Manifest(leaves, logs, top_logs, subroots, root and root["hash"], levels)


def _prover(root: str | None, kind: pa.DataType, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    size = 1 << most

    def run(docs: pa.Table, segments: pa.Table) -> pa.Table:
        segment = segments.to_pylist()[0]
        n, levels = segment["n"], height(segment["n"], most)
        inside = min(size, n - segment["block"] * size)
        reached: dict[str, str] = {}  # the root that a block's root leads to
        proofs, folded = [], []
        for i, trial in zip(docs["at"].to_pylist(), docs["trial"].to_pylist(), strict=True):
            steps = path(segment["log"], i % size, inside, levels)
            proofs.append(digest(*(s[1:] for s in steps), *(s[1:] for s in segment["steps"])))
            top = fold(trial, steps)
            if top not in reached:
                reached[top] = fold(top, segment["steps"])
            folded.append(reached[top])
        rows = len(proofs)
        return pa.table(
            {
                "doc_id": docs["doc_id"].cast(kind), "leaf": docs["hash"], "subroot": pa.array([segment["subroot"]] * rows), "root": pa.array([root] * rows, pa.string()),
                "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded]),
            }
        )

    return run


def prove(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf, whose ``trial`` digest is folded.

    A segment meets the leaves of its block, ``2**levels`` at most, in one group; siblings are read from its log and from the few
    steps above it.
    """
    levels = manifest.levels
    none = manifest.subroots.sparkSession.createDataFrame([("", [], "")], "tree string, steps array<string>, subroot string")
    paths = unit_paths(segments_with_steps(manifest.top_logs, none, levels), levels)
    ends = manifest.subroots.select("name", "hash", F.col("at").alias("block")).join(paths.select("block", "steps"), "block")
    segments = segments_with_steps(manifest.logs, ends.select(F.col("name").alias("tree"), "steps", F.col("hash").alias("subroot")), levels)
    docs = manifest.leaves.select("tree", F.shiftright("at", levels).alias("block"), "at", "doc_id", "hash", "trial")
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = _prover(manifest.root, pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64(), levels)
    shape = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInArrow(run, shape)


def tampered_proofs(docs: DataFrame, every: int = 7, levels: int = LEVELS) -> DataFrame:
    """A manifest of ``docs`` (doc_id, source, lang, n_chars, text), a tree for each lang, and what its proofs say of tampered rows.

    Tampering adds 1 to n_chars where ``every`` divides the crc32 of the decimal doc_id. Null fields are part of a leaf like
    any (a null n_chars can't be tampered with, nor a row without id); rows of one lang and id are ordered by their
    leaves; repeated rows are leaves of their own; other columns are left out; an empty table gives no rows.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    changed = leaf(*own[:3], F.col("n_chars") + 1, own[4])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), "doc_id", leaf(*own).alias("hash"), F.when(hit, changed).alias("trial")
    ).withColumn("trial", F.coalesce("trial", "hash"))
    return prove(build(rows.withColumn("salt", F.monotonically_increasing_id()), ["doc_id", "hash", "salt"], levels))
