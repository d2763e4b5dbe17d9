"""Search of many queries over many passages, block by block, with the best rows of each query kept in the tasks."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.workers import ship, stored

#: Rows and bytes of a block, prepared query blocks that a task keeps, and best rows that it holds before it passes them on.
ROWS, BYTES, PREPARED, HELD = 1024, 4 << 20, 8, 1 << 20


def pack(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """block (a number) and data (an Arrow stream of about ``rows`` rows or ``BYTES`` at most); nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            each = max(1, min(rows, int(batch.num_rows * BYTES / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, each):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, each))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])
                number += 1

    ship(df.sparkSession)
    return df.mapInArrow(run, "block long, data binary")


def unpack(data: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(data.as_buffer()) as stream:
        return stream.read_next_batch()


def owned(column: pa.Array) -> pa.Array:
    """A copy of a column. What is read from a stream is a view, which holds the whole batch of pairs (64 MB) that it came with."""
    return column.take(pa.array(np.arange(len(column))))


def in_bytes(setting: str) -> int:
    """A size as Spark's settings give it: a number, with or without a unit (b, k, kb, m, ...)."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


class Kernel:
    """What a search does with a pair of blocks. Rows are arrays of equal length: the query's place in its block, score, id, more."""

    def prepare(self, queries: pa.RecordBatch) -> object:
        raise NotImplementedError

    def found(self, asked: object, passages: pa.RecordBatch, floor: np.ndarray) -> list[np.ndarray]:
        """Rows that score at least the ``floor`` of their query."""
        raise NotImplementedError

    def best(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that may be among the results, and which of them are the last of their query's full number."""
        raise NotImplementedError

    def output(self, ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        raise NotImplementedError


def best_rows(rows: list[np.ndarray], most: int, groups: np.ndarray | None = None, cap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` rows of each query by score, then id, of which a group (of the query) gives ``cap`` at most."""
    query, score, ids = rows[:3]
    order = np.lexsort((ids, -score, query))
    if groups is not None:
        inner = np.lexsort((ids, -score, groups, query))
        fits = np.zeros(len(query), bool)
        fits[inner[_rank(query[inner], groups[inner]) < cap]] = True
        order = order[fits[order]]
    rank = _rank(query[order])
    return order[rank < most], rank[rank < most] == most - 1


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in its stretch of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.r_[starts, len(new)]))


def search(queries: DataFrame, passages: DataFrame, kernel: Callable[[], Kernel], shape: str) -> DataFrame:
    """Each task's best rows of every query, for any number of queries in one scan of the passages.

    Both sides are packed and met by an equi-join of lanes: query blocks of few bytes (Spark's own broadcast threshold) have one
    lane and are sent to the passages; larger ones are repeated in as many lanes as there are shuffle partitions,
    over which the passages are dealt. A task keeps the best rows that it has seen, and what ranks below them goes no further.
    """
    spark = passages.sparkSession
    asked = stored(pack(queries), "query-blocks").withColumnsRenamed({"block": "q_block", "data": "q_data"})
    size = asked.agg(F.sum(F.length("q_data"))).first()[0] or 0
    few = size <= in_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    lanes = 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes))
    sides = asked.withColumn("lane", F.pmod("q_block", F.lit(1))) if few else asked.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    pairs = pack(passages).withColumn("lane", lane.cast("long")).join(F.broadcast(sides) if few else sides, "lane").select("q_block", "q_data", "block", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        prepared: OrderedDict[int, object] = OrderedDict()
        ids: dict[int, pa.Array] = {}
        held: dict[int, list[np.ndarray]] = {}
        floors: dict[int, np.ndarray] = {}

        def put(block: int, rows: list[np.ndarray]) -> None:
            if block in held:
                rows = [np.concatenate(pair) for pair in zip(held[block], rows, strict=True)]
            keep, last = work.best(rows)
            held[block] = [r[keep] for r in rows]
            floors[block][rows[0][keep[last]]] = rows[1][keep[last]]

        for batch in batches:
            number, passage = None, None
            for block, q_data, mine, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if block not in prepared:
                    asked_batch = unpack(q_data)
                    prepared[block] = work.prepare(asked_batch)
                    if block not in ids:
                        ids[block] = owned(asked_batch.column(0))
                    floors.setdefault(block, np.full(asked_batch.num_rows, -np.inf))
                    if len(prepared) > PREPARED:
                        prepared.popitem(last=False)
                prepared.move_to_end(block)
                if mine != number:
                    number, passage = mine, unpack(data)
                rows = work.found(prepared[block], passage, floors[block])
                if len(rows[0]):
                    put(block, rows)
            if sum(len(r[0]) for r in held.values()) > HELD:
                yield from (work.output(ids[b], r) for b, r in held.items())
                held = {}
        yield from (work.output(ids[b], r) for b, r in held.items())

    return pairs.mapInArrow(run, shape)
