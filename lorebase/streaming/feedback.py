"""Streaming forms of the feedback operators. Rows later than the watermark are dropped."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorebase.operators.feedback import badcase_upsert, latency_sketches, request_log_upsert
from lorebase.workers import ship

#: Tables of an upsert stream and how they fold events.
_STATES = {
    "badcase": (badcase_upsert, "question string, reason string, hit_count long, answer string, sources string, model string, note string, created_at timestamp, updated_at timestamp"),
    "request": (request_log_upsert, "question string, hit_count long, note string, suggestions array<string>, domain string, created_at timestamp, updated_at timestamp"),
}
#: A row for each committed version: the stream (by its checkpoint's identity), its batch, and the folder of the table.
_LEDGER = "version long, stream string, batch long, slot int"
#: Folders that versions take in turn; a reader of the newest one is safe for as many commits less one.
SLOTS = 3


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is under ``path``, or no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, path: str) -> tuple[int, int]:
    last = _rows(spark, f"{path}/ledger", _LEDGER).agg(F.max(F.struct("version", "slot")).alias("m")).first()["m"]
    return (last["version"], last["slot"]) if last else (0, -1)


def read_upserts(spark: SparkSession, path: str, kind: str = "badcase") -> DataFrame:
    """The newest committed table of an ``upsert_stream``; no rows before the first commit."""
    schema = _STATES[kind][1]
    version, slot = _newest(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/table{slot}") if version else spark.createDataFrame([], schema)


def upsert_stream(events: DataFrame, path: str, checkpoint: str, kind: str = "badcase") -> StreamingQuery:
    """F1, F2: folds each micro-batch into the table under ``path``, which ``read_upserts`` reads.

    A batch folds into the newest version that the ledger lists, whichever stream wrote it, writes the next one and then adds a row
    to the ledger with its number and the identity of its checkpoint. So a new checkpoint goes on from the newest version,
    a batch that failed before its row is done again from the same version, and one that failed after it is left out.
    One stream at a time may write under a path.
    """
    fold, schema = _STATES[kind]
    spark = events.sparkSession
    spark.createDataFrame([(uuid.uuid4().hex,)], "stream string").coalesce(1).write.mode("ignore").parquet(f"{checkpoint}/upserts")
    stream = spark.read.schema("stream string").parquet(f"{checkpoint}/upserts").first()["stream"]

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ledger = _rows(session, f"{path}/ledger", _LEDGER)
        if not ledger.where((F.col("stream") == stream) & (F.col("batch") == number)).isEmpty():
            return
        version = _newest(session, path)[0] + 1
        state = read_upserts(session, path, kind)
        fold(state, batch).select(*state.columns).write.mode("overwrite").parquet(f"{path}/table{version % SLOTS}")
        session.createDataFrame([(version, stream, number, version % SLOTS)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(events: DataFrame, gap: str = "24 hours", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """closed sessions of each key."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Answers(StatefulProcessor):
    """The time of a key's stored answer, and its events until the watermark has passed them."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at_us bigint")
        self.waiting = handle.getListState("waiting", "at_us bigint, event_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803, ARG002
        times = set()
        for frame in rows:
            for at, event in zip(frame["at_us"].tolist(), frame["event_id"].tolist(), strict=True):
                self.waiting.appendValue((at, event))
                times.add(-(-at // 1000))
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803, ARG002
        """Judges all events up to the watermark in their order; none can come before them any more."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= passed]
        stored = self.stored.get()
        at = stored[0] if stored else None
        hits = []
        for t, _ in due:
            hits.append(at is not None and t - at <= self.ttl_us)
            if not hits[-1]:
                at = t
        if due:
            self.waiting.put(rows[len(due) :]) if len(rows) > len(due) else self.waiting.clear()
            self.stored.update((at,))
            self.handle.registerTimer((at + self.ttl_us) // 1000 + 1)
        elif at is not None and at + self.ttl_us < passed and not rows:
            self.stored.clear()
        if due:
            yield pd.DataFrame({"key": [key[0]] * len(due), "event_id": [r[1] for r in due], "hit": hits})

    def close(self) -> None:
        pass


def question_stream(events: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """F8: key, event_id, hit, as ``dedupe_questions`` gives them in batch: the same key within the time to live of the answer stored last.

    events(key, event_id, ts). Each key keeps its stored answer's time and the events that the watermark has not passed; they are judged
    in order of time when it does, so events may come in any order within ``late``. A timer drops a key whose answer has
    expired. Events without a key or time are left out. Keeps its state in RocksDB, which this sets for the session.
    """
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = events.where("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    kind = events.schema["key"].dataType.simpleString()
    slim = e.select("key", F.col("event_id").cast("bigint").alias("event_id"), "ts", F.unix_micros("ts").alias("at_us"))
    return slim.groupBy("key").transformWithStateInPandas(_Answers(ttl_seconds * 1_000_000), f"key {kind}, event_id bigint, hit boolean", "Append", "EventTime")


def fresh_questions(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first event of each key within a watermark of ``ttl``: cheaper than ``question_stream``, and another rule, since a repetition prolongs nothing and late events count."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def latency_stream(log: DataFrame, window: str = "5 minutes", late: str = "1 minute", slow_ms: float = 1000.0, k: int = 400) -> DataFrame:
    """per path and tumbling window the rows of ``latency_sketches``, which ``merged_latency`` joins to longer spans."""
    return latency_sketches(log.withWatermark("ts", late), window, slow_ms, k)
