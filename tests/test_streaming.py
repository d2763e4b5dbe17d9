"""Streams against their batch operators: restarts, replays, events out of order, quantiles within their bound."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import feedback
from lorebase.streaming import feedback as streams

EVENT = "question string, reason string, answer string, sources array<string>, model string, note string, ts timestamp"


def badcases(spark, answer: str, minute: int):
    return spark.sql(f"SELECT 'q' AS question, 'weak_hit' AS reason, '{answer}' AS answer, array('s') AS sources, 'm' AS model, 'n' AS note, timestamp'2024-01-01 00:{minute:02}:00' AS ts")


def test_a_new_checkpoint_goes_on_from_the_newest_version(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert streams.read_upserts(spark, out).collect() == []
    badcases(spark, "a", 1).write.parquet(src)
    for checkpoint in ("one", "two", "two"):  # the last one has nothing new
        streams.upsert_stream(spark.readStream.schema(EVENT).parquet(src), out, str(tmp_path / checkpoint)).awaitTermination()
    assert [(r.hit_count, r.answer) for r in streams.read_upserts(spark, out).collect()] == [(2, "a")]
    for i in range(4):  # more versions than folders
        badcases(spark, f"b{i}", 2 + i).write.mode("append").parquet(src)
        streams.upsert_stream(spark.readStream.schema(EVENT).parquet(src), out, str(tmp_path / "two")).awaitTermination()
    assert [(r.hit_count, r.answer) for r in streams.read_upserts(spark, out).collect()] == [(6, "b3")]


@pytest.mark.parametrize("lost", ["table", "ledger"])
def test_a_batch_that_runs_again(spark, tmp_path, lost):
    """The checkpoint forgets a batch: it was committed (and is left out), or its ledger row was never written (and it is done again)."""
    src, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "cp"
    badcases(spark, "a", 1).write.parquet(src)
    run = lambda: streams.upsert_stream(spark.readStream.schema(EVENT).parquet(src), out, str(checkpoint)).awaitTermination()
    run()
    if lost == "ledger":
        for f in (tmp_path / "out" / "ledger").glob("*.parquet"):
            f.unlink()
    for f in [*(checkpoint / "commits").iterdir()]:
        f.unlink()
    run()
    assert [r.hit_count for r in streams.read_upserts(spark, out).collect()] == [1]


def question_events(seed: int) -> list[tuple]:
    """event_id, key and second; within ten minutes of one another they come in any order."""
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab cdé"), rng.randrange(0, 40_000)) for i in range(400)] + [(1000 + i, "a", 5000) for i in range(3)]
    return sorted(rows, key=lambda r: r[2] + rng.randrange(0, 590))


def test_question_stream_equals_the_batch_operator(spark, tmp_path):
    rows = question_events(1) + [(9999, "last", 200_000)]  # moves the watermark past all others
    df = spark.createDataFrame(rows, "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    src = tmp_path / "e"
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i : i + 50], "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(src / f"b={i:05}"))
    stream = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    found = streams.question_stream(stream, 3600, "10 minutes")
    found.writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.event_id, r.hit) for r in spark.table("answers").collect()}
    want = {(r.key, r.event_id, r.hit) for r in feedback.dedupe_questions(df, 3600).where("key <> 'last'").collect()}
    assert got == want and len(got) == 403 and 0 < sum(x[2] for x in got) < 403


def test_latency_sketches_agree_with_exact_quantiles(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"/p{i % 3}", rng.choice([200, 500]), rng.lognormvariate(5, 1.5) if i % 11 else None, i) for i in range(9000)] + [("/none", 200, None, 5), ("/nan", 200, float("nan"), 5)]
    log = spark.createDataFrame(rows, "path string, status int, elapsed_ms double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    exact = {r.path: r for r in feedback.access_latency(log.where("path LIKE '/p%'")).collect()}
    src = str(tmp_path / "log")
    log.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.latency_stream(stream, late="1 day").writeStream.format("memory").queryName("parts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    for parts in (feedback.latency_sketches(log), spark.table("parts")):
        assert parts.groupBy("path", "start").count().where("count > 1").isEmpty() and parts.count() > 60
        got = {r.path: r for r in feedback.merged_latency(parts).collect()}
        assert got["/none"].p50_ms is None and got["/nan"].p50_ms is None and got["/none"].requests == 1 and got["/nan"].mean_ms is None
        for path, e in exact.items():
            g = got[path]
            assert (g.requests, g.errors, g.slow) == (e.requests, e.errors, e.slow) and abs(g.mean_ms - e.mean_ms) < 1e-3
            times = sorted(r[2] for r in rows if r[0] == path and r[2] is not None)
            for share, value in ((0.5, g.p50_ms), (0.99, g.p99_ms)):
                rank = sum(t <= value for t in times) / len(times)
                assert abs(rank - share) <= feedback.rank_error(400) + 1 / len(times)
