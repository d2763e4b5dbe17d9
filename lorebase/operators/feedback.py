"""F: feedback events folded into queues and summaries, in batch; streaming forms are in lorebase.streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lorebase.workers import ship

REASONS = ("no_result", "weak_hit", "feedback_dislike")


def _latest(name: str, by: str = "ts") -> Column:
    """Last value that is neither null nor empty."""
    kept = F.when(F.length(F.col(name).cast("string")) > 0, F.struct(F.col(by), F.col(name)))
    return F.max(kept)[name]


def badcase_events(events: DataFrame) -> DataFrame:
    """one row per (question, reason): hit_count, answer, sources, model, note (last non-empty), created_at, updated_at.

    Questions are trimmed to 500 characters, answers to 8,000, notes to 200; sources keep ten distinct titles.
    """
    e = events.where(F.col("reason").isin(*REASONS)).select(
        F.left(F.trim("question"), F.lit(500)).alias("question"), "reason", F.left("answer", F.lit(8000)).alias("answer"),
        F.array_join(F.slice(F.array_distinct("sources"), 1, 10), " | ").alias("sources"), "model", F.left("note", F.lit(200)).alias("note"), "ts",
    )
    return e.groupBy("question", "reason").agg(F.count("*").alias("hit_count"), *(_latest(c).alias(c) for c in ("answer", "sources", "model", "note")), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def merge_counts(state: DataFrame, new: DataFrame, keys: list[str], kept: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """``state`` with ``new`` rows of the same shape: hit counts add, ``kept`` columns change only to values that are not null, ``always`` ones to the new row's."""
    s, n = state.alias("s"), new.alias("n")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    out = s.join(n, on, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c)
    return out.select(
        *(F.coalesce(F.col(f"s.{k}"), F.col(f"n.{k}")).alias(k) for k in keys), (F.coalesce("s.hit_count", F.lit(0)) + F.coalesce("n.hit_count", F.lit(0))).alias("hit_count"), *(pick(c) for c in kept),
        *(F.when(F.col("n.hit_count").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in always),
        F.least("s.created_at", "n.created_at").alias("created_at"), F.greatest("s.updated_at", "n.updated_at").alias("updated_at"),
    )


def badcase_upsert(state: DataFrame, events: DataFrame) -> DataFrame:
    """the table after the events."""
    return merge_counts(state, badcase_events(events), ["question", "reason"], ["answer", "sources", "model", "note"])


def request_events(events: DataFrame) -> DataFrame:
    """one row per question (200 characters): hit_count, domain of the last event, last non-empty note and suggestions (5)."""
    e = events.select(F.left(F.trim("question"), F.lit(200)).alias("question"), "domain", "note", F.slice("suggestions", 1, 5).alias("suggestions"), "ts")
    some = F.max(F.when(F.size("suggestions") > 0, F.struct("ts", "suggestions")))["suggestions"]
    return e.groupBy("question").agg(F.count("*").alias("hit_count"), F.max_by("domain", "ts").alias("domain"), _latest("note").alias("note"), some.alias("suggestions"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def request_log_upsert(state: DataFrame, events: DataFrame) -> DataFrame:
    """the table after the events."""
    return merge_counts(state, request_events(events), ["question"], ["note", "suggestions"], ("domain",))


def export_badcases(df: DataFrame, status: str | None = None, reason: str | None = None) -> DataFrame:
    """chosen rows by hit_count and age with an empty book to annotate, and the reason's total."""
    out = df.where(F.col("status") == status) if status else df
    out = out.where(F.col("reason") == reason) if reason else out
    return out.withColumn("book", F.lit(None).cast("string")).withColumn("reason_total", F.count("*").over(Window.partitionBy("reason"))).orderBy(F.col("hit_count").desc(), F.col("created_at").desc())


def feedback_stats(df: DataFrame) -> DataFrame:
    """likes, dislikes and dislikes with a reason."""
    return df.agg(F.count_if(F.col("rating") == 1).alias("likes"), F.count_if(F.col("rating") == -1).alias("dislikes"), F.count_if((F.col("rating") == -1) & (F.length("reason") > 0)).alias("with_reason"))


def newest(df: DataFrame, k: int = 10) -> DataFrame:
    """the k newest rows by id."""
    return df.orderBy(F.col("id").desc()).limit(k)


def dislikes_to_badcases(feedback: DataFrame) -> DataFrame:
    """bad-case events of ratings of -1."""
    return feedback.where("rating = -1").select("question", F.lit("feedback_dislike").alias("reason"), "answer", "sources", "model", F.col("reason").alias("note"), "ts")


def request_queue(df: DataFrame, status: str | None = "pending", k: int = 200) -> DataFrame:
    """k requests of a status (None: all), most wanted and newest first."""
    out = df.where(F.col("status") == status) if status else df
    return out.orderBy(F.col("hit_count").desc(), F.col("created_at").desc(), "question").limit(k)


def sessionize(events: DataFrame, gap: str = "24 hours", key: str = "user_id") -> DataFrame:
    """sessions of each key that end after ``gap`` without an event: key, start, end, n."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedupe_questions(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """F8: key, event_id, hit: the same key within ``ttl_seconds`` of the answer stored last; a miss stores a new one.

    An event with no other of its key in the ``ttl_seconds`` before it is a miss whatever came earlier, so a key's events fall
    into runs that don't know of one another. Runs are found from one row per key and block of time, dealt out, and read
    in order with the stored time in hand. An event without a time has no answer (null) and stores none.
    """
    length = max(ttl_seconds, 1)
    e = events.select("key", F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").cast("double").alias("t")).withColumn("block", F.floor(F.col("t") / length))
    per = e.groupBy(F.col("key").alias("_key"), F.col("block").alias("_block")).agg(F.min("t").alias("least"), F.max("t").alias("most"))
    along = Window.partitionBy("_key").orderBy("_block")
    opens = (F.col("_block") - F.lag("_block").over(along) > 1) | (F.col("least") - F.lag("most").over(along) > ttl_seconds)
    runs = per.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("run", F.sum("_opens").over(along)).select("_key", "_block", "run")
    dealt = e.join(runs, F.col("key").eqNullSafe(F.col("_key")) & F.col("block").eqNullSafe(F.col("_block"))).select("key", "run", "t", "event_id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored = None, float("-inf")
        for batch in batches:
            hits = []
            for key, run, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (key, run) != now:
                    now, stored = (key, run), float("-inf")
                hits.append(None if t is None else t - stored <= ttl_seconds)
                if hits[-1] is False:
                    stored = t
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(hits, pa.bool_())], ["key", "event_id", "hit"])

    dealt = dealt.repartition("key", "run").sortWithinPartitions("key", "run", "t", "event_id")
    return dealt.mapInArrow(judge, f"key {events.schema['key'].dataType.simpleString()}, event_id bigint, hit boolean")


def gpu_summary(samples: DataFrame) -> DataFrame:
    """per run mean and peak utilisation, last memory, its share, temperatures, last power, number of samples."""
    last = lambda c: F.max_by(c, "ts")
    return samples.groupBy("run").agg(F.round(F.avg("util"), 6).alias("util_mean"), F.max("util").alias("util_max"), last("mem_used").alias("mem_used"), last("mem_total").alias("mem_total"), F.round(100 * last("mem_used") / last("mem_total"), 6).alias("mem_percent"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), last("power").alias("power"), F.count("*").alias("n"))


def access_latency(log: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """per path requests, errors (status 500 or more), mean, p50, p99 (exact, between neighbours in proportion) and slow requests.

    Requests are counted by time first, so a path's ranks run over its different times. Requests without a time count as such.
    """
    ms = F.col("elapsed_ms")
    per = log.groupBy("path", "elapsed_ms").agg(F.count("*").alias("all"), F.count("elapsed_ms").alias("timed"), F.count_if(F.col("status") >= 500).alias("errors"))
    per = per.withColumn("upto", F.sum("timed").over(Window.partitionBy("path").orderBy("elapsed_ms"))).withColumn("n", F.sum("timed").over(Window.partitionBy("path")))

    def at(share: float) -> Column:
        place = (F.col("n") - 1) * share
        below, above = (F.min(F.when(F.col("upto") > f(place), ms)) for f in (F.floor, F.ceil))
        return F.round(below + (above - below) * F.max(place - F.floor(place)), 6)

    mean = F.round(F.sum(ms * F.col("timed")) / F.nullif(F.sum("timed"), F.lit(0)), 6)
    return per.groupBy("path").agg(F.sum("all").alias("requests"), F.sum("errors").alias("errors"), mean.alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.99).alias("p99_ms"), F.sum(F.when(ms > slow_ms, F.col("all")).otherwise(0)).alias("slow"))


#: Quantiles of a report.
SHARES = (0.5, 0.99)


def rank_error(k: int) -> float:
    """How far, as a share of all requests, a quantile of a sketch of size ``k`` may be off in rank (with a chance of 99 %)."""
    return 2.446 / k**0.9433


def latency_sketches(log: DataFrame, window: str = "5 minutes", slow_ms: float = 1000.0, k: int = 400) -> DataFrame:
    """F10 in mergeable parts, for batch and streams: start, path, requests, errors, timed, total_ms, slow, sketch.

    The sketch (KLL) holds the quantiles of a window's times to a rank error of ``rank_error(k)``, 0.9 % for 400, in a few KB; it is null
    where no request has a time. Times that are not numbers count as missing.
    """
    ms = F.nullif(F.col("elapsed_ms").cast("double"), F.lit(float("nan")))
    per = log.withColumn("_ms", ms).groupBy(F.window("ts", window).alias("w"), "path")
    out = per.agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.count("_ms").alias("timed"), F.sum("_ms").alias("total_ms"), F.count_if(F.col("_ms") > slow_ms).alias("slow"), F.kll_sketch_agg_double("_ms", k).alias("sketch"))
    return out.select(F.col("w.start").alias("start"), "path", "requests", "errors", "timed", "total_ms", "slow", F.when(F.col("timed") > 0, F.col("sketch")).alias("sketch"))


def merged_latency(sketches: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """requests, errors, mean_ms, p50_ms, p99_ms, slow of the windows' sketches together; ``access_latency`` is the exact path."""
    total = sketches.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("requests", "errors", "timed", "total_ms", "slow")), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = [F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q).cast("double"))).alias(f"p{int(q * 100)}_ms") for q in SHARES]
    return total.select(*by, "requests", "errors", F.round(F.col("total_ms") / F.nullif(F.col("timed"), F.lit(0)), 6).alias("mean_ms"), *at, "slow")


def new_passages(passages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """enabled passages without a vector, or whose id is not stored."""
    on = passages.where("enabled")
    return on.where(F.col("vec").isNull()) if stored is None else on.join(stored.select("id"), "id", "left_anti")


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float] | None]], batch: int = 16, prefix: str = "") -> DataFrame:
    """id, vec, state (ok, failed, skipped): texts trimmed to 500 characters, under 4 skipped, ``fn`` called per batch; a failing call leaves nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [(t or "").strip()[:500] for t in f["text"]]
            vec, state = [None] * len(texts), ["skipped" if len(t) < 4 else "failed" for t in texts]
            todo = [i for i, t in enumerate(texts) if len(t) >= 4]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                try:
                    found = fn([prefix + texts[i] for i in part])
                except Exception:  # noqa: BLE001  the caller's function may raise anything; its rows stay null
                    continue
                for i, v in zip(part, found, strict=True):
                    if v is not None:
                        vec[i], state[i] = v, "ok"
            yield pd.DataFrame({"id": f["id"], "vec": vec, "state": state})

    ship(df.sparkSession)
    return df.select("id", "text").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, vec array<float>, state string")


def embed_counted(df: DataFrame, fn: Callable[[list[str]], list[list[float] | None]], batch: int = 16, prefix: str = "") -> tuple[DataFrame, Observation]:
    """the rows of ``embed``, and an observation that gives ``ok``, ``failed`` and ``skipped`` once an action has made them all: no second call of ``fn``."""
    seen = Observation()
    rows = embed(df, fn, batch, prefix)
    return rows.observe(seen, *(F.count_if(F.col("state") == s).alias(s) for s in ("ok", "failed", "skipped"))), seen
