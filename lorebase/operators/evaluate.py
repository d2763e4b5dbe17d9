"""E: evaluation of answers, rankings and verdicts, and tuning of the fusion."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lorebase.functions.answers import parse_verdict
from lorebase.operators.common import top
from lorebase.operators.retrieval import RRF_K, WEIGHTS
from lorebase.workers import ship, stored

# The grid of the tuning, channel by channel, then the constant.
WEIGHT_GRID = (0.0, 0.3, 0.5, 0.8, 1.0, 1.2, 1.5, 2.0)
K_GRID = (20, 40, 60, 80, 100)
#: Queries whose facts a task holds as Python objects at once.
FACTS = 512


def summarize_eval(results: DataFrame) -> DataFrame:
    """One row of totals of results(ok, duration, answer, sources array of (bookTitle), no_result, book_count, prompt_version, citation_total, citation_invalid, coverage)."""
    ok = F.col("ok")
    mean = lambda c: F.round(F.avg(F.when(ok, c)), 2)
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("fail"), F.count_if(ok & F.col("no_result")).alias("no_result"),
        F.round(F.count_if(ok & F.col("no_result")) / F.count_if(ok), 2).alias("no_result_rate"), F.count_if(ok & (F.size("sources") > 0)).alias("with_sources"),
        mean(F.size("sources")).alias("mean_sources"), mean(F.col("book_count")).alias("mean_books"), mean(F.col("duration")).alias("mean_duration"), mean(F.length("answer")).alias("mean_length"),
        F.sum(F.when(ok, F.col("citation_total"))).alias("citations"), F.sum(F.when(ok, F.col("citation_invalid"))).alias("invalid"),
        F.round(F.avg(F.when(ok & (F.col("citation_total") > 0), F.col("coverage"))), 2).alias("mean_coverage"), F.array_join(F.sort_array(F.collect_set("prompt_version")), ",").alias("prompt_versions"),
    )


def book_hits(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits, total, rate; and the misses with the first three distinct books got."""
    books = F.transform("sources", lambda s: s["bookTitle"])
    out = results.withColumn("hit", F.array_contains(books, F.col("book_title"))).withColumn("got", F.slice(F.array_distinct(books), 1, 3))
    return out.agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate")), out.where(~F.col("hit")).select("id", "book_title", "got")


def model_distribution(results: DataFrame) -> DataFrame:
    """Answers per model, null as none."""
    return results.groupBy(F.coalesce("model", F.lit("none")).alias("model")).agg(F.count("*").alias("answers"))


def judge_means(scores: DataFrame, dimensions: Sequence[str] = ("accuracy", "completeness", "citation", "format")) -> DataFrame:
    """Mean of each dimension and of the means, 2 places."""
    means = scores.agg(*(F.avg(d).alias(d) for d in dimensions))
    return means.select(*(F.round(d, 2).alias(d) for d in dimensions), F.round(sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0])) / len(dimensions), 2).alias("overall"))


def compare_runs(a: DataFrame, b: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """E5: metric, a, b, difference of two one-row summaries."""
    long = lambda df, name: df.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))))
    return long(a, "a").join(long(b, "b"), "metric").withColumn("difference", F.round(F.col("b") - F.col("a"), 6))


def hit_rate_mrr(ranked: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rate (3 places) and MRR at k (4 places) of (query_id, rank, book, expected); the first 20 rows of a query count."""
    first = F.min(F.when((F.col("book") == F.col("expected")) & (F.col("rank") <= 20), F.col("rank")))
    per = ranked.groupBy(*by, "query_id").agg(first.alias("first"))
    return per.groupBy(*by).agg(F.round(F.avg(F.col("first").isNotNull().cast("int")), 3).alias("hit_rate"), F.round(F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)), 4).alias("mrr"))


def fusion_facts(channels: DataFrame, texts: DataFrame, expected: DataFrame) -> DataFrame:
    """What a fusion needs of every candidate, whatever its parameters: a row for each query with arrays over its candidates.

    query_id, expected, channels (names), books (of the candidates by id), ranks (candidate, channel, rank) and alike (pairs of
    candidates of which prefix deduplication keeps one). A query's candidates are what its channels found, a few dozen, and
    meet in one row. The channels are searched once and written. Texts are compared here, once, and go no further. Queries are
    dealt over all shuffle partitions: their rows have few bytes but much work, and Spark would join them to one task.
    """
    spark = channels.sparkSession
    channels = stored(channels, "channels")
    per = channels.groupBy("query_id", "id").agg(F.collect_list(F.struct("channel", "rank")).alias("ranks"))
    rows = per.join(texts.select("id", "book", "content"), "id")
    names = [r["channel"] for r in channels.select("channel").distinct().orderBy("channel").collect()]  # a handful of channels
    found = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "book", "content", "ranks"))).alias("_found"))
    asked = expected.join(found, "query_id", "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("query_id"))  # by the column itself Spark would leave it out
    kept = asked.drop("_found").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FACTS):
                part = batch.slice(at, FACTS)
                books, places, alike = [], [], []
                for group in part.column("_found").to_pylist():
                    if group is None:
                        books.append(None), places.append(None), alike.append(None)
                        continue
                    text = [c["content"] for c in group]
                    books.append([c["book"] or "其他" for c in group])
                    places.append([[i, names.index(r["channel"]), int(r["rank"])] for i, c in enumerate(group) for r in c["ranks"]])
                    alike.append([[i, j] for j in range(len(text)) for i in range(j) if _alike(text[i], text[j])])
                pairs = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.select(kept.names).columns, pa.array(books, pa.list_(pa.string())), pa.array(places, pairs), pa.array(alike, pairs)], [*kept.names, "books", "ranks", "alike"])

    ship(spark)
    ints = ArrayType(ArrayType(IntegerType()))
    shape = StructType([*kept.fields, StructField("books", ArrayType(StringType())), StructField("ranks", ints), StructField("alike", ints)])
    return asked.mapInArrow(run, shape).withColumn("channels", F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))


def _alike(a: str | None, b: str | None) -> bool:
    """R11's test of two texts."""
    if a is None or b is None:
        return False
    n = min(len(a), len(b))
    return n >= 10 and a[: n * 6 // 10 + 1] == b[: n * 6 // 10 + 1]


def _ready(facts: dict) -> tuple | None:
    """Of a query's facts what all parameters share: books, (candidate, channel, rank) in order, and the candidates alike to each; None without candidates."""
    books, names = facts["books"], facts["channels"]
    if not isinstance(books, (list, np.ndarray)):  # no candidates
        return None
    near: dict[int, set[int]] = {}
    for i, j in facts["alike"]:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    return list(books), sorted((int(i), int(c), int(rank)) for i, c, rank in facts["ranks"]), near, list(names), facts["expected"]


def _replay(ready: tuple | None, weights: Mapping[str, float], k: int, limit: int) -> int | None:
    """Rank of the first row of the expected book after fusion, quota and deduplication; None without one."""
    if ready is None:
        return None
    books, ranks, near, names, expected = ready
    score, used = [0.0] * len(books), [False] * len(books)
    first: list[tuple | None] = [None] * len(books)
    for i, c, rank in ranks:
        w = weights.get(names[c], 1.0)
        if w > 0:
            score[i] += w / (k + rank)
            used[i] = True
            first[i] = min(first[i] or (c, rank), (c, rank))
    order = sorted((i for i in range(len(books)) if used[i]), key=lambda i: (-round(score[i], 6), first[i], i))
    cap, taken, kept = max(2, -(-limit // 2)), {}, []
    for i in order:
        taken[books[i]] = taken.get(books[i], 0) + 1
        if taken[books[i]] <= cap and not near.get(i, set()) & set(kept):
            kept.append(i)
    return next((n for n, i in enumerate(kept[:20], 1) if books[i] == expected), None)


def replayed(facts: DataFrame, params: Sequence[tuple[Mapping[str, float], int]], limit: int = 5) -> DataFrame:
    """param, hit_rate, mrr of every (weights, k) over ``fusion_facts``, in one job: each query is replayed for all of them in its task."""
    chosen = [(dict(w), k) for w, k in params]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), FACTS):
                ready = [_ready(r) for r in f.iloc[at : at + FACTS].to_dict("records")]
                firsts = [(p, _replay(r, w, k, limit)) for r in ready for p, (w, k) in enumerate(chosen)]
                yield pd.DataFrame({"param": [p for p, _ in firsts], "first": pd.array([n for _, n in firsts], "Int64")})

    per = facts.mapInPandas(run, "param int, first long")
    hit = F.round(F.avg(F.col("first").isNotNull().cast("int")), 3)
    return per.groupBy("param").agg(hit.alias("hit_rate"), F.round(F.avg(F.when(F.col("first") <= 5, 1 / F.col("first")).otherwise(0.0)), 4).alias("mrr"))


def fusion_grid(channels: DataFrame, texts: DataFrame, expected: DataFrame, params: Sequence[tuple[Mapping[str, float], int]], limit: int = 5) -> DataFrame:
    """Param, hit_rate, mrr of every (weights, k): fusion, quota, deduplication and metrics replayed from the same facts of each query."""
    return replayed(fusion_facts(channels, texts, expected), params, limit)


def tune_fusion(channels: DataFrame, texts: DataFrame, expected: DataFrame, rounds: int = 3, limit: int = 5) -> tuple[dict[str, float], int, tuple[float, float], list[dict]]:
    """Weights, k and (hit rate, MRR) after coordinate descent, and its steps (round, coordinate, value, hit_rate, mrr).

    The facts of the queries are computed once and written; each coordinate is a job over them for its whole grid. The first value
    in a grid that is better (hit rate, then MRR) than all before is taken; a round that improves nothing is the last.
    """
    facts = stored(fusion_facts(channels, texts, expected), "fusion-facts")
    weights, k, best, steps = dict(WEIGHTS), RRF_K, (-1.0, -1.0), []
    for n in range(1, rounds + 1):
        before = best
        for name in (*WEIGHTS, None):
            tries = [({**weights, name: w}, k) for w in WEIGHT_GRID] if name else [(weights, x) for x in K_GRID]
            for row in sorted(replayed(facts, tries, limit).collect(), key=lambda r: r["param"]):  # a row per grid point
                if (found := (row["hit_rate"], row["mrr"])) > best:
                    best, (weights, k) = found, tries[row["param"]]
            steps.append({"round": n, "coordinate": name or "k", "value": float(weights[name] if name else k), "hit_rate": best[0], "mrr": best[1]})
        if best == before:
            break
    return weights, k, best, steps


def verdict_accuracy(rows: DataFrame, by: Sequence[str] = ("model", "slice")) -> DataFrame:
    """Accuracy overall, on positives and negatives, for every level of ``by``; unparsed responses are wrong. rows(expected, response)."""
    right = (F.coalesce(parse_verdict(F.col("response")), F.lit("")) == F.col("expected")).cast("int")
    acc = lambda e: F.round(F.avg(F.when(F.col("expected") == e, F.col("_right"))), 6)
    return rows.withColumn("_right", right).rollup(*by).agg(F.count("*").alias("n"), F.round(F.avg("_right"), 6).alias("accuracy"), acc("正确").alias("on_positive"), acc("不正确").alias("on_negative"))


def citation_presence(rows: DataFrame) -> DataFrame:
    """Share of answers with a reference mark per model."""
    return rows.groupBy("model").agg(F.round(F.avg(F.col("answer").rlike(r"\[参考\s*\d+\]").cast("int")), 6).alias("share"))


def path_recall(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Pass rate per engine; a case (case_id, keywords) passes when a result (engine, case_id, path) contains a keyword."""
    hit = F.exists("keywords", lambda w: F.contains(F.col("path"), w)).cast("int")
    per = results.join(cases, "case_id").groupBy("engine", "case_id").agg(F.max(hit).alias("hit"))
    engines = results.select("engine").distinct()
    n = cases.select("case_id").distinct().count()
    return engines.join(per.groupBy("engine").agg(F.sum("hit").alias("passed")), "engine", "left").select("engine", F.coalesce("passed", F.lit(0)).alias("passed"), F.round(F.coalesce("passed", F.lit(0)) / max(n, 1), 6).alias("rate"))


def golden_regression(results: DataFrame, golden: DataFrame) -> DataFrame:
    """case_id, passed, reason: the first row's path contains the expected path or the reverse, and its similarity reaches the minimum."""
    first = top(results, ["case_id"], [F.col("rank")], 1).select("case_id", "path", "similarity")
    on = F.contains(F.col("path"), F.col("expected_path")) | F.contains(F.col("expected_path"), F.col("path"))
    low = F.col("similarity") < F.col("min_similarity")
    reason = F.when(F.col("path").isNull(), "no result").otherwise(F.concat_ws("; ", F.when(~on, "other path"), F.when(low, "low similarity")))
    return golden.join(first, "case_id", "left").select("case_id", (reason == "").alias("passed"), reason.alias("reason"))


def latency_stats(df: DataFrame, by: Sequence[str], value: str = "ms") -> DataFrame:
    """N, mean, p50 (upper middle) and max per group, from counts by value. Rows without a value count in n only."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("_all"), F.count(value).alias("_timed"))
    group = Window.partitionBy(*by)
    per = per.withColumn("_upto", F.sum("_timed").over(group.orderBy(value))).withColumn("_n", F.sum("_timed").over(group))
    mean = F.round(F.sum(F.col(value) * F.col("_timed")) / F.nullif(F.sum("_timed"), F.lit(0)), 6)
    return per.groupBy(*by).agg(F.sum("_all").alias("n"), mean.alias("mean"), F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col(value))).alias("p50"), F.max(value).alias("max"))


def extraction_prf(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """item_id, precision, recall, exact of (item_id, name, value): pairs match when one name contains the other and values differ by less than 0.5."""
    g = gold.select("item_id", F.col("name").alias("g_name"), F.col("value").alias("g_value"))
    near = (F.contains(F.col("name"), F.col("g_name")) | F.contains(F.col("g_name"), F.col("name"))) & (F.abs(F.col("value") - F.col("g_value")) < 0.5)
    found = predicted.join(g, "item_id").where(near).groupBy("item_id").agg(F.countDistinct("g_name", "g_value").alias("tp"))
    n_gold, n_pred = gold.groupBy("item_id").agg(F.count("*").alias("n_gold")), predicted.groupBy("item_id").agg(F.count("*").alias("n_pred"))
    all_items = n_gold.join(n_pred, "item_id", "full").join(found, "item_id", "left").fillna(0, ["n_gold", "n_pred", "tp"])
    fp = F.greatest(F.col("n_pred") - F.col("n_gold"), F.lit(0))
    return all_items.select("item_id", F.round(F.when(F.col("tp") + fp > 0, F.col("tp") / (F.col("tp") + fp)).otherwise(0.0), 6).alias("precision"), F.round(F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(1.0), 6).alias("recall"), ((F.col("tp") == F.col("n_gold")) & (F.col("n_pred") == F.col("n_gold"))).alias("exact"))


def experiment_matrix(results: DataFrame, groups: Sequence[str], value: str = "score") -> DataFrame:
    """A column for each group of a question's values."""
    return results.groupBy("question").pivot("grp", list(groups)).agg(F.first(value))


