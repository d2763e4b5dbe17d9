"""W: filters over web results (query_id, ord, title, link, snippet)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import cosine
from lorebase.operators.common import top


def dedupe_by_link(df: DataFrame) -> DataFrame:
    """First row of every link that is not empty, per query, in arrival order."""
    return top(df.where(F.length("link") > 0), ["query_id", "link"], [F.col("ord")], 1)


def host(link: Column) -> Column:
    """Host of a link; the link itself where it can't be parsed."""
    return F.coalesce(F.try_parse_url(link, F.lit("HOST")), link)


def dedupe_by_host(df: DataFrame, n: int = 2) -> DataFrame:
    """At most n rows of a host per query, in order."""
    return top(df.withColumn("_host", host(F.col("link"))), ["query_id", "_host"], [F.col("ord")], n).drop("_host")


def flag_authoritative(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Adds authoritative: the link contains a listed domain."""
    return df.withColumn("authoritative", F.exists(F.array(*map(F.lit, domains)), lambda d: F.contains(F.col("link"), d)) if domains else F.lit(False))


def prioritize(df: DataFrame, max_non: int = 2, k: int = 5) -> DataFrame:
    """Flagged rows first and at most ``max_non`` others, k in all; without a flagged row the first k."""
    by = Window.partitionBy("query_id")
    out = df.withColumn("_any", F.max("authoritative").over(by)).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "authoritative").orderBy("ord")))
    out = out.where(~F.col("_any") | F.col("authoritative") | (F.col("_n") <= max_non))
    return top(out, ["query_id"], [F.col("authoritative").desc(), F.col("ord")], k, "rank").drop("_any", "_n")


def filter_relevance(df: DataFrame, thr: float = 0.45) -> DataFrame:
    """Rows (with qvec, tvec or null, and terms of the query) of sim >= thr, best first.

    sim is the vectors' cosine; without a query vector 0.5 + min(hits / 3, 0.4) for terms in title and snippet,
    0 without a hit.
    """
    hits = F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.concat("title", "snippet"), t)))
    by_terms = F.when(hits > 0, F.lit(0.5) + F.least(hits / 3, F.lit(0.4))).otherwise(0.0)
    sim = F.round(F.when(F.col("qvec").isNotNull(), cosine(F.col("qvec"), F.col("tvec"))).otherwise(by_terms), 6)
    return df.withColumn("sim", sim).where(F.col("sim") >= thr).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "ord")))


def rank_book_results(df: DataFrame, k: int = 10) -> DataFrame:
    """Adds type (pdf, book, article) and score, keeps the k best of a query; ``final_books`` ends it after W4."""
    t, link = F.col("title"), F.col("link")
    pdf = F.contains(link, F.lit(".pdf")) | t.rlike("filetype:pdf|PDF")
    book = t.rlike(r"第[一二三四五六七八九十\d]+版|教材|教科书|课本")
    score = F.when(pdf, 3).otherwise(0) + F.when(book, 2).when(t.rlike("指南|共识|规范|手册|临床路径"), 1).otherwise(0) - F.when(t.rlike("科普|百科|问答|怎么|如何"), 2).otherwise(0)
    out = df.withColumn("type", F.when(book, "book").when(pdf, "pdf").otherwise("article")).withColumn("score", score)
    return top(out, ["query_id"], [F.col("score").desc(), F.col("ord")], k)


def final_books(df: DataFrame, k: int = 5) -> DataFrame:
    """What is no article first, then by score and order, k rows."""
    return top(df, ["query_id"], [(F.col("type") == "article").asc(), F.col("score").desc(), F.col("ord")], k, "place")
