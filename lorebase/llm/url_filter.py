"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import table

#: (verdict, host and path) of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("length", "host_length", "host_labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "has_fragment", "https", "longest_word", "suffix_rate", "suffix_share")
#: Upper-case letters of a host, lowered without touching other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: from there up to ``?``, ``#`` or the end. Null, or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule ``host/path`` fits its host and all subdomains where the path begins with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds the lexical columns of FEATURES to rows with url, host, path.

    entropy is that of the url's characters in bits. suffix_rate and suffix_share are the smoothed share of
    blocked rows and the share of all rows of the host's last label among the labelled rows (``suffixes``).
    A null url has the features of an empty one.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    n = F.greatest(F.length(url), F.lit(1))

    def bits(c: Column) -> Column:
        p = F.size(F.filter(F.col("chars"), lambda d: d == c)) / F.col("length")
        return -p * F.log2(p)

    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    out = urls.withColumn("chars", chars).withColumn("length", n)
    out = out.withColumns({
        "host_length": F.length("host"), "host_labels": F.size(F.split("host", r"\.")), "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "digit_ratio": digits / n, "entropy": F.aggregate(F.transform(F.array_distinct("chars"), bits), F.lit(0.0), lambda a, x: a + x),
        "parameters": F.length(F.regexp_replace(url, "[^=]", "")), "hyphens": F.length(F.regexp_replace(url, "[^-]", "")), "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "https": F.startswith(url, F.lit("https:")).cast("int"), "longest_word": F.coalesce(F.array_max(F.transform(F.split("host", r"[.-]"), F.length)), F.lit(0)), "suffix": F.substring_index("host", ".", -1),
    })
    known = suffixes.select(F.col("suffix"), F.col("rate").alias("suffix_rate"), F.col("share").alias("suffix_share"))
    out = out.join(known, "suffix", "left").withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(0.5)), "suffix_share": F.coalesce("suffix_share", F.lit(0.0))})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out)


class UrlModel:
    """Boosted trees over labelled urls, or their one label where there are not two."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame, only: int = 0) -> None:
        self.model, self.suffixes, self.only = model, suffixes, only

    def transform(self, urls: DataFrame) -> DataFrame:
        """Adds ``blocked`` (0 or 1) and ``block_score`` (0 to 1) to rows with url, host, path."""
        if self.model is None:
            return urls.withColumn("blocked", F.lit(self.only)).withColumn("block_score", F.lit(float(self.only)))
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(with_features(urls, self.suffixes))
        return out.select(*urls.columns, F.col("prediction").cast("int").alias("blocked"), vector_to_array("probability")[1].alias("block_score"))


def train(labelled: DataFrame, max_rows: int = 50_000, trees: int = 12, depth: int = 3, seed: int = 11) -> UrlModel:
    """Fit on rows with url, host, path, label (1: block).

    At most about ``max_rows`` labelled rows are used, drawn by a hash of the url, so a rerun draws the same;
    with fewer rows all are. Suffix statistics come from all labelled rows and cover all suffixes: they are a table
    that is joined, and broadcast by Spark while small. No rows: nothing is blocked; one
    class only: that class.
    """
    counts = labelled.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    counts = table(counts, "url-suffixes")
    found = counts.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    total, blocked = int(found["n"] or 0), int(found["blocked"] or 0)
    suffixes = counts.select("suffix", ((F.col("blocked") + 1.0) / (F.col("n") + 2.0)).alias("rate"), (F.col("n") / F.lit(max(total, 1))).alias("share"))
    if not 0 < blocked < total:
        return UrlModel(None, suffixes, int(0 < blocked))
    parts = 1 << 20
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(parts)) < F.lit(int(min(1.0, max_rows / total) * parts)))
    data = with_features(drawn, suffixes).select("features", F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("h")).repartition(4, "h").sortWithinPartitions("h", "label")
    if data.select("label").distinct().count() < 2:
        return UrlModel(None, suffixes, int(2 * blocked > total))
    return UrlModel(GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.3).fit(data), suffixes)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every url.

    The longest fitting rule decides; where none fits, the trees do. They are trained on ``labelled`` (url,
    label 1: block), by default on the urls that the rules judge. Null urls, and those without ``://``, have an
    empty host and path and are judged by the trees; repeated rows are judged alike; an empty table gives no
    rows; other columns are left out.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("verdict", verdict)
    if labelled is None:
        known = urls.where("rule IS NOT NULL").select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("label"))
    else:
        known = labelled.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label")).where("label IS NOT NULL")
    out = train(known).transform(urls)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("blocked") == 1, "block").otherwise("allow")).alias("verdict"), F.round("block_score", 6).alias("block_score"))
