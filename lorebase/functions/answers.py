"""Columns over generated answers: reference marks, verdicts, lab values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A reference mark, and where a verdict is said.
REFERENCE = r"\[参考\s*(\d+)\]"
VERDICTS = ("判定[:：]\\s*(正确|不正确)", "说法[:：]?\\s*(正确|不正确)")
# Phrases that mean no and phrases that mean yes.
NEGATIVE = "不正确|不成立|不能认定|不能据此|过于绝对|依据不足|并不矛盾|不必然"
POSITIVE = "正确|成立"


def extract_refs(answer: Column) -> Column:
    """Numbers of all ``[参考n]`` in order; empty for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(answer, F.lit(REFERENCE), F.lit(1)), lambda n: n.cast("int")), F.array().cast("array<int>"))


def validate_citations(answer: Column, n_sources: Column) -> Column:
    """Struct of refs, valid, invalid, invalid_ratio, coverage, text without invalid marks, fixed.

    Of two adjacent punctuation marks that a removal leaves, the first goes.
    """
    refs = extract_refs(answer)
    valid = F.filter(refs, lambda n: (n >= 1) & (n <= n_sources))
    invalid = F.filter(refs, lambda n: (n < 1) | (n > n_sources))
    without = F.aggregate(F.array_distinct(invalid), answer, lambda a, n: F.regexp_replace(a, F.concat(F.lit(r"\[参考\s*0*"), n.cast("string"), F.lit(r"\]")), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(without, r"[，。；、]\s*(?=[，。；、])", ""), r"\(\s*\)", "")
    bad = F.size(invalid) > 0
    return F.struct(
        refs.alias("refs"), valid.alias("valid"), invalid.alias("invalid"),
        F.when(F.size(refs) > 0, F.size(invalid) / F.size(refs)).otherwise(0.0).alias("invalid_ratio"),
        F.when(n_sources > 0, F.size(F.array_distinct(valid)) / n_sources).otherwise(0.0).alias("coverage"),
        F.when(bad, tidy).otherwise(answer).alias("text"), bad.alias("fixed"),
    )


def needs_retry(check: Column) -> Column:
    """An invalid mark, and half of the marks or two of them invalid."""
    n = F.size(check["invalid"])
    return (n > 0) & ((check["invalid_ratio"] >= 0.5) | (n >= 2))


def parse_verdict(text: Column) -> Column:
    """正确 or 不正确 after 判定： or 说法：, else by phrases, else null."""
    said, claim = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in VERDICTS)
    return F.coalesce(said, claim, F.when(text.rlike(NEGATIVE), "不正确"), F.when(text.rlike(POSITIVE), "正确"))


def parse_abnormal(text: Column) -> Column:
    """Array of (name, value) in the segment after 异常项目共 up to 其余 or the full stop."""
    part = F.regexp_extract(text, "异常项目共([^。]*?)(?:其余|。|$)", 1)
    names = F.regexp_extract_all(part, F.lit(r"([一-龥A-Za-z]+)\s*[:：(（]?\s*(\d+(?:\.\d+)?)"), F.lit(1))
    values = F.regexp_extract_all(part, F.lit(r"([一-龥A-Za-z]+)\s*[:：(（]?\s*(\d+(?:\.\d+)?)"), F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.try_cast("double").alias("value")))
