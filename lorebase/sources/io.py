"""S: reading and writing the knowledge base and side files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.workers import ship

# Tables of the knowledge base and their columns.
SCHEMAS = {
    "docs": "id long, title string, doc_type string, domain string, keywords array<string>, summary string, file_path string, level int, parent_id long, node_path string, page_no int, enabled boolean, created_at timestamp",
    "passages": "id long, doc_id long, section_path string, page_no int, content string, content_terms array<string>, embedding array<float>, content_hash string, chunk_index int, enabled boolean, created_at timestamp",
    "rule_doc_map": "note_qc_code string, doc_id long, passage_ids array<long>, relevance int, source string, enabled boolean",
    "verify": "id long, source string, note_qc_code string, txt string, embedding array<float>, doc_id long, passage_id long, enabled boolean",
    "entities": "id long, name string, entity_type string, aliases array<string>, summary string, embedding array<float>, source string, enabled boolean, confidence double, doc_id long",
    "edges": "id long, source_id long, target_id long, relation_type string, description string, weight double, doc_id long, enabled boolean, confidence double",
    "communities": "id long, level int, label string, summary string, entity_ids array<long>, parent_id long, embedding array<float>, enabled boolean",
}


def read_kb(spark: SparkSession, path: str, names: list[str] | None = None, only_enabled: bool = True) -> dict[str, DataFrame]:
    """Tables under ``path`` with fixed schemas, enabled rows only for retrieval."""
    out = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in names or SCHEMAS}
    return {n: df.where("enabled") if only_enabled else df for n, df in out.items()}


#: Columns by which tables are read in parts, where that is not id.
PARTITION_COLUMNS = {"rule_doc_map": "doc_id"}


def read_kb_jdbc(spark: SparkSession, url: str, names: list[str] | None = None, only_enabled: bool = True, partitions: int = 8, options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The same tables from a database, each read by ``partitions`` tasks in ranges of its id, the bounds of which the database gives.

    Columns have the types of ``SCHEMAS``: arrays as the database has them, or from JSON text where it has none; missing columns are
    null. Filters and columns that follow go to the database. An empty table is read by one task.
    """
    source = lambda: spark.read.format("jdbc").option("url", url).options(**(options or {}))
    out = {}
    for n in names or SCHEMAS:
        by = PARTITION_COLUMNS.get(n, "id")
        least, most = source().option("query", f'SELECT MIN("{by}") AS "least", MAX("{by}") AS "most" FROM "{n}"').load().first()
        table = source().option("dbtable", f'"{n}"').option("fetchsize", "10000")
        if least is not None:
            table = table.option("partitionColumn", f'"{by}"').option("lowerBound", str(least)).option("upperBound", str(most + 1)).option("numPartitions", str(partitions))
        df = table.load()
        kinds = T.StructType.fromDDL(SCHEMAS[n]).fields
        typed = df.select(*(_typed(df, f).alias(f.name) for f in kinds))
        out[n] = typed.where("enabled") if only_enabled and "enabled" in typed.columns else typed
    return out


def _typed(df: DataFrame, field: T.StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    if isinstance(field.dataType, T.ArrayType) and isinstance(df.schema[field.name].dataType, T.StringType):
        return F.from_json(field.name, field.dataType)
    return F.col(field.name).cast(field.dataType)


def _parsed_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Column]:
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    kind = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r")), F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, blank lines skipped, and the lines that are malformed (column line)."""
    parsed, bad = _parsed_lines(spark, path, schema)
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select(F.col("value").alias("line"))


def read_jsonl_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """Rows of JSON lines, and an observation that gives ``rows`` and ``malformed`` once an action has read them all, in that same pass."""
    parsed, bad = _parsed_lines(spark, path, schema)
    seen = Observation()
    counted = parsed.observe(seen, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("malformed"))
    return counted.where(~bad).select("r.*").drop("_corrupt_record"), seen


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object per line, partitioned by columns if asked; characters stay as they are."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").json(path)


def read_json_map(spark: SparkSession, path: str, value: str, one_a_line: bool = False) -> DataFrame:
    """S3: (key, value) of JSON objects keyed by id, each a file or, if asked, a line of files of any size; ``value`` is the DDL type of a value."""
    text = spark.read.text(path, wholetext=not one_a_line)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Path, title (file name without extension) and text of TXT and MD files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return text.where(F.lower("path").rlike(r"\.(txt|md)$")).withColumn("title", F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")))


def parse_rule_files(df: DataFrame) -> DataFrame:
    """Path and a map of the fields of rule files: ``key: value`` lines and ``key: |`` blocks indented by two spaces."""

    def fields(text: str) -> dict[str, str]:
        out: dict[str, str] = {}
        block: str | None = None
        for line in text.lstrip("﻿").splitlines():
            if block is not None and (not line.strip() or line[:1] in " \t"):
                out[block] += ("\n" if out[block] else "") + line.removeprefix("  ")
                continue
            block = None
            key, colon, rest = line.partition(":")
            if colon and key.strip() and line[:1] not in " \t":
                if rest.strip() in ("|", "|-"):
                    block = key.strip()
                    out[block] = ""
                else:
                    out[key.strip()] = rest.strip()
        return {k: v.rstrip("\n") for k, v in out.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "fields": [fields(t or "") for t in f["text"]]})

    ship(df.sparkSession)
    return df.select("path", "text").mapInPandas(run, "path string, fields map<string,string>")


def parse_checklist(df: DataFrame) -> DataFrame:
    """Path, code, name, points, exempt of checklists: items ``A001.001 name``, lines under 判定要点 or 质控要求 and under 边界 or 豁免."""
    from pyspark.sql import Window

    code = r"^(?:-\s*)?([A-J]\d{3}(?:\.\d{3})?)\s+(.+)$"
    rows = df.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(code), F.struct(F.regexp_extract("line", code, 1).alias("code"), F.regexp_extract("line", code, 2).alias("name"), F.col("n").alias("at")))
    mode = F.when(F.col("line").rlike(code), "none").when(F.col("line").rlike("^[-*#\\s]*(判定要点|质控要求)"), "points").when(F.col("line").rlike("^[-*#\\s]*(边界|豁免)"), "exempt")
    rows = rows.withColumn("item", F.last(head, ignorenulls=True).over(upto)).withColumn("_own", mode).withColumn("mode", F.last("_own", ignorenulls=True).over(upto)).where("item IS NOT NULL")
    said = F.trim(F.regexp_replace("line", "^[-*#\\s]*(判定要点|质控要求|边界|豁免)[^：:]*[：:]?", ""))
    rows = rows.withColumn("said", F.when((F.col("mode") != "none") & (F.length(said) > 0), said))
    pick = lambda m: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("mode") == m, F.struct("n", "said")))), lambda x: x["said"]), "\n")
    return rows.groupBy("path", "item").agg(pick("points").alias("points"), pick("exempt").alias("exempt")).select("path", F.col("item.code").alias("code"), F.col("item.name").alias("name"), "points", "exempt")


def parse_claim_blocks(df: DataFrame) -> DataFrame:
    """Claim, verdict (default 不正确), reason of blocks that open with ``#n ``, a line of ten dashes between claim and JSON; without a reason a block is dropped."""
    block = df.select(F.explode(F.split("text", r"(?m)(?=^#\d+ )")).alias("b")).where(F.col("b").rlike(r"^#\d+ "))
    claim = F.trim(F.regexp_extract("b", r"(?s)^#\d+ (.*?)\n-{10,}", 1))
    said = F.from_json(F.regexp_extract("b", r"(?s)-{10,}.*?(\{.*\})", 1), "`说法` string, `理由` string")
    return block.select(claim.alias("claim"), said.alias("j")).where((F.length("claim") > 0) & (F.length("j.`理由`") > 0)).select("claim", F.coalesce("j.`说法`", F.lit("不正确")).alias("verdict"), F.col("j.`理由`").alias("reason"))
