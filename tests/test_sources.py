"""Sources: tables from a database as from Parquet, and losses counted in the pass that reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.operators import feedback
from lorebase.plans import text_queries
from lorebase.sources import io

URL = "jdbc:derby:memory:kb;create=true"


def tables(spark):
    docs = spark.range(1, 2001).select("id", F.concat(F.lit("题 "), "id").alias("title"), F.array(F.lit("a"), F.col("id").cast("string")).alias("keywords"), (F.col("id") % 3).cast("int").alias("level"), F.when(F.col("id") > 10, F.col("id") % 10).alias("parent_id"), (F.col("id") % 7 != 3).alias("enabled"))
    passages = spark.range(500).select("id", (F.col("id") % 50).alias("doc_id"), F.when(F.col("id") % 4 > 0, F.array(F.lit(0.5), F.col("id").cast("float")).cast("array<float>")).alias("embedding"), F.lit("text").alias("content"), F.lit(True).alias("enabled"))
    rules = spark.sql("SELECT 'A.1' AS note_qc_code, CAST(3 AS BIGINT) AS doc_id, array(CAST(1 AS BIGINT)) AS passage_ids, 2 AS relevance, 'x' AS source, true AS enabled")
    return {"docs": docs, "passages": passages, "rule_doc_map": rules, "communities": spark.createDataFrame([], io.SCHEMAS["communities"])}


def whole(df, name):
    """All columns of the fixed schema, missing ones null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(io.SCHEMAS[name]).fields))


@pytest.mark.parametrize("enabled", [True, False])
def test_database_and_parquet_give_the_same_rows(spark, tmp_path, enabled):
    names = list(tables(spark))
    for n, df in tables(spark).items():
        whole(df, n).write.parquet(str(tmp_path / n))
        flat = df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns))
        flat.write.format("jdbc").option("url", URL).option("dbtable", f'"{n}"').mode("overwrite").save()
    files, base = io.read_kb(spark, str(tmp_path), names, enabled), io.read_kb_jdbc(spark, URL, names, enabled, 4)
    for n in names:
        assert base[n].schema.simpleString() == files[n].schema.simpleString()
        assert sorted(map(str, base[n].collect())) == sorted(map(str, files[n].collect()))
    assert base["docs"].rdd.getNumPartitions() == 4 and base["docs"].count() == (1714 if enabled else 2000)
    plan = base["docs"].where("id = 5").select("title")._jdf.queryExecution().simpleString()
    assert "*EqualTo(id,5)" in plan and "ReadSchema: struct<title:string>" in plan


def test_malformed_lines_are_counted_in_the_same_pass(spark, tmp_path):
    spark.createDataFrame([('{"x": 1}',), ("{broken",), ("",), ('{"x": 2, "y": "é"}',), ("[1]",), ('{"x": "no number"}',)], "value string").write.text(str(tmp_path / "l"))
    rows, seen = io.read_jsonl_counted(spark, str(tmp_path / "l"), "x int, y string")
    good, bad = io.read_jsonl(spark, str(tmp_path / "l"), "x int, y string")
    assert sorted(map(str, rows.collect())) == sorted(map(str, good.collect()))
    assert seen.get == {"rows": good.count(), "malformed": bad.count()} and seen.get["malformed"] == 3


def test_failed_batches_are_counted_in_the_same_pass(spark):
    def fn(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, " good text "), (2, "abc"), (3, "bad text"), (4, None), (5, "fine text")], "id int, text string").coalesce(1)
    rows, seen = feedback.embed_counted(df, fn, batch=1)
    assert {r.id: r.state for r in rows.collect()} == {1: "ok", 2: "skipped", 3: "failed", 4: "skipped", 5: "ok"}
    assert seen.get == {"ok": 2, "failed": 1, "skipped": 2}


def test_made_up_headings_leave_the_lines_whole(spark, tmp_path):
    long = "a line of far more than twenty characters, all of which count"
    texts = [long, "\n".join(f"{long} {i}" for i in range(23)), "", "\n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by: dict = {}
    for r in sorted(text_queries._lines(spark, str(tmp_path)).collect(), key=lambda r: r.line_no):
        by.setdefault(r.doc_id, []).append((r.line_no, r.text))
    for i, t in enumerate(texts):
        assert [n for n, _ in by[i]] == list(range(len(by[i])))
        assert [x for n, x in by[i] if n % 11 not in (0, 3, 6)] == t.split("\n")
