"""Findings of round 4: whole results, and what the driver and the disk once held too much of."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorebase.operators import graph, retrieval
from lorebase.plans import QUERIES, SQL
from lorebase.plans.queries import graph_edges
from tests.test_scale_r03 import metric_rows

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_hybrid_search_returns_more_than_twenty_rows(spark, tmp_path):
    """Seven rows by vector and fifteen by keyword, each in a book of its own: the query once kept twenty of these."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    texts = "range AS doc_id, 'text ' || md5(range::VARCHAR) || CASE WHEN range >= 1000 THEN ' quantity' ELSE '' END AS text, 'en' AS lang, 's' || range AS source, 40::BIGINT AS n_chars"
    tables = {
        "benchmark": "SELECT 0::BIGINT AS item_id, 'quantity beacon' AS text",
        "documents": f"SELECT {texts} FROM (SELECT range FROM range(105, 112) UNION ALL SELECT range FROM range(203, 250, 10) UNION ALL SELECT range FROM range(1000, 1015))",
        "embeddings": f"SELECT * EXCLUDE (range) REPLACE (range AS vec_id, [1.0, 0.001 * range] AS embedding) FROM (SELECT * FROM '{DATA}/embeddings.parquet' LIMIT 1), (SELECT range FROM range(105, 112) UNION ALL SELECT 0)",
        "supplier": f"SELECT * REPLACE (CASE s_suppkey WHEN 3 THEN 'Beacon' ELSE 'none' END AS s_name) FROM '{DATA}/supplier.parquet'",
        "region": f"SELECT * FROM '{DATA}/region.parquet'",
        "nation": f"SELECT * FROM '{DATA}/nation.parquet'",
    }
    for name, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(db.execute(f"SELECT query_id, id, rank, source FROM ({SQL['hybrid_search']})").fetchall())
    found = QUERIES["hybrid_search"](spark, str(tmp_path))
    joins = found._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins <= 3  # 19 before: the whole search was planned again in the last step, and held by the driver
    got = sorted(tuple(r) for r in found.select("query_id", "id", "rank", "source").collect())
    assert got == want
    assert sum(r[0] == 0 for r in got) == 22


def test_link_entities_meets_blocks_of_ids(spark, monkeypatch):
    """Passages were once repeated for each shuffle partition."""
    passages = spark.range(0, 1000).select("id", F.lit(1).alias("doc_id"))
    got = graph.link_entities(spark.createDataFrame([(5, 1)], "id long, doc_id int"), passages)
    assert got.count() == 1000
    assert metric_rows(got) <= 1000  # 4,000 before
    monkeypatch.setattr(graph, "BLOCK", 8)
    e = [(i, d) for i in [None, *range(30)] for d in ((1, 2) if i and i % 3 == 0 else (1,))]
    p = [(f"p{i:04d}", d) for i in range(600) for d in ((1, 2, 2) if i % 5 == 0 else (2 if i % 7 == 0 else 1,))]
    got = graph.link_entities(spark.createDataFrame(e, "id int, doc_id int"), spark.createDataFrame(p, "id string, doc_id int"))
    assert got.dtypes == [("entity_id", "int"), ("passage_id", "string")]
    want = {(a, b) for a, d in e for b, x in p if d == x}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert graph.link_entities(spark.createDataFrame([], "id int, doc_id int"), passages).count() == 0


def all_stages(spark) -> dict[int, tuple[int, int]]:
    """Of each stage so far the rows that it wrote to shuffles, and the bytes of its tasks' results, which the driver takes."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {s.stageId(): (s.shuffleWriteRecords(), s.resultSize()) for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_edge_details_shuffle_edges_a_few_times(spark):
    """Edges were once grouped four times over, and shuffled for exceptions that do not occur; a small threshold stands for large tables."""
    d = str(DATA.parent / "sf0.01")
    edges = graph_edges(spark, d).count()
    before = all_stages(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        QUERIES["k_hop_edge_details"](spark, d).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(rows for k, (rows, _) in all_stages(spark).items() if k not in before) <= 6 * edges  # 11.7 times before


def test_prefix_dedup_draws_bounded_bytes_of_starts(spark, monkeypatch):
    """Spark's own ranges bring 300 whole starts for each shuffle partition to the driver."""
    monkeypatch.setattr(retrieval, "DRAWN_BYTES", 64 << 10, raising=False)
    text = F.concat(F.sha2((F.col("id") % 3000).cast("string"), 256), F.repeat(F.lit("x"), 4000), F.when(F.col("id") < 3000, "").otherwise("tail"))
    ranked = graph.stored(spark.range(0, 4000).select((F.col("id") % 2).alias("query_id"), (F.col("id") + 1).cast("int").alias("rank"), "id", text.alias("content")), "ranked")
    before = all_stages(spark)
    kept = {r.id for r in retrieval.prefix_dedup(ranked).select("id").collect()}
    assert kept == set(range(3000))
    most = max(size for k, (_, size) in all_stages(spark).items() if k not in before)
    assert most < 400_000  # 3,022,201 before
