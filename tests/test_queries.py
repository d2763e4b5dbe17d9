"""Every registered query of the knowledge base against its SQL twin in DuckDB, over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from lorebase.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(str(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
