"""Every query of the catalog with check SQL against DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import rows_of  # noqa: E402
from compframe.catalog import load  # noqa: E402

QUERIES, CHECKS = load()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rel = duck.execute(CHECKS[name])
    want, columns = rows_of([d[0] for d in rel.description], rel.fetchall())
    got, have = rows_of(df.columns, df.collect())
    assert have == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0


def test_output_rules_hold_for_the_export(spark, small):
    from compframe.operators.quality import invariants
    out = invariants(QUERIES["export_deals"](spark, small)).first()
    assert out.discount_without_comparables == 0 and out.discount_on_partial == 0
