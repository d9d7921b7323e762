"""The registered training-data queries: against DuckDB where they have SQL, else that they run, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import rows_of  # noqa: E402
from compframe.llm.checks import CHECKS  # noqa: E402
from compframe.llm.queries import QUERIES  # noqa: E402


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {*QUERIES, "pipeline"} <= names and set(CHECKS) <= set(entry.oracle_sql())
    assert [len([n for n in names if n.startswith(f"op{i}_")]) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, small)
    rel = con.execute(CHECKS[name])
    want, columns = rows_of([d[0] for d in rel.description], rel.fetchall())
    got, have = rows_of(df.columns, df.collect())
    assert have == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & {*QUERIES, "pipeline"} - set(CHECKS)))
def test_query_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0
