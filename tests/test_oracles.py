"""Every query against its SQL on the smallest tables."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

import tidewake.row_queries  # noqa: F401  registers the rest
from tidewake.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def _rows(rows: list[dict]) -> list[tuple]:
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[c]) for c in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, DATA).count() > 0
        return
    got = QUERIES[name](spark, DATA).toArrow().to_pylist()
    want = duck.sql(ORACLES[name])
    columns = want.columns
    assert _rows(got) == _rows([dict(zip(columns, r)) for r in want.fetchall()])
