"""Every query with SQL against DuckDB on the smallest tables; the others for their shape."""

import os

import duckdb
import pandas as pd
import pytest

from carillon import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "missing"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)

    df = df[sorted(df.columns)]
    rows = [tuple(cell(v.item() if hasattr(v, "item") else v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    found = plans.QUERIES[name](spark, SF)
    rows = found.toPandas()
    assert len(set(found.columns)) == len(found.columns)
    if name in plans.ORACLE_SQL:
        known = db.sql(plans.ORACLE_SQL[name]).df()
        assert sorted(known.columns) == sorted(found.columns)
        assert _plain(rows) == _plain(known)
    else:
        assert len(plans.QUERIES[name](spark, SF.replace("0.001", "0.01")).take(1)) == 1
