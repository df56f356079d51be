"""Every query with SQL against DuckDB, and no query empty, on the middle test tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sigloom.plans import core_oracles, core_queries

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return "~"
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(map(tuple, df[sorted(df.columns)].map(one).values.tolist()))


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, duck, name):
    got = core_queries()[name](spark, D).toPandas()
    assert len(got)
    if sql := core_oracles().get(name):
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
