"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from equiscreen import bindings, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in bindings.TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(df):
    def cell(v):
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_formatted_beyond_a_trillion(spark, tmp_path):
    """The SQL says billions at most; keys of larger tables reach a trillion."""
    con = duckdb.connect()
    con.execute(f"copy (select k as c_custkey, k % 7 as c_nationkey from (values (31), (32), (990), (31249), (31250), (31251), (900000), (1500000)) t(k)) to '{tmp_path}/customer.parquet'")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    assert rows(queries.QUERIES["formatted"](spark, str(tmp_path)).toPandas()) == rows(con.execute(queries.SQL["formatted"]).df())


@pytest.mark.parametrize("name", ["stage3_topn", "stage3_recoverable"])
def test_best_rows_do_not_copy_the_cascade(spark, name):
    """Conditions on the cascade's results are not pushed below it as copies of its rules (1.3 million characters once)."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


def test_fewer_recoverable_rows_than_asked_for(spark):
    from equiscreen.operators import stages

    made = [("A", 50.0, "WATCHLIST", "X"), ("B", 99.0, "PASSED", ""), ("C", 50.0, "REJECTED", "Y"), ("D", None, "REJECTED", "Y"), ("E", 60.0, None, "Y"), ("F", 61.0, "WATCHLIST", None), ("G", 40.0, "PASSED", "")]
    df = spark.createDataFrame(made, "ticker string, final_stage3_score double, stage3_status string, stage3_primary_reason string")
    assert [r["ticker"] for r in stages.top_recoverable(df).collect()] == ["A", "C", "D"] and [r["ticker"] for r in stages.top_recoverable(df, 1).collect()] == ["A"]
    found = stages.top_candidates(df, 9)
    assert [r["ticker"] for r in found.collect()] == ["B", "F", "A", "G"] and found.columns == df.columns
