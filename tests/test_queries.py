import math

import duckdb
import pytest

from tidewright.plans.oracle import ORACLE_SQL
from tidewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS = {"feature_pipeline": 77, "outer_join_two_keys": 487, "outer_join_chain": 84, "lag_features": 80, "request_grid": 7 * 366, "explode_cross_product": 32_000}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    return (1, f"{v:.9g}" if isinstance(v, float) else str(v))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(normal(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall())
    assert len(got) == ROWS.get(name, len(got)) and got == want


def test_no_python_in_plans(spark):
    for name, f in QUERIES.items():
        if name == "gridded_monthly_mean":  # reads through a Python data source
            continue
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow")), name


def test_aggregates_are_combined_before_their_shuffle(spark):
    plan = QUERIES["monthly_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
