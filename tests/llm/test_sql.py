import duckdb
import numpy as np
import pytest

from tidewright.llm import registry


@pytest.fixture(scope="module")
def odd_folder(spark, odd, tmp_path_factory):
    """The odd rows as a table; without repeated ids, as the SQL tells documents apart by them."""
    folder = tmp_path_factory.mktemp("odd")
    odd.dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(9)
    near = [(v := rng.normal(size=8)) + rng.normal(size=8) * 0.03 * k for _ in range(12) for k in range(4)]
    rows = [(k, x.tolist(), None if k % 11 == 0 else k % 2) for k, x in enumerate(near)] + [(100, [0.0] * 8, 1), (101, None, 1), (102, [1.0, None], 1), (103, near[1].tolist(), 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def same(spark, name, folder, pattern):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet{pattern}')")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = registry.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [str(x) for x in r]
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    assert got == sorted(cur.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same(spark, name, sf, "")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_odd_rows_same_as_sql(spark, odd_folder, name):
    same(spark, name, odd_folder, "/*.parquet")
