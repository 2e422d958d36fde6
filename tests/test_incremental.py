import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import features, incremental, rollup
from tidewright.sources import files

SCHEMA = "station string, date date, v double"
SPEC = {"total": ("v", "sum"), "mean": ("v", "mean"), "hi": ("v", "max"), "lo": ("v", "min"), "n": ("v", "count")}


def put(folder, name, rows):
    (folder / name).write_text("station,date,v\n" + "".join(f"{s},2020-{m:02d}-{d:02d},{v}\n" for s, m, d, v in rows))


def table(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("decimals", [None, 1])
def test_three_loads_are_one_full_run(spark, tmp_path, decimals):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    asked = []

    def read(names):
        asked.append(sorted(n.rpartition("/")[2] for n in names))
        return files.read_csv(spark, str(folder), "*.csv", SCHEMA, file_column="file", only=names)

    def load():
        return sorted(n.rpartition("/")[2] for n in incremental.update(spark, state, str(folder), "*.csv", read, ["station"], "date", ["v"], decimals))

    put(folder, "a.csv", [("A", 1, 2, 1.5), ("A", 1, 9, 2.5), ("A", 2, 1, "NaN"), ("", 2, 1, 7)])
    put(folder, "b.csv", [("B", 1, 2, 4), ("A", 1, 3, 10)])
    put(folder, "empty.csv", [])
    assert load() == ["a.csv", "b.csv", "empty.csv"] and load() == []
    put(folder, "c.csv", [("A", 1, 30, 0.5), ("C", 12, 31, 3)])
    assert load() == ["c.csv"]
    put(folder, "b.csv", [("B", 1, 2, 4), ("B", 3, 2, 8), ("A", 1, 3, 20.5)])
    os.remove(folder / "a.csv")
    put(folder, "d.csv", [("A", 1, 1, 1)])
    assert load() == ["b.csv", "d.csv"] and load() == []
    assert asked == [["a.csv", "b.csv", "empty.csv"], ["c.csv"], ["b.csv", "d.csv"]]
    full = files.read_csv(spark, str(folder), "*.csv", SCHEMA, file_column="file")
    month = lambda **how: rollup.monthly_rollup(full, ["station"], "date", SPEC, decimals=decimals, **how)
    assert table(incremental.monthly(spark, state, ["station"], SPEC)) == table(month())
    assert table(incremental.monthly(spark, state, ["station"], SPEC, "apart")) == table(month(per_file="file"))
    means = rollup.mean_of_means(full, "file", ["station"], "date", "v", "q", decimals)
    assert table(incremental.monthly(spark, state, ["station"], {"q": ("v", "mean")}, "means")) == table(means)


def test_removed_file_and_failed_update(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    put(folder, "a.csv", [("A", 1, 2, 1)])
    put(folder, "b.csv", [("B", 1, 2, 2)])
    read = lambda names: files.read_csv(spark, str(folder), "*.csv", SCHEMA, file_column="file", only=names)
    args = (spark, state, str(folder), "*.csv")
    incremental.update(*args, read, ["station"], "date", ["v"])
    before = table(incremental.monthly(spark, state, ["station"], SPEC))
    put(folder, "c.csv", [("C", 1, 2, 3)])
    broken = lambda names: read(names).withColumn("v", F.when(F.col("v") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        incremental.update(*args, broken, ["station"], "date", ["v"])
    assert table(incremental.monthly(spark, state, ["station"], SPEC)) == before
    os.remove(folder / "a.csv")
    assert [n.rpartition("/")[2] for n in incremental.update(*args, read, ["station"], "date", ["v"])] == ["c.csv"]
    os.remove(folder / "b.csv")
    assert incremental.update(*args, read, ["station"], "date", ["v"]) == []
    assert [r.station for r in incremental.monthly(spark, state, ["station"], SPEC).collect()] == ["C"]


@pytest.mark.parametrize("part_rows", [1, 7, 100, 10_000])
def test_lags_by_range_are_those_of_one_window(spark, part_rows):
    rows = [(k, None if k % 17 == 0 else k * 7919 % 50, None if k % 5 == 0 else k / 2) for k in range(240)] + [(999, 3, 1.0)] * 9
    df = spark.createDataFrame(rows, "id int, t int, v double")
    window = Window.orderBy(F.col("t").asc_nulls_last(), "id")
    want = df.select("*", F.lag("v", 1).over(window).alias("v_lag_1"), F.lag("v", 5).over(window).alias("before"), F.lag("id", 2).over(window).alias("id_lag_2"))
    got = features.add_lags_by_range(df, "t", {"v": [1, 5], "id": [2]}, ("id",), {("v", 5): "before"}, part_rows)
    assert got.columns == want.columns and table(got) == table(want)
    if part_rows == 7:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Python" not in plan
    assert features.add_lags_by_range(df.limit(0), "t", {"v": [1]}).count() == 0
