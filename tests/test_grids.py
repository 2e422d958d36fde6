import datetime as dt
import glob
import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewright.plans import monthly, queries
from tidewright.sources import grids

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Labelled:
    """A dataset in memory with the parts of one that are read: named axes, slices along one, values."""

    def __init__(self, dims, values, coords, name="dis24"):
        self.dims, self.values, self.coords, self.data_vars = dims, values, coords, ["crs", name]

    def __getitem__(self, name):
        return Labelled((name,), self.coords[name], {}) if name in self.coords else Labelled(self.dims, self.values, self.coords)

    def isel(self, at):
        ((axis, part),) = at.items()
        return Labelled(self.dims, self.values[tuple(part if d == axis else slice(None) for d in self.dims)], self.coords)

    def transpose(self, *dims):
        return Labelled(dims, np.transpose(self.values, [self.dims.index(d) for d in dims]), self.coords)


def opened(path, variable=None):
    content = open(path.removeprefix("file:").replace("//", "/"), "rb").read()
    if content.startswith(b"bad"):
        raise OSError("not a grid")
    times = np.array(["2020-01-01", "2020-01-02", "2020-02-01"], "M8[ns]")
    values = np.arange(18, dtype="f4").reshape(2, 3, 3)
    grid = grids.LabelledGrid(Labelled(("latitude", "time", "lon"), values, {"time": times, "valid_time": times, "latitude": np.array([1.0, 2.0]), "lon": np.array([3.0, 4.0, 5.0])}), variable)
    if content.startswith(b"late"):  # the last of its steps cannot be read
        whole = grid.cells
        grid.cells = lambda a, b, c: whole(a, b, c) if b < 3 else 1 / 0
    return grid


@pytest.fixture
def folder(tmp_path):
    for name, content in {"glofas_1.nc": b"good", "glofas_2.nc": b"bad", "glofas [3] x.nc": b"late", "other.txt": b"good"}.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_labelled_grids():
    grid = opened.__globals__["grids"].LabelledGrid(Labelled(("valid_time",), np.array([1.0, 2.0]), {"valid_time": np.array(["2020-01-01", "2020-01-02"], "M8[ns]")}))
    assert grid.cells(1, 2, ("value",))["value"].to_pylist() == [2.0] and len(grid.times) == 2
    still = grids.LabelledGrid(Labelled(("lat",), np.array([1.0, 4.0]), {"lat": np.array([1.0, 2.0]), "time": np.array(["2020-01-01"], "M8[ns]")}))
    assert still.cells(0, 1, ("lat",))["lat"].to_pylist() == [1.0, 2.0]
    with pytest.raises(ValueError, match="no time"):
        grids.LabelledGrid(Labelled(("lat",), np.array([1.0]), {"lat": np.array([1.0])}))


@pytest.mark.parametrize(("cells", "tasks"), [(1, 7), (12, 5), (1000, 3)])
def test_steps_of_files(spark, folder, cells, tasks):
    df = grids.read_grids(spark, folder, "glofas*.nc", opener=opened, cells=cells)
    assert df.rdd.getNumPartitions() == tasks
    rows = [r for r in df.collect() if r.file.endswith("_1.nc")]
    want = [(dt.datetime(2020, *d), lat, lon, float(9 * i + 3 * k + j)) for k, d in enumerate(((1, 1), (1, 2), (2, 1))) for i, lat in enumerate((1.0, 2.0)) for j, lon in enumerate((3.0, 4.0, 5.0))]
    assert sorted((r.time, r.lat, r.lon, r.value) for r in rows) == sorted(want) and {r.error for r in rows} == {None}
    errors = {r.file.rpartition("/")[2]: r.error for r in df.filter("error is not null").collect()}
    assert set(errors) == {"glofas_2.nc", "glofas [3] x.nc"} and errors["glofas_2.nc"] == "OSError: not a grid" and "ZeroDivisionError" in errors["glofas [3] x.nc"]
    good = grids.whole_files(df)
    assert {r.file.rpartition("/")[2] for r in good.select("file").distinct().collect()} == {"glofas_1.nc"} and good.count() == 18
    month = monthly.discharge_by_month(good).orderBy("month_start").collect()
    assert [r.glofas_discharge_m3s for r in month] == [np.mean([np.mean([0, 1, 2, 9, 10, 11]), np.mean([3, 4, 5, 12, 13, 14])]), np.mean([6, 7, 8, 15, 16, 17])]


def test_filters_choose_the_steps(spark, folder):
    df = grids.read_grids(spark, folder, "glofas*.nc", opener=opened, cells=1)
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    tasks = lambda x: x.rdd.getNumPartitions()
    january = df.filter((F.col("time") > at("2020-01-01")) & (F.col("time") < at("2020-02-01")))
    assert tasks(df) == 7 and tasks(january) == 2  # one step of each file that opens; the bad file gives no row with a time
    assert sorted((r.file[-4:], r.value) for r in january.collect()) == sorted((f, float(v)) for f in ("1.nc", "x.nc") for v in (3, 4, 5, 12, 13, 14) for f in [f[-4:]])
    assert tasks(df.filter(F.col("time") == at("2020-02-01"))) == 2 and df.filter(F.col("time") == at("2020-02-01")).count() == 6
    one = next(r.file for r in df.select("file").distinct().collect() if r.file.endswith("_1.nc"))
    assert tasks(df.filter(F.col("file") == one)) == 3 and df.filter(F.col("file") == one).count() == 18
    assert df.filter(F.col("time") > at("2030-01-01")).count() == 0
    assert df.filter("value > 15").count() == 2 and df.filter("time is null").count() == 2
    assert df.filter((F.col("time") <= at("2020-01-01")) | F.col("error").isNotNull()).count() == 14


def test_columns_and_missing_error_column(spark, folder):
    df = grids.read_grids(spark, folder, "glofas_1.nc", opener=opened, columns=("time", "value"))
    assert df.columns == ["time", "value"] and df.count() == 18
    with pytest.raises(Exception, match="OSError: not a grid"):
        grids.read_grids(spark, folder, "glofas_2.nc", opener=opened, columns=("time", "value")).count()
    assert grids.read_grids(spark, folder, "none*.nc").count() == 0


def test_cell_files_read_the_row_groups_that_are_asked_for(spark, tmp_path):
    times = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=k // 4) for k in range(400)]
    table = pa.table({"time": pa.array(times, pa.timestamp("us")), "lat": np.arange(400.0) % 2, "lon": np.arange(400.0) % 4, "q": np.arange(400.0), "other": ["x"] * 400})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=30)
    df = grids.read_grids(spark, str(tmp_path), "*.parquet", opener=grids.CellFile, cells=40)
    assert df.rdd.getNumPartitions() == 10 and sorted(r.value for r in df.collect()) == list(range(400))
    some = df.filter(F.col("time") >= F.lit("2020-01-04 10:00:00").cast("timestamp_ntz"))
    assert some.rdd.getNumPartitions() == 2 and sorted(r.value for r in some.collect()) == list(range(328, 400))
    file = grids.CellFile(str(tmp_path / "a.parquet"))
    seen, read = [], file.file.read_row_groups

    class Watched:
        def __getattr__(self, name):
            return getattr(file_, name)

        def read_row_groups(self, groups, names):
            seen.append((groups, names))
            return read(groups, names)

    file_, file.file = file.file, Watched()
    assert file.cells(10, 20, ("value",))["value"].to_pylist() == list(range(40, 80)) and seen == [([1, 2], ["time", "q"])]
    with pytest.raises(ValueError, match="ascend"):
        pq.write_table(table.take(list(range(399, -1, -1))), tmp_path / "b.parquet")
        grids.CellFile(str(tmp_path / "b.parquet"))


def test_tasks_share_no_row_group_and_read_no_time_axis(spark, tmp_path, monkeypatch):
    times = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=k // 4) for k in range(400)]
    table = pa.table({"time": pa.array(times, pa.timestamp("us")), "q": np.arange(400.0)})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=400)
    df = grids.read_grids(spark, str(tmp_path), "*.parquet", opener=grids.CellFile, cells=4)
    assert df.rdd.getNumPartitions() == 1 and sorted(r.value for r in df.collect()) == list(range(400))
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=6)  # steps lie across row groups
    df = grids.read_grids(spark, str(tmp_path), "*.parquet", opener=grids.CellFile, cells=4)
    assert df.rdd.getNumPartitions() == 100 and sorted((r.time, r.value) for r in df.collect()) == sorted(zip(times, map(float, range(400)), strict=True))
    reader = grids.GridReader({"files": "[]", "columns": "value", "cells": "4"}, grids.CellFile)
    part = reader.plan(f"file:{tmp_path}/a.parquet")[7]
    monkeypatch.setattr(grids.CellFile, "axis", property(lambda self: 1 / 0))
    (batch,) = reader.read(part)
    assert batch.column(0).to_pylist() == [28.0, 29.0, 30.0, 31.0]


@pytest.mark.parametrize(("name", "error"), [("glofas_2.nc", "OSError: not a grid"), ("glofas*3*x.nc", "ZeroDivisionError")])
def test_a_filter_on_time_hides_no_failure(spark, folder, name, error):
    df = grids.read_grids(spark, folder, name, opener=opened, columns=("file", "time", "value"))
    at = F.lit("2020-01-02").cast("timestamp_ntz")
    for some in (df.filter(F.col("time") >= at), df.filter("time is not null"), monthly.discharge_by_month(df)):
        with pytest.raises(Exception, match=error):
            some.collect()


@pytest.mark.parametrize("failure", ["cut", "unordered", "gone"])
def test_gridded_monthly_mean_fails_with_a_file_of_cells(spark, monkeypatch, failure):
    def broken(spark, folder):
        to = cell_files(spark, folder)
        path = sorted(glob.glob(f"{to.removeprefix('file:')}/*/year=1995/*.parquet"))[0]
        if failure == "gone":  # once the files are listed
            gone.append(path)
        elif failure == "unordered":
            table = pq.ParquetFile(path).read()
            pq.write_table(table.take(list(range(len(table) - 1, -1, -1))), path)
        else:
            with open(path, "r+b") as f:
                f.truncate(1000)
        return to

    gone, cell_files = [], queries.cell_files
    monkeypatch.setattr(queries, "cell_files", broken)
    df = queries.gridded_monthly_mean(spark, "/root/testdata/sf0.001")
    for path in gone:
        os.remove(path)
    with pytest.raises(Exception, match="rows do not ascend" if failure == "unordered" else "year=1995"):
        df.collect()
