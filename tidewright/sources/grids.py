"""Gridded files as a data source that is planned in ranges of time steps."""

from __future__ import annotations

import functools
import importlib
import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..session import ship
from .named_files import store

COLUMNS = {"file": "string", "time": "timestamp_ntz", "lat": "double", "lon": "double", "value": "double", "error": "string"}
ARROW = {"file": pa.string(), "time": pa.timestamp("us"), "lat": pa.float64(), "lon": pa.float64(), "value": pa.float64(), "error": pa.string()}
#: Cells of a partition, about, and files whose time axes are read at once when a scan is planned.
CELLS, THREADS = 1 << 20, 16
COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class LabelledGrid:
    """A variable (the first that is not crs unless named) of a dataset with labelled axes, such as xarray's."""

    def __init__(self, dataset, variable: str | None = None):
        name = variable or next(v for v in dataset.data_vars if v != "crs")
        self.dataset, self.axis = dataset, next((t for t in ("time", "valid_time") if t in dataset.coords), None)
        if self.axis is None:
            raise ValueError(f"no time among {list(dataset.coords)}")
        self.values = dataset[name]
        self.places = {c: next((n for n in names if n in self.values.dims), None) for c, names in (("lat", ("lat", "latitude")), ("lon", ("lon", "longitude")))}
        self.times = np.atleast_1d(np.asarray(dataset[self.axis].values)).astype("datetime64[us]")
        if self.axis not in self.values.dims:
            self.times = self.times[:1]
        self.area = math.prod(len(self.axis_values(d)) for d in self.places.values() if d)

    def axis_values(self, name: str) -> np.ndarray:
        return np.atleast_1d(np.asarray(self.dataset[name].values))

    def cells(self, start: int, stop: int, columns: tuple[str, ...]) -> dict[str, pa.Array]:
        """The columns of the steps from start to stop; of the places only those asked for are made."""
        by_time = self.axis in self.values.dims
        part = self.values.isel({self.axis: slice(start, stop)}) if by_time else self.values
        own = {c: d for c, d in self.places.items() if d}
        values = np.asarray(part.transpose(*([self.axis] if by_time else []), *own.values()).values, "f8")
        lengths = [stop - start, *[len(self.axis_values(d)) for d in own.values()]]
        values = values.reshape(lengths)

        def spread(axis: np.ndarray, at: int) -> np.ndarray:
            return np.broadcast_to(axis.reshape([-1 if k == at else 1 for k in range(len(lengths))]), lengths).ravel()

        out = {"time": pa.array(spread(self.times[start:stop], 0), pa.timestamp("us")), "value": pa.array(values.ravel())}
        for at, (c, d) in enumerate(own.items(), 1):
            if c in columns:
                out[c] = pa.array(spread(self.axis_values(d).astype("f8"), at))
        return out


class CellFile:
    """A Parquet file of cells (time, lat, lon and values), whose rows ascend by time. To plan, only the time column is
    read, a row group at a time; a task then reads the row groups that hold its rows, and no time axis. `least` keeps
    tasks from sharing a row group among many of them, as each would read all of it."""

    def __init__(self, path: str, variable: str | None = None, planned: bool = False):
        """planned: rows are known, and the time axis is not read."""
        import pyarrow.parquet as pq

        files, place = store(path)
        self.file = pq.ParquetFile(files.open_input_file(place))
        names = self.file.schema_arrow.names
        self.variable = variable or next(n for n in names if n not in ("time", "lat", "lon"))
        if "time" not in names:
            raise ValueError(f"no time among {names}")
        groups = [self.file.metadata.row_group(k).num_rows for k in range(self.file.num_row_groups)]
        self.ends, self.least = np.cumsum([0, *groups]), max(groups, default=0)
        if not planned:
            self.axis  # noqa: B018

    @functools.cached_property
    def axis(self) -> tuple[np.ndarray, np.ndarray]:
        """The steps, and the first row of each, with the number of rows behind them."""
        times, rows = [np.zeros(0, "M8[us]")], [np.zeros(0, "i8")]
        for k in range(self.file.num_row_groups):
            time = self.file.read_row_group(k, ["time"]).column(0).cast(pa.timestamp("us")).to_numpy()
            if len(time) and ((time[1:] < time[:-1]).any() or (len(times[-1]) and time[0] < times[-1][-1])):
                raise ValueError("rows do not ascend by time")
            new = np.flatnonzero(np.append(np.ones(min(1, len(time)), bool), time[1:] != time[:-1]))
            if len(new) and len(times[-1]) and time[0] == times[-1][-1]:
                new = new[1:]
            if len(new):
                times.append(time[new])
                rows.append(new + self.ends[k])
        return np.concatenate(times), np.append(np.concatenate(rows), self.ends[-1])

    @property
    def times(self) -> np.ndarray:
        return self.axis[0]

    @property
    def area(self) -> int:
        return max(1, int(self.ends[-1]) // max(1, len(self.times)))

    def extent(self, start: int, stop: int) -> tuple[int, int]:
        """The rows of the steps from start to stop."""
        return int(self.axis[1][start]), int(self.axis[1][stop])

    def cells(self, start: int, stop: int, columns: tuple[str, ...]) -> dict[str, pa.Array]:
        return self.between(*self.extent(start, stop), columns)

    def between(self, begin: int, end: int, columns: tuple[str, ...]) -> dict[str, pa.Array]:
        """The columns of the rows from begin to end."""
        groups = list(range(int(np.searchsorted(self.ends, begin, "right")) - 1, int(np.searchsorted(self.ends, end, "left"))))
        names = ["time", *[c for c in ("lat", "lon") if c in columns and c in self.file.schema_arrow.names], self.variable]
        before = int(self.ends[groups[0]])
        table = self.file.read_row_groups(groups, names).slice(begin - before, end - begin).combine_chunks()
        return {("value" if n == self.variable else n): table.column(n).combine_chunks().cast(ARROW["value" if n == self.variable else n]) for n in names}


def labelled(path: str, variable: str | None = None) -> LabelledGrid:
    """A file that xarray can open, where that is installed."""
    files, place = store(path)
    local = type(files).__name__ == "LocalFileSystem"
    return LabelledGrid(importlib.import_module("xarray").open_dataset(place if local else files.open_input_file(place)), variable)


class Steps(InputPartition):
    def __init__(self, file: str, start: int, stop: int, error: str | None = None, rows: tuple[int, int] | None = None):
        self.file, self.start, self.stop, self.error, self.rows = file, start, stop, error, rows


class GridReader(DataSourceReader):
    """Plans (file, range of time steps) partitions of about CELLS cells. To plan, the time axes alone are read. Filters on
    time and file choose the steps, so that a step that is not asked for is never read."""

    def __init__(self, options: dict, opener: Callable):
        self.files, self.variable = json.loads(options["files"]), options.get("variable")
        self.cells, self.columns, self.opener = int(options.get("cells", CELLS)), tuple(options["columns"].split(",")), opener
        self.times: list[Filter] = []
        self.names: set[str] | None = None
        self.loud = "error" not in self.columns  # nothing but a failure of the query tells of an error
        self.sound = False  # only rows with a time are asked for, so none with an error

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            about = getattr(f, "attribute", None)
            if about == ("time",) and type(f) in COMPARE and f.value is not None:
                self.times.append(f)
                self.sound = True
            elif about == ("time",) and isinstance(f, IsNotNull):
                self.sound = True
            elif about == ("file",) and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = values if self.names is None else self.names & values
            else:
                yield f

    def plan(self, file: str) -> list[InputPartition]:
        try:
            grid = self.opener(file, self.variable)
            asked = np.ones(len(grid.times), bool)
            for f in self.times:
                asked &= COMPARE[type(f)](grid.times, np.datetime64(f.value, "us"))
            steps, out = max(1, max(self.cells, getattr(grid, "least", 0)) // max(1, grid.area)), []
            rows = getattr(grid, "extent", lambda start, stop: None)
            for run in np.split(np.flatnonzero(asked), np.flatnonzero(np.diff(np.flatnonzero(asked)) > 1) + 1):
                parts = [(int(run[k]), int(run[min(k + steps, len(run)) - 1]) + 1) for k in range(0, len(run), steps)]
                out += [Steps(file, *part, rows=rows(*part)) for part in parts]
            return out
        except Exception as e:  # a file that cannot be opened is a row with its error
            return [] if self.sound and not self.loud else [Steps(file, 0, 0, f"{type(e).__name__}: {e}")]

    def partitions(self) -> list[InputPartition]:
        asked = [f for f in self.files if self.names is None or f in self.names]
        with ThreadPoolExecutor(THREADS) as pool:
            out = [p for parts in pool.map(self.plan, asked) for p in parts]
        return out or [Steps("", 0, 0)]

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        if partition.stop == partition.start and not partition.error:
            return
        error, found, n = partition.error, {}, 1
        if not error:
            try:
                if partition.rows:
                    found = self.opener(partition.file, self.variable, planned=True).between(*partition.rows, self.columns)
                else:
                    found = self.opener(partition.file, self.variable).cells(partition.start, partition.stop, self.columns)
                n = len(found["value"])
            except Exception as e:  # the range is a row with its error; other ranges are read
                error = f"{type(e).__name__}: {e}"
        if error and self.loud:
            raise RuntimeError(f"{partition.file}: {error}")
        if error and self.sound:
            return
        fixed = {"file": partition.file, "error": error}
        columns = [found[c] if c in found and not error else pa.array([fixed[c]] * n, ARROW[c]) if fixed.get(c) is not None else pa.nulls(n, ARROW[c]) for c in self.columns]
        yield pa.record_batch(columns, list(self.columns))


class GridFiles(DataSource):
    """Format grid_files. Options: files (JSON list), columns, variable, cells. Its opener makes a grid (times, area, cells())
    of a path and a variable."""

    opener: Callable = staticmethod(labelled)

    @classmethod
    def name(cls) -> str:
        return "grid_files"

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c]}" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(dict(self.options), type(self).opener)


def read_grids(spark: SparkSession, folder: str, glob: str = "*.nc", variable: str | None = None, opener: Callable = labelled, columns: tuple[str, ...] = tuple(COLUMNS), cells: int = CELLS) -> DataFrame:
    """file, time, lat, lon, value and error (or the `columns` of these) of the gridded files that match.

    A task reads a range of time steps of one file, some `cells` cells. Filters on time and file are pushed into the plan
    (spark.sql.python.filterPushdown.enabled is set in the session for that). A range that fails gives one row with its
    error and none of its cells; without an error column it fails the query, whatever the filters on time (a file that
    does not open may hold any time). With one, a filter on time leaves out the rows with an error, as they have none.
    whole_files() leaves out what else a file with an error gave, and goes before filters on time. opener makes a grid
    of a path and a variable: by default what xarray can open.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").inputFiles()
    spark.dataSource.register(type("GridFiles", (GridFiles,), {"opener": staticmethod(opener)}))
    options = {"files": json.dumps(sorted(unquote(f) for f in found)), "columns": ",".join(columns), "cells": str(cells)}
    return spark.read.format("grid_files").options(**options, **({"variable": variable} if variable else {})).load()


def whole_files(cells: DataFrame) -> DataFrame:
    """The cells of files without an error."""
    failed = cells.filter("error is not null").select("file").distinct()
    return cells.filter("error is null").join(failed, "file", "left_anti")
