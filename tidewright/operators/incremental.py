"""Monthly rollups that are kept as partial states of files, so that only new and changed files are read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_floor
from .rollup import MONTH

STAMP = "modified"


def listed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """file (as _metadata.file_path has it) and modified (its time and length) of the files that match; none is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    stamp = F.concat_ws("/", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    return found.select(F.col("_metadata.file_path").alias("file"), stamp.alias(STAMP))


def partial_state(rows: DataFrame, keys: list[str], date: str, measures: list[str], decimals: int | None = None) -> DataFrame:
    """file, keys, month and for each measure its sum, count, max and min: what every rollup can be finished from.

    Rows with a null key or date are left out, nulls are skipped. With decimals, sums are exact.
    """
    rows = rows.select("file", *keys, month_floor(date).alias(MONTH), *measures).dropna(subset=[*keys, MONTH])
    total = lambda m: F.sum(F.col(m).cast(f"decimal(38,{decimals})") if decimals is not None else F.col(m))
    return rows.groupBy("file", *keys, MONTH).agg(*[f(m).alias(f"{m}__{n}") for m in measures for n, f in (("sum", total), ("count", F.count), ("max", F.max), ("min", F.min))])


def merged(state: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """States added up over the columns `by`: sums and counts add, maxima and minima go on. It is associative."""
    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    return state.groupBy(*by).agg(*[f(f"{m}__{n}").alias(f"{m}__{n}") for m in measures for n, f in fold.items()])


def finished(state: DataFrame, spec: dict[str, tuple[str, str]]) -> list[Column]:
    """The outputs of spec (output to (measure, sum|mean|max|min|count)) of a state; a month of nulls sums to zero."""
    def out(measure: str, how: str) -> Column:
        if how == "mean":
            return (F.col(f"{measure}__sum").cast("double") / F.nullif(F.col(f"{measure}__count"), F.lit(0)))
        if how == "sum":
            return F.coalesce(F.col(f"{measure}__sum").cast("double"), F.lit(0.0))
        return F.col(f"{measure}__{how}")

    return [out(m, how).alias(o) for o, (m, how) in spec.items()]


def update(spark: SparkSession, state: str, folder: str, glob: str, read: Callable[[list[str]], DataFrame], keys: list[str], date: str, measures: list[str], decimals: int | None = None) -> list[str]:
    """Brings the state at `state` (a folder of the library's own) up to the files that match; returns those it read.

    read(files) gives the rows of the named files alone, with a column file. Files that are new, or whose time or length
    has changed, are rolled up, and the states of those that are gone are left out. The new state is written
    beside the old one under the next number, and is the state once it is whole, so a failed update changes nothing.
    """
    now = listed(spark, folder, glob)
    number, old = latest(spark, state)
    if old is None:
        fresh, kept = now, None
    else:
        known = old.select("file", STAMP).distinct()
        fresh, kept = now.join(known, ["file", STAMP], "left_anti"), old.join(now, ["file", STAMP], "left_semi")
    names = sorted(r["file"] for r in fresh.select("file").collect())  # a row a file to read
    if old is not None and not names and kept.select("file").distinct().count() == known.select("file").distinct().count():
        return []
    # a file without a row keeps a state without a month, so that it is not read each time
    part = fresh.join(partial_state(read(names), keys, date, measures, decimals), "file", "left")
    whole = part if kept is None else kept.unionByName(part)
    whole.write.parquet(f"{state}/{number + 1:08d}")
    return names


def latest(spark: SparkSession, state: str) -> tuple[int, DataFrame | None]:
    """The number and the rows of the last state that was written whole (Spark marks such a folder by _SUCCESS)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(state)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0, None
    names = [s.getPath().getName() for s in files.listStatus(root)]
    whole = [n for n in sorted(names) if n.isdecimal() and files.exists(hadoop.Path(f"{state}/{n}/_SUCCESS"))]
    number = max([int(n) for n in names if n.isdecimal()], default=0)
    return number, spark.read.parquet(f"{state}/{whole[-1]}") if whole else None


def monthly(spark: SparkSession, state: str, keys: list[str], spec: dict[str, tuple[str, str]], files: str = "merged") -> DataFrame:
    """The rollup of the state: keys, month and the outputs of spec.

    files: "merged" adds the files up (a mean weighs rows); "apart" keeps a row for each file; "means" takes the
    unweighted mean over the files' own outputs.
    """
    rows = latest(spark, state)[1].filter(F.col(MONTH).isNotNull())
    measures = sorted({m for m, _ in spec.values()})
    if files == "merged":
        both = merged(rows, [*keys, MONTH], measures)
        return both.select(*keys, MONTH, *finished(both, spec))
    each = rows.select("file", *keys, MONTH, *finished(rows, spec))
    if files == "apart":
        return each.drop("file")
    return each.groupBy(*keys, MONTH).agg(*[F.avg(o).alias(o) for o in spec])
