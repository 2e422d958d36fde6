"""Features of an aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_number
from ..session import written


def unit_convert(df: DataFrame, src: str, dst: str, factor: float = 0.64) -> DataFrame:
    return df.withColumn(dst, F.col(src) * F.lit(float(factor)))


def add_lags(df: DataFrame, order_by: str, lags: dict[str, list[int]], partition_by: tuple[str, ...] = (), names: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """Adds <column>_lag_<k>: the value k rows before (not k months before), within partition_by.

    One window, so one sort. Without partition_by all rows meet in one task: meant for a monthly series, which has
    some hundreds; give the station for many series.
    """
    window = Window.partitionBy(*partition_by).orderBy(F.col(order_by).asc_nulls_last())
    return df.withColumns({(names or {}).get((c, k), f"{c}_lag_{k}"): F.lag(c, k).over(window) for c, ks in lags.items() for k in ks})


def add_lags_by_range(df: DataFrame, order_by: str, lags: dict[str, list[int]], ties: tuple[str, ...] = (), names: dict[tuple[str, int], str] | None = None, part_rows: int = 200_000) -> DataFrame:
    """As add_lags over one series of any length: no task sorts much more than `part_rows` rows, nor a single one all.

    Rows are dealt into ranges of order_by (nulls last), then of the columns `ties`, then of a hash of the row, so that
    a date that many rows share is split too; the order is the same in every run. Each range gets the last rows before
    it, as many as the longest lag, from the ranges before: a range with fewer rows passes on those before it.
    """
    spark, longest = df.sparkSession, max((k for ks in lags.values() for k in ks), default=0)
    df = df.withColumn("_hash", F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]))
    order = [F.col(order_by).isNull().alias("_null"), F.col(order_by), *map(F.col, ties), F.col("_hash")]
    rows = written(df)
    parts = max(1, -(-rows.count() // part_rows))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    ends = {r["_part"]: r["end"] for r in ranged.groupBy("_part").agg(F.max("_place").alias("end")).collect()}  # a row a range
    filled = sorted(ends)
    following = [(p, ends[p], filled[k + 1 : k + 1 + longest]) for k, p in enumerate(filled)]
    sizes = F.broadcast(spark.createDataFrame(following, "_part int, _end long, _next array<int>"))
    last = ranged.join(sizes, "_part").filter(F.col("_place") > F.col("_end") - longest).withColumn("_part", F.explode("_next")).drop("_end", "_next")
    both = ranged.withColumn("_own", F.lit(True)).unionByName(last.withColumn("_own", F.lit(False)))
    window = Window.partitionBy("_part").orderBy("_place")  # places ascend over ranges as well
    out = both.withColumns({(names or {}).get((c, k), f"{c}_lag_{k}"): F.lag(c, k).over(window) for c, ks in lags.items() for k in ks})
    return out.filter("_own").drop("_own", "_part", "_place", "_hash")


def add_month(df: DataFrame, date: str, out: str = "Month") -> DataFrame:
    return df.withColumn(out, month_number(date))


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Leaves out rows with a null or NaN; after the lags, so that such rows still feed them."""
    return df.dropna(how="any", subset=subset)


def flag_above(df: DataFrame, column: str, limit: float = 80.0, out: str = "is_outlier") -> DataFrame:
    """Marks values above a limit; filters nothing."""
    return df.withColumn(out, F.coalesce(F.col(column) > limit, F.lit(False)))


def sorted_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
