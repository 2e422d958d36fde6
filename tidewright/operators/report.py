"""Reports on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, key: str, date: str) -> DataFrame:
    """Per key the first and last date and the number of dates that are not null."""
    return df.groupBy(key).agg(F.min(date).alias("min"), F.max(date).alias("max"), F.count(date).alias("count"))


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.to_date(F.min(date)).alias("first"), F.to_date(F.max(date)).alias("last"), F.count(F.lit(1)).alias("n"))


def shapes(frames: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows and n_columns of each table, in one query."""
    each = [f.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", F.lit(len(f.columns)).alias("n_columns")) for n, f in frames.items()]
    return reduce(DataFrame.unionByName, each)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
