"""Rollup of irregular observations to months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_floor

MONTH = "month_start"


def _measure(name: str, how: str, decimals: int | None) -> Column:
    c = F.col(name)
    exact = F.sum(c.cast(f"decimal(38,{decimals})")).cast("double") if decimals is not None else F.sum(c)
    if how == "sum":
        return F.coalesce(exact, F.lit(0.0))  # a month of nulls sums to zero
    if how == "mean":
        return exact / F.nullif(F.count(c), F.lit(0)) if decimals is not None else F.avg(c)
    return {"max": F.max, "min": F.min, "count": F.count}[how](c)


def monthly_rollup(df: DataFrame, keys: list[str], date_col: str | None, spec: dict[str, tuple[str, str]], per_file: str | None = None, decimals: int | None = None) -> DataFrame:
    """One row per keys and month: spec maps an output to (input, sum|mean|max|min|count).

    Rows with a null key or date are left out; nulls are skipped. With per_file, the name of a column with the
    source file, each file is rolled up by itself and its rows are kept apart. With decimals, sums and means add
    exact decimals, so results do not depend on the order of rows. One aggregation, combined before its shuffle.
    """
    groups = [F.col(k) for k in keys] + ([month_floor(date_col).alias(MONTH)] if date_col else [])
    names = [*keys, *([MONTH] if date_col else [])]
    rows = df.select(*groups, *({per_file} - set(keys) if per_file else ()), *{i for i, _ in spec.values()} - set(names))
    for name in names:
        rows = rows.filter(F.col(name).isNotNull())
    by = [*names, *([per_file] if per_file and per_file not in names else [])]
    out = rows.groupBy(*by).agg(*[_measure(i, how, decimals).alias(o) for o, (i, how) in spec.items()])
    return out.select(*names, *spec)


def mean_of_means(df: DataFrame, file: str, keys: list[str], date_col: str, value: str, out: str, decimals: int | None = None) -> DataFrame:
    """Unweighted mean over files of their monthly means: files that overlap in a month count the same."""
    one = monthly_rollup(df, [file, *keys], date_col, {"_mean": (value, "mean")}, decimals=decimals)
    return one.groupBy(*keys, MONTH).agg(F.avg("_mean").alias(out))


def spatial_mean(cells: DataFrame, value: str, time: str = "time", by: list[str] = (), single: bool = False, decimals: int | None = None) -> DataFrame:
    """Mean of a gridded value over its cells at each time, NaN skipped.

    With single, the mean is held in single precision, as grids of that precision have it; with decimals, sums are of
    exact decimals.
    """
    good = cells.select(*by, time, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias(value))
    mean = _measure(value, "mean", decimals)
    return good.groupBy(*by, time).agg((mean.cast("float").cast("double") if single else mean).alias(value))
