"""Alignment of rolled-up sources on common keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """df with a typed null column for each required one that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in required.items() if c not in df.columns})


def outer_align(frames: list[DataFrame], keys: list[str], required: dict[str, str] | None = None) -> DataFrame:
    """Full outer join of all frames on the keys; what no frame has comes as typed nulls, in the order of `required`."""
    joined = null_columns(reduce(lambda a, b: a.join(b, keys, "full_outer"), frames), required or {})
    return joined.select(*keys, *required) if required else joined


def null_safe_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join in which null keys match each other."""
    other = b.withColumnRenamed(key, "_other")
    rest = [c for c in b.columns if c != key]
    return a.join(other, a[key].eqNullSafe(other["_other"]), "full_outer").select(F.coalesce(a[key], other["_other"]).alias(key), *[a[c] for c in a.columns if c != key], *rest)


def union_align(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The same rows by one union and one aggregation, without a join; for frames that are unique on the keys."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


def stack(frames: list[DataFrame], schema: str | None = None, spark=None) -> DataFrame:
    """Union by name; no frames give an empty one of the schema."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
