"""Choice of the nearest target for each station."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import contains_any_case, falsy_coalesce
from ..session import written
from .cells import LEAF, cell_tree, nearest

#: Kilometres in a degree, for planar distances.
KM = 111


def planar_km(dlat: Column, dlon: Column) -> Column:
    return F.sqrt(dlat * dlat + dlon * dlon) * KM


def box_join(stations: DataFrame, targets: DataFrame, at: tuple[str, str], to: tuple[str, str], half: tuple[float, float]) -> DataFrame:
    """Pairs of a station and a target in its box: |to - at| <= half on both axes.

    Both axes are cut into cells as wide as half a box. A station goes to the nine cells around its own, a target to its
    own, and they are joined by cell: where targets lie evenly, 9 / 4 of the pairs that are kept are looked at.
    """
    cell = lambda c, h: F.floor(F.col(c).cast("double") / max(float(h), 1e-12))
    around = lambda c, h: F.explode(F.array(*[cell(c, h) + k for k in (-1, 0, 1)]))
    near = stations.withColumn("_i", around(at[0], half[0])).withColumn("_j", around(at[1], half[1]))
    far = targets.withColumn("_i", cell(to[0], half[0])).withColumn("_j", cell(to[1], half[1]))
    inside = [F.col(t).between(F.col(a) - h, F.col(a) + h) for a, t, h in zip(at, to, half, strict=True)]
    return near.join(far, ["_i", "_j"]).filter(inside[0] & inside[1]).drop("_i", "_j")


def best_target(stations: DataFrame, targets: DataFrame, station: str, at: tuple[str, str], to: tuple[str, str], preferred: Column, order: str, keep: list[str], leaf: int = LEAF) -> DataFrame:
    """Per station the nearest of the preferred targets, or of all if none is preferred; ties by `order`, then by `keep`.

    Targets at one place are one point, with the first of them by `order`. Points are dealt into a tree of cells with
    `leaf` points at most, so that a crowd of targets in one spot is split as often as it takes, and stations look for
    theirs in rings over its cells (see cells.py). Rows with a null or not finite coordinate are left out.
    """
    spark = stations.sparkSession
    finite = lambda *names: reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in names])  # noqa: E731  false for NaN and null
    places = stations.select(station, F.col(at[0]).cast("double").alias("a"), F.col(at[1]).cast("double").alias("b")).filter(finite("a", "b"))
    offers = targets.filter(preferred)
    offers = targets if offers.isEmpty() else offers
    first = F.min(F.struct(F.col(order).alias("o"), *[F.col(c).alias(f"k_{c}") for c in keep])).alias("payload")
    points = offers.withColumns({"x": F.col(to[0]).cast("double"), "y": F.col(to[1]).cast("double")}).filter(finite("x", "y")).groupBy("x", "y").agg(first)
    tree = cell_tree(written(points), leaf)
    if not tree:
        return spark.createDataFrame([], StructType([stations.schema[station], *[targets.schema[c] for c in keep], StructField("dist_km", DoubleType())]))
    best = nearest(places, tree, station, KM)
    return best.select(station, *[F.col(f"best.payload.k_{c}").alias(c) for c in keep], F.col("best.distance").alias("dist_km"))


def public(targets: DataFrame, access: str = "public") -> DataFrame:
    """The targets with open water levels; a missing coordinate is 0, a missing or zero id is taken from `id`."""
    about = [c for c in ("station", "input_pos") if c in targets.columns]
    return targets.filter(F.col("data_access.water_level_altimetry") == access).select(
        *about, falsy_coalesce("dahiti_id", "id").alias("dahiti_id"), F.coalesce("target_name", F.lit("")).alias("target_name"), "type",
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"), F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
    )


def best_of_lists(stations: DataFrame, targets: DataFrame, prefer: str = "river") -> DataFrame:
    """As select_best_target, where each target was listed for one station (column station)."""
    pairs = public(targets).join(stations, "station")
    distance = planar_km(F.col("latitude") - F.col("lat"), F.col("longitude") - F.col("lon"))
    rank = F.struct((~contains_any_case("type", prefer)).alias("p"), distance.alias("dist_km"), "input_pos", "dahiti_id", "target_name")
    return pairs.groupBy("station").agg(F.min(rank).alias("b")).select("station", "b.dahiti_id", "b.target_name", "b.dist_km")


def select_best_target(stations: DataFrame, targets: DataFrame, prefer: str = "river", access: str = "public") -> DataFrame:
    """station, dahiti_id, target_name, dist_km: the nearest public target, rivers first; stations without one are left out.

    stations: station, lat, lon; targets: input_pos, dahiti_id, id, target_name, type, latitude, longitude and
    data_access.water_level_altimetry; a missing coordinate is 0, a missing or zero id is taken from `id`.
    """
    return best_target(stations, public(targets, access), "station", ("lat", "lon"), ("latitude", "longitude"), contains_any_case("type", prefer), "input_pos", ["dahiti_id", "target_name"])


def with_fallback(stations: DataFrame, chosen: DataFrame, nearest: DataFrame) -> DataFrame:
    """The chosen target of each station, else the nearest one offered with code 200; stations with neither are left out."""
    spare = nearest.filter("code = 200").select("station", F.col("data.id").alias("_id"), F.col("data.target_name").alias("_name"))
    joined = stations.join(chosen, "station", "left").join(spare, "station", "left")
    return joined.select("station", F.coalesce("dahiti_id", "_id").alias("dahiti_id"), F.coalesce("target_name", "_name").alias("target_name")).filter("dahiti_id is not null")
