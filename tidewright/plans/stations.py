"""The download of all stations' water levels: list, choose, fall back, fetch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stamp
from ..operators import targets
from ..sources import files, water_levels
from ..sources.services import box_fields


def station_levels(spark: SparkSession, stations: dict[str, tuple[float, float]], fetch: Callable[[str, dict[str, dict]], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(water levels of all stations in the shipped form; station, dahiti_id and target_name of those with a target).

    stations: name to latitude and longitude, a short list. fetch(endpoint, fields by station) gives name and answer.
    Each station takes the nearest public target in its box, rivers first; without one the service's nearest; without
    that it is left out. A target that has no rows stays in the second table.
    """
    places = spark.createDataFrame([(n, *p) for n, p in stations.items()], "station string, lat double, lon double")
    listed = water_levels.targets(fetch("list-targets/", {n: box_fields(*p) for n, p in stations.items()}), files.TARGETS)
    chosen = targets.best_of_lists(places, listed.withColumnRenamed("name", "station"))
    spare = water_levels.nearest(fetch("get-nearest-target/", {n: {"latitude": a, "longitude": b} for n, (a, b) in stations.items()}))
    final = targets.with_fallback(places, chosen, spare)
    ids = {r["station"]: {"dahiti_id": r["dahiti_id"]} for r in final.collect()}  # a row a station
    return water_levels.water_levels(fetch("download-water-level/", ids), final), final


def summary(final: DataFrame) -> str:
    """The summary file's text: when, and each station's target."""
    rows = final.select(stamp().alias("now"), "station", F.struct("dahiti_id", "target_name").alias("t")).collect()  # a row a station
    return files.summary_json({r["station"]: r["t"].asDict() for r in rows}, rows[0]["now"] if rows else final.sparkSession.range(1).select(stamp()).first()[0])
