"""Answers of the water-level service as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL, ERROR = ("wse", "water_level"), ("wse_u", "error")
SYNONYMS = dict.fromkeys(LEVEL, "water_level_m") | dict.fromkeys(ERROR, "water_level_err_m")


def targets(answers: DataFrame, schema: str) -> DataFrame:
    """The targets in a list answer, either a bare list or under data, with their place in it; bad answers give none."""
    bare, wrapped = F.from_json("answer", f"array<struct<{_fields(schema)}>>"), F.from_json("answer", f"struct<data: array<struct<{_fields(schema)}>>>")
    items = F.when(F.substring(F.ltrim("answer"), 1, 1) == "[", bare).otherwise(wrapped["data"])
    return answers.select("name", F.posexplode(items).alias("input_pos", "t")).select("name", "input_pos", "t.*")


def _fields(schema: str) -> str:
    """A schema's text as the fields of a struct."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = word.strip().partition(" ")
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += c
    return ", ".join(out)


def nearest(answers: DataFrame) -> DataFrame:
    """station, code and data (id, target_name) of the answers that name the nearest target; bad answers have nulls."""
    parsed = F.from_json("answer", "struct<code: int, data: struct<id: int, target_name: string>>")
    return answers.select(F.col("name").alias("station"), parsed["code"].alias("code"), parsed["data"].alias("data"))


def water_levels(answers: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of all stations' answers in the shipped form (WATER_LEVEL), by station and date.

    answers: name (the station), answer; chosen: station, dahiti_id. A row's fields are found by their names: the date
    is the first that holds date or time, else the first. A station without an answer, or whose answer is null, not
    JSON or without rows, gives none.
    """
    parsed = F.from_json("answer", "struct<data: array<map<string, string>>, target: map<string, string>>")
    rows = answers.join(chosen.select("station", "dahiti_id"), answers["name"] == chosen["station"]).select("station", "dahiti_id", parsed.alias("a"))
    rows = rows.select("station", "dahiti_id", F.col("a.target").alias("t"), F.explode("a.data").alias("d"))
    names = F.map_keys("d")
    date = F.coalesce(F.get(F.filter(names, lambda k: F.lower(k).contains("date") | F.lower(k).contains("time")), 0), F.get(names, 0))
    first = lambda *fields: F.coalesce(*[F.try_element_at("d", F.lit(f)) for f in fields]).try_cast("double")
    about = lambda f: F.coalesce(F.try_element_at("t", F.lit(f)), F.lit(""))
    out = rows.select(
        "station", "dahiti_id", about("target_name").alias("target_name"), about("latitude").alias("target_lat"), about("longitude").alias("target_lon"),
        first(*LEVEL).alias("water_level_m"), first(*ERROR).alias("water_level_err_m"), F.try_element_at("d", date).try_cast("timestamp_ntz").alias("date"),
    )
    return out.orderBy("station", F.col("date").asc_nulls_last())
