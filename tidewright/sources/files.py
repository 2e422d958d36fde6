"""Files as tables, and tables as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import key_value
from .delimited import quarantined, read_checked, read_csv, read_first, resolve_date  # noqa: F401  these are files, too

WATER_LEVEL = "station string, dahiti_id int, target_name string, target_lat string, target_lon string, water_level_m double, water_level_err_m double, date timestamp_ntz"
CONDUCTIVITY = "station string, date date, conductivity_mS_per_m double"
METEO = (
    "station string, date date, precipitation_sum double, temperature_2m_mean double, temperature_2m_max double, temperature_2m_min double, "
    "et0_fao_evapotranspiration double, windspeed_10m_max double, relative_humidity_2m_mean double, shortwave_radiation_sum double"
)
CONSTRAINTS = ", ".join(f"{d} array<string>" for d in ("day", "hydrological_model", "month", "product_type", "system_version", "timespan", "variable", "year"))
TARGETS = "dahiti_id int, id int, target_name string, type string, latitude double, longitude double, data_access struct<water_level_altimetry: string, discharge: string>"


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that are named, under their new names, in the order given; nothing else is read."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_points(spark: SparkSession, folder: str, glob: str = "*.kml") -> DataFrame:
    """name, description, lon, lat of KML files with one point each (a folder is read, for names may hold brackets)."""
    text = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    plain = F.regexp_replace("value", r'xmlns(:\w+)?="[^"]*"', "")
    at = lambda tag: F.xpath_string(plain, F.lit(f"//{tag}"))
    place = F.split(F.trim(at("Placemark//coordinates")), ",")
    return text.select(at("Placemark/name").alias("name"), at("Placemark/description").alias("description"), place[0].cast("double").alias("lon"), place[1].cast("double").alias("lat"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """k and v of `key = value` lines."""
    holds, k, v = key_value("value")
    return spark.read.text(path).filter(holds).select(k.alias("k"), v.alias("v"))


def rename_synonyms(df: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Renames the columns that are there; two that would get one name are refused."""
    hits = {a: b for a, b in synonyms.items() if a in df.columns}
    if len(set(hits.values())) < len(hits) or set(hits.values()) & (set(df.columns) - set(hits)):
        raise ValueError(f"more than one column for {sorted(set(hits.values()))}")
    return df.withColumnsRenamed(hits)


def time_to_date(df: DataFrame) -> DataFrame:
    """time becomes date; where there is none, valid_time does."""
    for name in ("time", "valid_time"):
        if name in df.columns:
            return df.withColumnRenamed(name, "date")
    raise ValueError(f"no time among {df.columns}")


def output_name(station: str, target: int, what: str = "waterlevel") -> str:
    return f"dahiti_{what}_{station}_id{target}.csv"


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """With a header; as one file (for tables of months) or as many as df has partitions."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def summary_json(stations: dict[str, dict], downloaded_at: str) -> str:
    """The summary of a download: a few stations."""
    return json.dumps({"downloaded_at": downloaded_at, "stations": stations}, indent=2, ensure_ascii=False)
