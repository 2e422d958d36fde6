"""The two pipelines over a folder of files: read, roll up, align, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_floor
from ..sources import files, grids, named_files
from . import monthly

#: Where each source lies under the data folder, and its files; the series' own station comes from a name.
CONDUCTIVITY = "interim", "conductivity_*_monthly_clean.csv"
METEO = "raw/openmeteo_rainfall", "openmeteo_*_daily.csv"
WATER = "raw/waterlevel", "dahiti_waterlevel_*.csv"
DISCHARGE = "raw/waterlevel/glofas_tanchau", "glofas_*.nc"
EXCLUDED = "all_stations", "1985_2026"
MASTER, FEATURES = "master_timeseries", "ml_monthly_features"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def master(spark: SparkSession, data: str, opener: Callable = grids.labelled) -> DataFrame:
    """The master table of the files under `data`, columns found by name; each file is rolled up apart.

    A source whose folder is missing gives null columns, and with no source the table is empty. A gridded file that
    fails, in whole or in part, is left out.
    """
    def table(place: tuple[str, str], schema: str, **how) -> DataFrame | None:
        folder = f"{data}/{place[0]}"
        return files.read_csv(spark, folder, place[1], schema, file_column="file", **how) if exists(spark, folder) else None

    cond, meteo = table(CONDUCTIVITY, files.CONDUCTIVITY), table(METEO, files.METEO, exclude=EXCLUDED)
    water = table(WATER, files.WATER_LEVEL)
    cells = None
    if exists(spark, folder := f"{data}/{DISCHARGE[0]}"):
        cells = grids.whole_files(grids.read_grids(spark, folder, DISCHARGE[1], opener=opener, columns=("file", "time", "value", "error")))
    if cond is None and meteo is None and water is None and cells is None:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ({"station": "string", "month_start": "date"} | monthly.MEASURES).items()))
    return monthly.master_table(cond, meteo, water, cells, per_file="file")


def features(spark: SparkSession, data: str, station: str = "MyTho", factor: float = 0.64, opener: Callable = grids.labelled) -> DataFrame:
    """The feature table: the station's conductivity (the first file of its name) beside the mean discharge, with lags."""
    found = files.read_first(spark, f"{data}/{CONDUCTIVITY[0]}", CONDUCTIVITY[1].replace("*", station), files.CONDUCTIVITY)
    ec = found.select(month_floor("date").alias("date"), F.col("conductivity_mS_per_m").alias("MyTho_EC"))
    cells = grids.whole_files(grids.read_grids(spark, f"{data}/{DISCHARGE[0]}", DISCHARGE[1], opener=opener, columns=("file", "time", "value", "error")))
    discharge = monthly.discharge_by_month(cells, out="TanChau_Discharge").select(F.col("month_start").alias("date"), "TanChau_Discharge")
    return monthly.feature_table(discharge, ec, factor)


def save(df: DataFrame, folder: str, name: str, order: list[str], parquet: bool = True) -> None:
    """df as the file `name`.csv in a folder (it appears when it is whole), and as the Parquet table `name`.parquet."""
    named_files.write_named(df, folder, F.lit(f"{name}.csv"), order)
    if parquet:
        files.write_parquet(df, f"{folder}/{name}.parquet")
