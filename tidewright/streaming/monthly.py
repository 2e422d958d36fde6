"""Monthly rollup of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null


def observations(spark: SparkSession, folder: str, schema: str, glob: str = "*.csv") -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", glob).csv(folder)


def monthly_means(stream: DataFrame, time: str, value: str, late: str = "60 days") -> DataFrame:
    """station, month_start, n and the mean of value; months are final once `late` has passed."""
    rows = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    month = F.date_trunc("month", F.col("_time")).cast("date")
    v = nan_to_null(value)
    return rows.groupBy("station", month.alias("month_start")).agg(F.count(v).alias("n"), F.avg(v).alias(value))
