"""Planning of download requests: grid, validity, resume, fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Months by their number of days (February always asks for 29).
GROUPS = {"31days": ([1, 3, 5, 7, 8, 10, 12], 31), "30days": ([4, 6, 9, 11], 30), "29days": ([2], 29)}
DIMENSIONS = ("day", "hydrological_model", "month", "product_type", "system_version", "timespan", "variable", "year")
#: What every request asks for besides its product, year, months and days.
ASKED = {"hydrological_model": "lisflood", "system_version": "version_4_0", "timespan": "time_mean", "variable": "average_river_discharge_in_the_last_24_hours"}
#: Records whose bitmaps go into a plan, and entries (value and 64 records) of all of them; a larger catalogue is joined.
MAX_RECORDS, MAX_WORDS = 4096, 200_000


def requests(spark: SparkSession, first: int = 1985, last: int = 2023, prefix: str = "glofas", years: DataFrame | None = None) -> DataFrame:
    """y, name, months, days, out_file: a request for each year (those from first to last, or the column y of `years`)
    and group of months of equal length."""
    groups = spark.createDataFrame([(n, m, d) for n, (m, d) in GROUPS.items()], "name string, months array<int>, days int")
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y")) if years is None else years.select(F.col("y").cast("int").alias("y")).distinct()
    grid = years.join(F.broadcast(groups))  # three groups
    return grid.withColumn("out_file", F.concat(F.lit(f"{prefix}_"), F.col("y").cast("string"), F.lit("_"), F.col("name"), F.lit(".nc")))


def request_days(planned: DataFrame) -> DataFrame:
    """y, name, mm, dd, out_file: the days of each request, two digits each."""
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    months = planned.select("y", "name", "out_file", "days", F.explode("months").alias("m"))
    return months.select("y", "name", "out_file", "m", F.explode(F.sequence(F.lit(1), F.col("days"))).alias("d")).select("y", "name", two("m").alias("mm"), two("d").alias("dd"), "out_file")


def expanded(df: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """A row for each combination of the values of the arrays `dimensions` of a row."""
    for d in dimensions:
        df = df.withColumn(d, F.explode(d))
    return df


def combinations(constraints: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The valid combinations: each record stands for the cross product of its arrays."""
    return expanded(constraints.select(*dimensions), dimensions).distinct()


def _words(records: list[list[list[str] | None]], d: int) -> dict[str, list[int]]:
    """For each value of dimension d a bitmap of the records that have it, in signed words of 64 bits."""
    out: dict[str, list[int]] = {}
    for k, record in enumerate(records):
        for value in set(record[d] or ()) - {None}:
            out.setdefault(value, [0] * (len(records) + 63 >> 6))[k >> 6] |= 1 << (k & 63)
    return {v: [w - (1 << 64) if w >> 63 else w for w in words] for v, words in out.items()}


def member(constraints: DataFrame, values: dict[str, Column], arrays: tuple[str, ...] = (), max_records: int = MAX_RECORDS) -> Column | None:
    """Whether a record has the given value of every dimension, by bitmaps: each value stands for the records that have
    it, and a combination is valid if some record is left when the bitmaps of its values are intersected. Nothing is
    expanded. A dimension named in `arrays` has an array of values, and asks for one record that has them all. A null or unknown value is not valid.

    None if the catalogue is too large to go into the plan; see valid().
    """
    records = [list(r) for r in constraints.select(*values).limit(max_records + 1).collect()]  # bounded
    maps, sets = [_words(records, d) for d in range(len(values))], {k for k, d in enumerate(values) if d in arrays}
    if len(records) > max_records or sum(len(w) for m in maps for w in m.values()) > MAX_WORDS:
        return None
    none = F.array(*[F.lit(0).cast("long")] * max(1, len(records) + 63 >> 6))
    every = F.transform(none, lambda _: F.lit(-1).cast("long"))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))

    def bitmap(d: int, value: Column) -> Column:
        if not maps[d]:
            return none
        index = F.create_map(*[x for v, words in sorted(maps[d].items()) for x in (F.lit(v), F.array(*[F.lit(w).cast("long") for w in words]))])
        one = lambda v: F.coalesce(F.try_element_at(index, v.cast("string")), none)
        return F.aggregate(F.transform(value, one), every, both) if d in sets else one(value)

    return F.exists(reduce(both, [bitmap(d, v) for d, v in enumerate(values.values())]), lambda w: w != 0)


def valid(asked: DataFrame, constraints: DataFrame, dimensions: dict[str, str], max_records: int = MAX_RECORDS) -> DataFrame:
    """The rows of asked whose values (dimension to column) a record of constraints has all of.

    A catalogue of up to max_records records is tested as bitmaps within the rows. Of a larger one, the records are
    found by the dimension that picks the fewest for a value, and then tested for the others; nothing else is expanded.
    """
    test = member(constraints, {d: F.col(c) for d, c in dimensions.items()}, max_records=max_records)
    if test is not None:
        return asked.filter(test)
    per_value = constraints.agg(*[(F.sum(F.size(F.array_distinct(d))) / F.size(F.array_distinct(F.flatten(F.collect_set(d))))).alias(d) for d in dimensions]).first()
    rarest = min(dimensions, key=lambda d: per_value[d] or 0.0)
    index = constraints.select(F.explode(F.array_distinct(rarest)).alias("_rarest"), *[F.col(d).alias(f"_{d}") for d in dimensions if d != rarest])
    others = [F.array_contains(f"_{d}", F.col(c).cast("string")) for d, c in dimensions.items() if d != rarest]
    return asked.join(index, reduce(lambda a, b: a & b, others, F.col(dimensions[rarest]).cast("string") == F.col("_rarest")), "left_semi")


def remaining(planned: DataFrame, existing: DataFrame, key: str = "out_file") -> DataFrame:
    """Requests whose output does not exist yet."""
    return planned.join(existing.select(key).distinct(), key, "left_anti")


def with_product(planned: DataFrame, available: DataFrame, key: list[str], first: str = "consolidated", second: str = "intermediate") -> DataFrame:
    """Adds product_type: the first product where it is available for the key, else the second."""
    known = available.select(*key).distinct().withColumn("_known", F.lit(True))
    return planned.join(known, key, "left").withColumn("product_type", F.when(F.col("_known"), F.lit(first)).otherwise(F.lit(second))).drop("_known")


def plan_requests(spark: SparkSession, constraints: DataFrame | None = None, existing: DataFrame | None = None, first: int = 1985, last: int = 2023, fixed: dict[str, str] | None = None) -> DataFrame:
    """y, name, months, days, out_file and product_type of the requests still to make.

    With constraints, a request takes the consolidated product if each of its days that the calendar has is valid: with
    the values of `fixed` (ASKED for all eight dimensions; by default the dates and the product alone are tested).
    """
    planned = requests(spark, first, last)
    planned = planned if existing is None else remaining(planned, existing)
    if constraints is None:
        return planned.withColumn("product_type", F.lit("consolidated"))
    always = {"product_type": "consolidated", **(fixed or {})}
    days = request_days(planned).withColumn("year", F.col("y").cast("string")).withColumns({f"_{d}": F.lit(v) for d, v in always.items()})
    real = days.filter(F.try_to_date(F.concat_ws("-", "year", "mm", "dd")).isNotNull())
    good = valid(real, constraints, {"year": "year", "month": "mm", "day": "dd", **{d: f"_{d}" for d in always}})
    short = real.join(good, ["year", "mm", "dd"], "left_anti").select("out_file").distinct()
    return with_product(planned, remaining(planned, short), ["out_file"])
