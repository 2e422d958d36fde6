"""Each operator as a query over the driver's tables: name to a function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import contains_any_case, falsy_coalesce, holds_none, json_value, key_value, month_floor, month_number
from ..operators import align, features, incremental, report, requests, rollup, targets
from ..session import shared_folder
from ..sources import files, grids, named_files, water_levels
from . import monthly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def scan_project_rename(spark, folder):
    return files.renamed(table(spark, folder, "customer"), {"c_custkey": "station_id", "c_name": "station", "c_acctbal": "water_level_m"})


@query
def unit_convert(spark, folder):
    return features.unit_convert(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("ec")), "ec", "salinity")


@query
def month_floor_and_part(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", month_floor("o_orderdate").alias("month_start"), month_number("o_orderdate").alias("month_num"))


@query
def exclude_by_substring(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return part.filter(holds_none("p_name", ("small", "ring")))


def by_flag(spark, folder):
    return table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "station")


@query
def monthly_mean(spark, folder):
    return rollup.monthly_rollup(by_flag(spark, folder), ["station"], "l_shipdate", {"mean_value": ("l_extendedprice", "mean")}, decimals=2)


@query
def monthly_multi_agg(spark, folder):
    spec = {"precipitation_sum": ("l_quantity", "sum"), "temperature_mean": ("l_discount", "mean"), "temperature_max": ("l_extendedprice", "max"), "temperature_min": ("l_extendedprice", "min")}
    return rollup.monthly_rollup(by_flag(spark, folder), ["station"], "l_shipdate", spec, decimals=2)


@query
def sum_null_as_zero(spark, folder):
    rows = by_flag(spark, folder).withColumn("v", F.when(F.col("station") != "A", F.col("l_quantity")))
    return rollup.monthly_rollup(rows, ["station"], None, {"total": ("v", "sum")}, decimals=2)


@query
def group_drops_null_keys(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("k"), F.lit(1).alias("one"))
    return rollup.monthly_rollup(rows, ["k"], None, {"n": ("one", "count")})


@query
def per_file_agg_then_union(spark, folder):
    rows = by_flag(spark, folder).withColumnRenamed("l_linestatus", "src").filter(F.col("src").isin("F", "O"))
    return rollup.monthly_rollup(rows, ["src", "station"], "l_shipdate", {"v": ("l_extendedprice", "max")}, per_file="src")


@query
def mean_of_means(spark, folder):
    rows = table(spark, folder, "lineitem")
    out = rollup.mean_of_means(rows, "l_linestatus", [], "l_shipdate", "l_quantity", "discharge", decimals=2)
    return out.select("month_start", F.round("discharge", 6).alias("discharge"))


def by_status(spark, folder):
    return table(spark, folder, "orders").withColumnRenamed("o_orderstatus", "station")


@query
def outer_join_two_keys(spark, folder):
    a = rollup.monthly_rollup(by_flag(spark, folder), ["station"], "l_shipdate", {"cond": ("l_quantity", "max")})
    b = rollup.monthly_rollup(by_status(spark, folder), ["station"], "o_orderdate", {"meteo": ("o_totalprice", "max")})
    return align.outer_align([a, b], ["station", "month_start"])


@query
def outer_join_null_safe(spark, folder):
    a = table(spark, folder, "lineitem").groupBy(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("k")).agg(F.max("l_quantity").alias("x"))
    b = table(spark, folder, "orders").groupBy(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("k")).agg(F.max("o_totalprice").alias("y"))
    return align.null_safe_outer(a, b, "k")


@query
def outer_join_chain(spark, folder):
    lines = table(spark, folder, "lineitem")
    when = lambda day: F.lit(day).cast("timestamp_ntz")
    cond = rollup.monthly_rollup(lines.filter(F.col("l_shipdate") < when("1999-01-01")), [], "l_shipdate", {"cond": ("l_quantity", "max")})
    meteo = rollup.monthly_rollup(table(spark, folder, "orders"), [], "o_orderdate", {"meteo": ("o_totalprice", "max")})
    water = rollup.monthly_rollup(table(spark, folder, "events"), [], "ts", {"water": ("value", "max")})
    disch = rollup.monthly_rollup(lines.filter(F.col("l_shipdate") > when("1997-06-15")), [], "l_shipdate", {"disch": ("l_extendedprice", "min")})
    return align.outer_align([cond, meteo, water, disch], ["month_start"])


@query
def missing_source_null_column(spark, folder):
    return align.null_columns(table(spark, folder, "nation").select(F.col("n_name").alias("station")), {"water_level_m": "double"})


@query
def lag_features(spark, folder):
    months = table(spark, folder, "orders").groupBy(month_floor("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("v"))
    return features.add_month(features.add_lags(months, "d", {"v": [1, 2]}), "d", "month_num")


@query
def feature_pipeline(spark, folder):
    discharge = rollup.monthly_rollup(table(spark, folder, "lineitem"), [], "l_shipdate", {"discharge": ("l_quantity", "mean")}, decimals=2)
    ec = rollup.monthly_rollup(table(spark, folder, "orders").filter("o_orderstatus = 'F'"), [], "o_orderdate", {"ec": ("o_totalprice", "max")})
    joined = align.outer_align([discharge, features.unit_convert(ec, "ec", "salinity")], ["month_start"]).withColumnRenamed("month_start", "d")
    lagged = features.add_lags(joined, "d", {"discharge": [1, 2], "salinity": [1]})
    return features.drop_incomplete(features.add_month(lagged, "d", "month_num"))


@query
def date_range_report(spark, folder):
    rows = by_flag(spark, folder).select("station", month_floor("l_shipdate").alias("m"))
    return report.coverage(rows, "station", "m").withColumnsRenamed({"min": "min_month", "max": "max_month", "count": "n"})


@query
def bbox_range_join(spark, folder):
    found = targets.box_join(table(spark, folder, "nation"), table(spark, folder, "supplier"), ("n_nationkey", "n_regionkey"), ("s_suppkey", "s_nationkey"), (2, 2))
    return found.select("n_nationkey", "s_suppkey")


@query
def nearest_target_topk(spark, folder):
    stations, offers = table(spark, folder, "nation"), table(spark, folder, "supplier").filter("s_acctbal > 0")
    best = targets.best_target(stations, offers, "n_nationkey", ("n_nationkey", "n_regionkey"), ("s_suppkey", "s_nationkey"), contains_any_case("s_name", "7"), "s_suppkey", ["s_suppkey"])
    return best.select("n_nationkey", "s_suppkey", F.round("dist_km", 6).alias("dist_km"))


@query
def first_n_preview(spark, folder):
    return report.first_rows(table(spark, folder, "supplier").select("s_suppkey", "s_name"), 15, "s_suppkey")


@query
def resume_anti_join(spark, folder):
    planned = table(spark, folder, "orders").select("o_orderkey")
    return requests.remaining(planned, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query
def fallback_source(spark, folder):
    known = table(spark, folder, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return requests.with_product(table(spark, folder, "orders").select("o_orderkey"), known, ["o_orderkey"])


@query
def coalesce_falsy_id(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", falsy_coalesce("c_nationkey", F.col("c_custkey").cast("int")).alias("target_id"))


@query
def request_grid(spark, folder):
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y"))
    return requests.request_days(requests.requests(spark, years=years))


@query
def explode_cross_product(spark, folder):
    return requests.expanded(table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("x")), ("x",))


@query
def json_field(spark, folder):
    return table(spark, folder, "events").select("event_id", json_value("props", "k", "int").alias("k"))


@query
def key_value_split(spark, folder):
    holds, k, v = key_value("url")
    return table(spark, folder, "pages").filter(holds).select("page_id", k.alias("k"), v.alias("v"))


@query
def valid_combinations(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("label").alias("l"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10).cast("int")).alias("x"))
    return requests.combinations(vectors.select(F.array("l").alias("l"), "x"), ("l", "x"))


@query
def spatial_mean_by_time(spark, folder):
    cells = table(spark, folder, "lineitem").select(F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("value"))
    return rollup.spatial_mean(cells, "value", decimals=2)


@query
def first_and_last_date(spark, folder):
    return report.date_range(table(spark, folder, "orders"), "o_orderdate")


@query
def table_shapes(spark, folder):
    return report.shapes({name: table(spark, folder, name) for name in ("nation", "region", "supplier")})


@query
def stacked_sources(spark, folder):
    customers = files.renamed(table(spark, folder, "customer"), {"c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"})
    return align.stack([customers, files.renamed(table(spark, folder, "supplier"), {"s_name": "name", "s_acctbal": "balance"})])


@query
def target_or_nearest(spark, folder):
    stations = table(spark, folder, "nation").select(F.col("n_name").alias("station"))
    cheap, near = (table(spark, folder, "supplier").filter(f).join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")) for f in ("s_acctbal < -900", "s_acctbal > 9000"))
    chosen = cheap.groupBy(F.col("n_name").alias("station")).agg(F.min("s_suppkey").cast("int").alias("dahiti_id")).withColumn("target_name", F.lit("chosen"))
    spare = near.groupBy(F.col("n_name").alias("station")).agg(F.min("s_suppkey").cast("int").alias("id")).select("station", F.lit(200).alias("code"), F.struct("id", F.lit("nearest").alias("target_name")).alias("data"))
    return targets.with_fallback(stations, chosen, spare)


def station_files(spark, folder):
    """The orders as CSV files by status, whose columns differ in order and names: one has a mark before its header and a
    column of its own, one lacks the value."""
    orders, to = table(spark, folder, "orders"), shared_folder(spark)
    name = F.concat(F.lit("orders_"), "o_orderstatus", F.lit(".csv"))
    forms = {
        "F": (["o_orderkey as id", "o_orderstatus as station", "o_orderdate as date", "o_totalprice as value", "o_orderpriority as kind"], True),
        "O": (["o_totalprice as reading", "o_orderpriority as kind", "o_custkey as extra", "o_orderdate as Time_UTC", "o_orderstatus as station", "o_orderkey as id"], False),
        "P": (["o_orderpriority as kind", "o_orderstatus as station", "o_orderkey as id", "o_orderdate as date"], False),
    }
    for status, (form, bom) in forms.items():
        some = orders.filter(F.col("o_orderstatus") == status).withColumn("_name", name)
        named_files.write_named(some.selectExpr("_name", *form), to, "_name", ["id"], bom=bom)
    return to


@query
def csv_by_name(spark, folder):
    found = files.read_csv(spark, station_files(spark, folder), "orders_*.csv", "id long, station string, date date, value double", synonyms={"value": ("reading",)}, date="date")
    return found.withColumnsRenamed({"id": "o_orderkey"})


@query
def csv_quarantine(spark, folder):
    orders, to = table(spark, folder, "orders"), shared_folder(spark)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = orders.select(F.concat(F.lit("orders_"), "o_orderstatus", F.lit(".csv")).alias("_name"), F.col("o_orderkey").alias("id"), F.when(urgent, F.lit("not read")).otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    named_files.write_named(rows, to, "_name", ["id"])
    sound, others, _ = files.quarantined(files.read_checked(spark, to, "orders_*.csv", "id long, value double"), shared_folder(spark))
    return sound.select("id", "value", F.lit(None).cast("string").alias("line")).unionByName(others.select("id", "value", "line")).withColumnRenamed("id", "o_orderkey")


@query
def named_file_round_trip(spark, folder):
    to = shared_folder(spark)
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    named_files.write_named(customers, to, F.format_string("waterlevel_%s_id%d.csv", F.lit("nation"), "c_nationkey"), ["c_custkey"], bom=True)
    found = files.read_csv(spark, to, "waterlevel_*.csv", "c_name string, c_custkey long, c_acctbal double", file_column="file")
    return found.withColumn("file", F.element_at(F.split("file", "/"), -1))


#: Rows of a row group of a gridded file.
GROUP_ROWS = 20_000


def cell_files(spark, folder):
    """The line items as gridded files, one for each flag and year, so that no file grows with the table alone and no
    month lies in two of a flag's: a cell for each time, line number and supplier. Row groups are small, for tasks read whole ones."""
    lines, to = table(spark, folder, "lineitem"), shared_folder(spark)
    cells = lines.groupBy("l_returnflag", F.col("l_shipdate").alias("time"), F.col("l_linenumber").cast("double").alias("lat"), F.col("l_suppkey").cast("double").alias("lon")).agg(F.max("l_quantity").alias("quantity"))
    cells = cells.withColumn("year", F.year("time"))
    placed = cells.repartition("l_returnflag", "year").sortWithinPartitions("l_returnflag", "year", "time", "lat", "lon")
    placed.write.option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("l_returnflag", "year").parquet(to)
    return to


@query
def gridded_monthly_mean(spark, folder):
    cells = grids.read_grids(spark, cell_files(spark, folder), "*.parquet", opener=grids.CellFile, columns=("file", "time", "value"), cells=5000)
    some = cells.filter((F.col("time") >= F.lit("1994-03-10").cast("timestamp_ntz")) & (F.col("time") < F.lit("1997-06-15").cast("timestamp_ntz")))
    return monthly.discharge_by_month(some, "lines", "mean_value").withColumn("mean_value", F.round("mean_value", 6))


@query
def valid_requests(spark, folder):
    """Customers asking for a nation, a segment and a band of balances, of records that list what each nation has."""
    customers = table(spark, folder, "customer")
    band = F.floor(F.col("c_acctbal") / 1000).cast("int")
    records = customers.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segment"), F.collect_set(band.cast("string")).alias("band"))
    records = records.select(F.array(F.col("c_nationkey").cast("string")).alias("nation"), "segment", "band")
    asked = customers.select("c_custkey", (F.col("c_nationkey") % 24).alias("nation"), F.col("c_mktsegment").alias("segment"), (band * 2 - 3).alias("band"))
    return requests.valid(asked, records, {"nation": "nation", "segment": "segment", "band": "band"}).select("c_custkey")


@query
def lags_by_range(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    return features.add_lags_by_range(events, "ts", {"value": [1, 2, 7]}, ("event_id",), part_rows=1000)


@query
def incremental_rollup(spark, folder):
    """Orders as CSV files that arrive in three loads, the last of which changes a file; the state is then finished."""
    orders, to, state = table(spark, folder, "orders"), shared_folder(spark), shared_folder(spark)
    rows = orders.select(F.concat(F.lit("orders_"), "o_orderstatus", F.lit(".csv")).alias("_name"), F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))
    loads = [rows.filter("_name like '%F.csv' and station > '3'"), rows.filter("_name like '%P.csv' or _name like '%O.csv'"), rows.filter("_name like '%F.csv'")]
    for load in loads:
        named_files.write_named(load, to, "_name", ["date", "station", "value"])
        read = lambda names: files.read_csv(spark, to, "*.csv", "station string, date date, value double", file_column="file", only=names)
        incremental.update(spark, state, to, "*.csv", read, ["station"], "date", ["value"], decimals=2)
    spec = {"total": ("value", "sum"), "mean_value": ("value", "mean"), "highest": ("value", "max"), "lowest": ("value", "min"), "n": ("value", "count")}
    return incremental.monthly(spark, state, ["station"], spec)


@query
def public_targets(spark, folder):
    """Suppliers as targets, some closed, some without an id, a name or a place of their own."""
    s = table(spark, folder, "supplier")
    offers = s.select(
        F.col("s_suppkey").cast("int").alias("input_pos"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey")).otherwise(0).cast("int").alias("dahiti_id"), (F.col("s_suppkey") + 1000).cast("int").alias("id"),
        F.when(F.col("s_nationkey") > 5, F.col("s_name")).alias("target_name"), F.lit("River").alias("type"), F.when(F.col("s_nationkey") > 3, F.col("s_nationkey").cast("double")).alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.struct(F.when(F.col("s_acctbal") > 2000, "public").when(F.col("s_acctbal") > 0, "restricted").alias("water_level_altimetry")).alias("data_access"),
    )
    return targets.public(offers)


@query
def outlier_flag(spark, folder):
    return features.flag_above(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 8000.0)


@query
def first_file(spark, folder):
    to = shared_folder(spark)
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    named_files.write_named(rows, to, F.format_string("dahiti_waterlevel_n_id%02d.csv", "s_nationkey"), ["s_suppkey"])
    return files.read_first(spark, to, "dahiti_waterlevel_*.csv", "s_name string, s_suppkey long")


@query
def water_level_answers(spark, folder):
    """Each user's events as a service's answer, whose fields go by several names; one in seven has no target."""
    events = table(spark, folder, "events")
    of = lambda date, level: F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit(date), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(level), F.col("value").cast("string"))
    row = F.when(F.col("user_id") % 2 == 0, of("datetime", "wse")).otherwise(of("Time_UTC", "water_level"))
    answers = events.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(row).alias("data"), F.create_map(F.lit("target_name"), F.concat(F.lit("user "), F.first("user_id").cast("string"))).alias("target"))).alias("answer"))
    answers = answers.select(F.col("user_id").cast("string").alias("name"), "answer")
    chosen = events.filter(F.col("user_id") % 7 != 0).select(F.col("user_id").cast("string").alias("station"), F.col("user_id").cast("int").alias("dahiti_id")).distinct()
    return water_levels.water_levels(answers, chosen).select("station", "dahiti_id", "target_name", "target_lat", "water_level_m", "water_level_err_m", "date")
