"""A JSON service as a Python data source."""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship, written


def http_post(url: str, fields: dict, timeout: float = 60) -> tuple[int, str]:
    body = urllib.parse.urlencode(fields).encode()
    with urllib.request.urlopen(urllib.request.Request(url, body), timeout=timeout) as r:
        return r.status, r.read().decode()


#: Answers that another try may mend.
PASSING = (408, 425, 429, 500, 502, 503, 504)


def call(transport: Callable[[str, dict], tuple[int, str]], url: str, fields: dict) -> tuple[str | None, str | None, bool]:
    """(answer, error, whether another try may help): the text if it is 200 and JSON; else why it is not."""
    try:
        status, text = transport(url, fields)
    except TimeoutError:
        return None, "timeout", True
    except urllib.error.HTTPError as e:
        status, text = e.code, ""
    except OSError as e:
        slow = isinstance(getattr(e, "reason", None), TimeoutError)
        return None, "timeout" if slow else f"connection: {e}", True
    except ValueError as e:
        return None, f"transport: {e}", False
    if status != 200:
        return None, f"status {status}", status in PASSING
    try:
        json.loads(text)
    except ValueError:
        return None, "not JSON", False
    return text, None, False


def tried(ask: Callable[[], tuple[str | None, str | None, bool]], tries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, tries made): ask() up to `tries` times, with a wait between that doubles each time."""
    for k in range(1, max(1, tries) + 1):
        answer, error, again = ask()
        if error is None or not again or k >= tries:
            return answer, error, k
        sleep(wait * 2 ** (k - 1))
    raise AssertionError


def box_fields(lat: float, lon: float, radius_km: float = 200) -> dict[str, float]:
    """The box around a point that the list service is asked for."""
    d = radius_km / 111
    return {"min_lat": lat - d, "max_lat": lat + d, "min_lon": lon - d, "max_lon": lon + d}


class Call(InputPartition):
    def __init__(self, name: str, fields: dict):
        self.name, self.fields = name, fields


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.calls = options["url"], json.loads(options["calls"])
        module, _, name = options.get("transport", f"{__name__}:http_post").partition(":")
        self.place = module, name
        self.common = json.loads(options.get("fields", "{}"))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1))

    def partitions(self) -> list[InputPartition]:
        return [Call(name, fields) for name, fields in self.calls.items()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        transport = getattr(importlib.import_module(self.place[0]), self.place[1])
        answer, error, tries = tried(lambda: call(transport, self.url, self.common | partition.fields), self.tries, self.wait)
        yield partition.name, answer, error, tries


class ServiceSource(DataSource):
    """One row (name, answer, error, tries) per call; one task each. A failed call has a null answer and says why.

    Options: url, calls (JSON: name to fields), fields (common ones, such as a key), transport, tries (3: as often a call
    is made that a timeout, a lost connection or a busy service fails) and wait (1: seconds before the second, which
    double).
    """

    @classmethod
    def name(cls) -> str:
        return "json_service"

    def schema(self) -> str:
        return "name string, answer string, error string, tries int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ServiceReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ServiceSource)


def request_key(url: str, fields: dict) -> str:
    """A request's name among kept answers: a hash of the address and the fields (common ones, such as a key, left out)."""
    return hashlib.sha256(json.dumps([url, fields], sort_keys=True).encode()).hexdigest()


def resumed(spark: SparkSession, kept: str, url: str, calls: dict[str, dict], **options: str) -> DataFrame:
    """name, answer, error and tries of each call; answers are kept in the table at `kept`, by request.

    Only calls whose answer is not there yet are made, so a rerun asks for what failed (tries is 0 for a kept answer),
    and equal requests under two names are one. Answers are added in one write after the calls of a run: those of a run
    that was broken off are asked for again.
    """
    register(spark)
    keys = {name: request_key(url, fields) for name, fields in calls.items()}
    asked = spark.createDataFrame(list(keys.items()), "name string, request string")
    there = _kept(spark, kept)
    known = {r["request"] for r in asked.join(there, "request", "left_semi").select("request").distinct().collect()}  # of the calls at most
    new = {key: calls[name] for name, key in keys.items() if key not in known}
    outcome = spark.createDataFrame([], "request string, answer string, error string, tries int")
    if new:
        found = spark.read.format("json_service").options(url=url, calls=json.dumps(new), **options).load()
        outcome = written(found.withColumnRenamed("name", "request"))
        outcome.filter("error is null").select("request", "answer").write.mode("append").parquet(kept)
    old = there.filter(F.col("request").isin(sorted(known))).dropDuplicates(["request"]).select("request", "answer", F.lit(None).cast("string").alias("error"), F.lit(0).alias("tries"))
    return asked.join(old.unionByName(outcome), "request").select("name", "answer", "error", "tries")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "request string, answer string"
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    there = spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).parquet(*there.inputFiles()) if there.inputFiles() else there  # not what this run adds
