"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: The characters that separate words in every operator here (bytes.split() splits at exactly these).
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
#: Stands for a null doc_id where rows are ordered or joined: after every other document.
NO_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ready(df: DataFrame) -> DataFrame:
    """df, whose session's Python workers can import this package from here on."""
    ship(df.sparkSession)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    for tables in _scratch:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile, in order."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        _scratch.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark deletes shuffle files that nothing refers to any more only when that happens."""
    time.sleep(0.5)  # what ended last is still being told to listeners
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID))


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{column.replace('`', '``')}`")


def row_ties(docs: DataFrame) -> DataFrame:
    """docs with _id and _tie (a hash of the row's columns): rows that agree in both are repeats of one row."""
    hashed = [F.xxhash64(named(f.name)) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return docs.select(F.struct(*map(named, docs.columns)).alias("_row"), id_key().alias("_id"), F.xxhash64(*hashed).alias("_tie"))


def id_remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id has a null remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def once(column: Column) -> Column:
    """column, computed where it is defined: a guard that is not deterministic (and always true) keeps the optimizer
    from copying a costly expression into later filters and into lambdas, where it would run for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def spread_rank(df: DataFrame, keys: list[str], order: list[str], count: str, rows: int = 500, ties: list[str] | None = None) -> DataFrame:
    """Adds rank: each row's place, from 0, among the rows of its keys, in an order fixed by the columns `order` (then `ties`).

    `count` holds the number of rows of the keys. A large group is split by a hash of the order columns, so that no
    task sorts much more than `rows` rows of one group (200,000 of a very large one); the parts' offsets are running
    sums over their sizes.
    """
    most = F.greatest(F.lit(1024), F.ceil(F.col(count) / 200_000))  # parts of a group, so that their offsets stay few
    parts = F.greatest(F.lit(1), F.least(most, F.ceil(F.col(count) / rows))).cast("long")
    # dealt out by the salt too: what came from a join on the keys would else stay with its group
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), parts)).repartition(*keys, "_salt")
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order, *(ties or []))
    ranked = salted.withColumn("_place", F.row_number().over(inside)).join(offsets, [*keys, "_salt"], "left")
    return ranked.withColumn("rank", F.col("_before") + F.col("_place") - 1).drop("_salt", "_place", "_before")


def smaller(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than `rows` rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def word_hashes(text: bytes | None, lower: bool = False) -> np.ndarray:
    """XXH64 of each word, in order."""
    words = ((text or b"").lower() if lower else text or b"").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))


def portions(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds some `size` bytes of the column at most (a longer text comes alone)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at a task's end: its Python worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_remembered: list = []


def remembered(f: Callable) -> Callable:
    """f, with what it returned kept by a Python worker between tasks, until a task that has no use for it calls forget()."""
    _remembered.append(f := functools.lru_cache(maxsize=2)(f))
    return f


def forget() -> None:
    """Lets go of what the tasks of earlier stages remembered in this Python worker; it would stand beside this stage's arrays."""
    if any(f.cache_info().currsize for f in _remembered):
        for f in _remembered:
            f.cache_clear()
        gc.collect()  # what is remembered refers to itself
        give_back()
