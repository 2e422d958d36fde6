"""Delimited files by the names of their columns, whatever the order, the synonyms and the extra columns of each file."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.columns import missing_to_null, nan_to_null

#: Headers that are read at once.
THREADS = 16
#: Files that an observation counts one by one; of more, only the sums are observed.
COUNTED_FILES = 200
CORRUPT = "_corrupt_record"


def first_line(spark: SparkSession, uri: str) -> str | None:
    """A file's first line that is not blank, through the file system it lies in; null if there is none."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            if line.strip("\ufeff \t\r"):
                return line
        return None
    finally:
        reader.close()


def plain(uri: str) -> str:
    """A listed file's address as _metadata.file_path has it."""
    return uri.replace("file:///", "file:/", 1)


def headers(spark: SparkSession, folder: str, glob: str, exclude: Iterable[str] = (), only: Iterable[str] | None = None) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder that match, by the names in their first line; empty files and excluded paths are left out,
    and with `only` those that it does not name (as _metadata.file_path has them).

    Spark lists the files; of each the first buffer is read, as in the inference of a schema.
    """
    found = spark.read.schema("value string").option("pathGlobFilter", glob).text(_escaped(folder)).inputFiles()
    found = sorted(f for f in found if not any(part in unquote(f) for part in exclude))
    found = found if only is None else [f for f in found if plain(f) in set(only)]
    with ThreadPoolExecutor(THREADS) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), found))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(found, lines, strict=True):
        if line is not None:
            out.setdefault(tuple(next(csv.reader([line.removeprefix("\ufeff")]))), []).append(file)
    return out


def resolve_date(columns: Iterable[str]) -> str:
    """The first column whose name holds date or time, else the first."""
    columns = list(columns)
    return next((c for c in columns if "date" in c.lower() or "time" in c.lower()), columns[0])


def positions(header: tuple[str, ...], names: Iterable[str], synonyms: Mapping[str, Iterable[str]] | None = None, date: str | None = None, prefer: bool = False) -> dict[str, int]:
    """Where each of the names stands in a header: under its own name, else under a synonym.

    More than one column for a name is refused; with `prefer` the name itself goes first, then its synonyms in their
    order. `date` names the column that, where it is not found so, is the first that holds date or time, else the first.
    """
    out = {}
    for name in names:
        hits = [k for known in (name, *(synonyms or {}).get(name, ())) for k, c in enumerate(header) if c == known]
        if len(hits) > 1 and not prefer:
            raise ValueError(f"more than one column for {name}: {[header[k] for k in hits]}")
        if hits:
            out[name] = hits[0]
        elif name == date:
            out[name] = header.index(resolve_date(header))
    if len(set(out.values())) < len(out):
        raise ValueError(f"one column for more than one of {sorted(out)} in {list(header)}")
    return out


def _escaped(path: str) -> str:
    """A path with the characters escaped that a pattern would read."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def _typed(value: Column, field: StructField) -> Column:
    """A cell as the field's type; null if it is missing, not a number or not of the type."""
    if field.dataType.typeName() == "string":
        return missing_to_null(value)
    out = missing_to_null(value).try_cast(field.dataType)
    return nan_to_null(out) if field.dataType.typeName() in ("double", "float") else out


def read_checked(
    spark: SparkSession, folder: str, glob: str, schema: str | StructType, exclude: Iterable[str] = (), file_column: str = "file", synonyms: Mapping[str, Iterable[str]] | None = None,
    date: str | None = None, prefer: bool = False, required: Iterable[str] = (), separator: str = ",", multi_line: bool = False, only: Iterable[str] | None = None,
) -> DataFrame:
    """The columns of `schema` of every file that matches, by name, with file_column, and with `wrong` and `line`.

    wrong is null for a sound row; else the names of the columns whose cell is there but not of their type, or
    `columns` if the row has more or fewer cells than its header. line is such a row as it was read.

    Files with the same header are read by one scan, with that header as its schema; scans are stacked by name. A column
    that a file lacks is null there (an error if it is `required`); columns that the schema does not name are not
    returned. Strings for missing values and NaN become null. A byte order mark is skipped; quotes inside quoted cells are doubled.
    Line feeds in cells need multi_line, and then a file is one task's.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    scans = []
    for header, paths in headers(spark, folder, glob, exclude, only).items():
        at = positions(header, wanted.names, synonyms, date, prefer)
        if lacking := set(required) - set(at):
            raise ValueError(f"no {sorted(lacking)} in {paths[0]}: {list(header)}")
        cells = StructType([StructField(f"c{k}", StructType.fromDDL("x string")["x"].dataType) for k in range(len(header))]).add(CORRUPT, "string")
        rows = spark.read.schema(cells).option("header", True).option("sep", separator).option("escape", '"').option("multiLine", multi_line).option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT).csv([_escaped(unquote(p)) for p in paths])
        typed = {f.name: _typed(F.col(f"c{at[f.name]}"), f) if f.name in at else F.lit(None).cast(f.dataType) for f in wanted}
        bad = [F.when(missing_to_null(f"c{at[f.name]}").isNotNull() & missing_to_null(f"c{at[f.name]}").try_cast(f.dataType).isNull(), F.lit(f.name)) for f in wanted if f.name in at and f.dataType.typeName() != "string"]
        wrong = F.when(F.col(CORRUPT).isNotNull(), F.lit("columns")).otherwise(F.nullif(F.concat_ws(",", *bad), F.lit(""))) if bad else F.when(F.col(CORRUPT).isNotNull(), F.lit("columns"))
        line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[f"c{k}" for k in range(len(header))]), {"sep": separator, "escape": '"'}))
        scans.append(rows.select(*[c.alias(n) for n, c in typed.items()], F.col("_metadata.file_path").alias(file_column), wrong.alias("wrong"), F.when(wrong.isNotNull(), line).alias("line")))
    if not scans:
        return spark.createDataFrame([], StructType([*wanted.fields]).add(file_column, "string").add("wrong", "string").add("line", "string"))
    return reduce(DataFrame.unionByName, scans)


def read_csv(spark: SparkSession, folder: str, glob: str, schema: str | StructType, exclude: Iterable[str] = (), file_column: str | None = None, **how) -> DataFrame:
    """All files of a folder that match, by column name, without those whose path contains an excluded string.

    A row with the wrong number of cells or a cell that is not of its type is kept with nulls; see read_checked (which
    takes the further parameters) and quarantined for those. file_column names a column for each row's file.
    """
    found = read_checked(spark, folder, glob, schema, exclude, file_column or "_file", **how)
    return found.drop("wrong", "line", *([] if file_column else ["_file"]))


def read_first(spark: SparkSession, folder: str, glob: str, schema: str | StructType, **how) -> DataFrame:
    """The first file by name of those that match; an error if none does."""
    found = sorted(spark.read.schema("value string").option("pathGlobFilter", glob).text(_escaped(folder)).inputFiles())
    if not found:
        raise FileNotFoundError(f"no {glob} in {folder}")
    name = unquote(found[0].rpartition("/")[2])
    return read_csv(spark, folder, "".join(f"\\{c}" if c in "*?[]{}\\^," else c for c in name), schema, **how)


def quarantined(checked: DataFrame, path: str, file_column: str = "file") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(sound rows; the others, with wrong and line; counts) of read_checked, in one job over the files.

    Both sides are written in the same pass, under path. counts comes from an observation of that pass: rows, wrong, and
    for each file (up to COUNTED_FILES of them) its path with the number of its wrong rows.
    """
    files = [plain(f) for f in checked.inputFiles()]
    spark, watch = checked.sparkSession, Observation("quarantine")
    each = [F.count_if(F.col("wrong").isNotNull() & (F.col(file_column) == f)).alias(f"file{k}") for k, f in enumerate(files)] if len(files) <= COUNTED_FILES else []
    seen = checked.observe(watch, F.count(F.lit(1)).alias("rows"), F.count("wrong").alias("wrong"), *each)
    marked = seen.withColumn("sound", F.col("wrong").isNull())
    marked.write.partitionBy("sound").parquet(path)
    counts = watch.get
    out = {"rows": counts["rows"], "wrong": counts["wrong"]} | {f: counts[f"file{k}"] for k, f in enumerate(files[: len(each)])}
    both = spark.read.schema(marked.schema).parquet(_escaped(path))
    return both.filter("sound").drop("sound", "wrong", "line"), both.filter("not sound").drop("sound"), out
