"""A sink of whole files under names of their own, which appear when every task has ended well."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

BOM = "\ufeff"
#: Bytes that a task gathers before it writes.
BUFFER = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: name to the place where it lies until the job commits."""

    places: dict[str, str]


def store(path: str):
    """(file system, path in it) of a path or an address that both the driver and the executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows (file, line), those of a file together and in order. A task writes each file into a staging folder; commit
    moves all of them under their names, abort removes the staging folder. A file that exists is replaced, or kept and
    refused where overwrite is false. Nothing stands under its name before every task has ended well."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header"), overwrite
        self.bom = options.get("bom", "false").lower() == "true"
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, root = store(self.path)
        places: dict[str, str] = {}
        own, name, out, lines, size = uuid.uuid4().hex, None, None, [], 0

        def flush() -> None:
            if lines:
                out.write("".join(lines).encode())
            lines.clear()

        try:
            for batch in iterator:
                for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if file != name:
                        if out:
                            flush()
                            out.close()
                        if not file or file in places or file != posixpath.basename(file) or file.startswith(("_", ".")):
                            raise ValueError(f"{file!r} is no file name, or its rows are not together")
                        name, places[file], size = file, f"{root}/{self.staging}/{own}-{len(places)}", 0
                        files.create_dir(f"{root}/{self.staging}", recursive=True)
                        out = files.open_output_stream(places[file])
                        if first := BOM * self.bom + (f"{self.header}\n" if self.header else ""):
                            lines.append(first)
                    lines.append(f"{line}\n")
                    size += len(line)
                    if size >= BUFFER:
                        flush()
                        size = 0
            if out:
                flush()
        finally:
            if out:
                out.close()
        return Written(places)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        names = [n for m in messages if m for n in m.places]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"two tasks wrote {sorted({n for n in names if names.count(n) > 1})}: rows of a file have to be together")
            if not self.overwrite:
                from pyarrow.fs import FileType

                if there := [i.base_name for i in files.get_file_info([f"{root}/{n}" for n in names]) if i.type != FileType.NotFound]:
                    raise FileExistsError(f"{sorted(there)} in {self.path}")
            for m in messages:
                for name, place in (m.places if m else {}).items():
                    files.move(place, f"{root}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class NamedFiles(DataSource):
    """Format named_files. Options: path, header (the first line of each file), bom (true: a byte order mark before it)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(dict(self.options), overwrite)


def header_line(columns: list[str], separator: str = ",") -> str:
    return separator.join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in (separator, '"', "\n", "\r")) else c for c in columns)


def write_named(df: DataFrame, path: str, file: Column | str, order: list[str] = (), bom: bool = False, overwrite: bool = True, **formats: str) -> None:
    """Writes df as one CSV file with a header for each value of `file` (a column, or an expression), which is not
    written itself if it is a column; the rows of a file by the columns `order`.

    The rows of a file meet in one task, sorted on disk where they must be, and are written as they come: memory does
    not grow with a file. formats: further options of the CSV text (dateFormat, timestampNTZFormat, nullValue and so on).
    """
    spark: SparkSession = df.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    kept = [c for c in df.columns if not isinstance(file, str) or c != file]
    text = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in kept]), {"quote": '"', "escape": '"', "emptyValue": "", **formats})
    rows = df.withColumn("_file", F.col(file) if isinstance(file, str) else file).repartition("_file").sortWithinPartitions("_file", *order)
    lines = rows.select(F.col("_file").cast("string").alias("file"), text.alias("line"))
    options = {"path": path, "header": header_line(kept), "bom": str(bom).lower()}
    lines.write.format("named_files").options(**options).mode("overwrite" if overwrite else "append").save()
