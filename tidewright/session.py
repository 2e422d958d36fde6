"""Session settings, and the package's code for Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tidewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Partition counts are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch for Python workers; rows with whole texts would otherwise fill hundreds of megabytes.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers on any executor import this package, once per context, and bounds their batches by bytes."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(context, "_tidewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewright-code-")) / "tidewright_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tidewright_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate files under spark.checkpoint.dir; a temporary one only where that is unset and the
    master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewright-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and a lost executor repeats no more than a read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
