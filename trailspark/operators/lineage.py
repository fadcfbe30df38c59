"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = "1000"


def python_workers(spark: SparkSession) -> None:
    """Readies a session for kernels in Python.

    Workers find this package where the driver does, if it isn't installed (a cluster
    installs or ships it). Arrow batches hold ``BATCH_ROWS`` rows unless the session sets
    their size: whole texts are rows here, and Spark's 10,000 of them fill a worker's memory.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, None) in (None, "10000"):
        spark.conf.set(size, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A session on one machine that names none gets a temporary one; elsewhere that is an
    error, as each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='trailspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_kept: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """The folder of this application's tables; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/trailspark/{spark.sparkContext.applicationId}"
    if path not in _kept:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _kept.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored so far; results that still read them must have been written before."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: no lineage, and safe when an executor is lost."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
