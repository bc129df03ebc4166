"""Tables written to the folder that driver and executors share, to end a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that names none, as in tests, gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="canopyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table and read again: what follows no longer depends on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a path for file writers; the shared folder must be mounted where tasks run."""
    found = shared_dir(spark)
    if "://" in found and not found.startswith("file://"):
        raise ValueError(f"files are written to mounted folders, not to {found}")
    return f"{found.removeprefix('file://')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
