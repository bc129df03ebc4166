"""Points that arrive as files, kept as tables of cells: an addition for clouds that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopyforge.functions.points import with_cells

SCHEMA = "x double, y double, z double, classification int, epoch int"


def arriving(spark: SparkSession, folder: str, schema: str = SCHEMA, files_at_once: int = 100) -> DataFrame:
    """Points of parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keep_cells(points: DataFrame, cell_m: float, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's partial cells (batch, ix, iy, n, z_min, z_max, z_sum). A batch that runs again overwrites its own
    folder, so that every point counts once."""

    def save(batch: DataFrame, number: int) -> None:
        part = with_cells(batch, cell_m).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.sum("z").alias("z_sum"))
        part.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cells_so_far(spark: SparkSession, target: str) -> DataFrame:
    """The cells of all batches together."""
    parts = spark.read.parquet(target)
    return parts.groupBy("ix", "iy").agg(F.sum("n").alias("n"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), (F.sum("z_sum") / F.sum("n")).alias("z_mean"))
