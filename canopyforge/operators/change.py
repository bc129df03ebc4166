"""Change between rasters of several epochs: (epoch, col, row, v)."""

from __future__ import annotations

from math import hypot

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["col", "row"]


def detection_limit(threshold: float = 0.0, sigma1: float | None = None, sigma2: float | None = None, mode: str = "threshold_only") -> float:
    """The least change that counts: the threshold, the root of the summed squares of both sigmas (`rss`), or the greater (`max`)."""
    both = hypot(sigma1 or 0.0, sigma2 or 0.0)
    if mode == "threshold_only":
        return float(threshold)
    if mode == "rss":
        return both
    if mode == "max":
        return max(float(threshold), both)
    raise ValueError(f"unknown mode {mode!r}")


def pairs(epochs: DataFrame, mode: str, baseline: int = 0) -> DataFrame:
    """(e1, e2) of distinct epochs in order: `pairwise`, `sequential`, or `baseline` (its position, moved into range) with all others.

    epochs is one row an epoch, a handful; they are numbered and matched by number, not row by row.
    """
    from pyspark.sql import Window

    e = epochs.select("epoch").distinct().withColumn("i", F.row_number().over(Window.orderBy("epoch")) - 1)
    n = F.max("i").over(Window.partitionBy())
    if mode == "sequential":
        after = F.lead("epoch").over(Window.orderBy("epoch"))
        return e.select(F.col("epoch").alias("e1"), after.alias("e2")).where("e2 is not null")
    if mode == "pairwise":
        both = e.withColumn("last", n).withColumn("j", F.explode(F.sequence("i", "last"))).where("j > i")
    elif mode == "baseline":
        base = F.greatest(F.lit(0), F.least(F.lit(baseline), n))
        both = e.withColumn("b", base).where("i <> b").select(F.col("b").alias("i"), F.col("i").alias("j"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    first, second = e.select("i", F.col("epoch").alias("e1")), e.select(F.col("i").alias("j"), F.col("epoch").alias("e2"))
    return both.select("i", "j").join(first, "i").join(second, "j").select("e1", "e2")


def change(rasters: DataFrame, epoch_pairs: DataFrame, limit: float) -> DataFrame:
    """(e1, e2, col, row, delta, absolute, gain, loss, stable, detected) of the cells that both epochs of a pair have."""
    p = F.broadcast(epoch_pairs)  # a row for each pair of epochs, not of cells
    a = rasters.join(p, rasters["epoch"] == p["e1"]).select("e1", "e2", *KEY, F.col("v").alias("v1"))
    b = rasters.select(F.col("epoch").alias("e2"), *KEY, F.col("v").alias("v2"))
    d = a.join(b, ["e2", *KEY]).where("v1 is not null and v2 is not null").withColumn("delta", F.col("v2") - F.col("v1"))
    return d.select("e1", "e2", *KEY, "delta", F.abs("delta").alias("absolute"), (F.col("delta") > limit).alias("gain"), (F.col("delta") < -limit).alias("loss"), (F.abs("delta") <= limit).alias("stable"), (F.abs("delta") > limit).alias("detected"))


def summary(changes: DataFrame, cell_area: float) -> DataFrame:
    """One row a pair: valid cells, least, greatest, mean, sd (population) of delta, areas and volumes of gain and loss."""
    gain, loss = F.col("gain"), F.col("loss")
    area = lambda c: (F.count_if(c) * cell_area).cast("double")
    volume = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("delta"))), F.lit(0.0)) * cell_area, 6)
    return changes.groupBy("e1", "e2").agg(
        F.count("*").alias("valid_cells"), F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"), F.round(F.avg("delta"), 6).alias("delta_mean"), F.round(F.stddev_pop("delta"), 6).alias("delta_std"),
        area(gain | loss).alias("changed_area"), area(F.col("stable")).alias("stable_area"), area(gain).alias("gain_area"), area(loss).alias("loss_area"),
        volume(gain).alias("gain_volume"), volume(loss).alias("loss_volume"), volume(gain | loss).alias("net_volume"),
    )


def order_key(names: DataFrame, column: str = "name") -> DataFrame:
    """names with sort_key: the integers in a name, by which series of files are in order of time."""
    return names.withColumn("sort_key", F.regexp_extract_all(F.col(column), F.lit(r"(\d+)"), F.lit(1)).cast("array<bigint>"))
