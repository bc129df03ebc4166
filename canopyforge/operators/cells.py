"""Aggregates of points by cell, and what follows from them: candidate layers, outliers, densities, structure, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyforge.functions.points import exact_percentile, with_cells

KEY = ["ix", "iy"]


def cell_stats(points: DataFrame, cell_m: float, percentile: float | None = None, key: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """Number, least, greatest, mean z of each cell, and its percentile (linear) where one is asked for."""
    rows = with_cells(points, cell_m) if key == ("ix", "iy") else points
    aggs = [F.count("z").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.round(F.avg("z"), 9).alias("z_mean")]
    if percentile is not None:
        aggs.append(F.round(F.percentile("z", percentile), 10).alias("z_pct"))
    return rows.groupBy(*key).agg(*aggs)


def nearest_in_cell(points: DataFrame, cell_m: float) -> DataFrame:
    """z of the point next to each cell's centre; ties to the lower z, so that row order doesn't matter."""
    rows = with_cells(points, cell_m)
    dx, dy = F.col("x") - (F.col("ix") + 0.5) * cell_m, F.col("y") - (F.col("iy") + 0.5) * cell_m
    return rows.groupBy(*KEY).agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "z")).alias("best")).select(*KEY, F.col("best.d2").alias("d2"), F.col("best.z").alias("z"))


def candidate_layer(points: DataFrame, cell_m: float, dz: float) -> DataFrame:
    """Points within dz of the least z of their cell. The least comes by an aggregate that combines before it shuffles, and is joined
    back, which lets a very full cell be split, as a window would not."""
    rows = with_cells(points, cell_m)
    low = rows.groupBy(*KEY).agg(F.min("z").alias("z_low"))
    return rows.join(low, KEY).where(F.col("z") <= F.col("z_low") + dz)


def remove_outliers(points: DataFrame, most: float = 6.0) -> DataFrame:
    """Points whose robust z score, |z - median| / (1.4826 MAD + 1e-12), is at most most; clouds of under 10 points keep all."""
    rows = points.where(F.col("z").isNotNull())
    if rows.limit(10).count() < 10:
        return rows.withColumn("score", F.lit(0.0))
    mid = exact_percentile(rows, "z", 0.5)
    mad = exact_percentile(rows, F.abs(F.col("z") - mid), 0.5)
    return rows.withColumn("score", F.abs(F.col("z") - mid) / (1.4826 * (mad + 1e-12))).where(F.col("score") <= most)


def density_stats(points: DataFrame, cell_m: float, area_cells: int | None = None) -> DataFrame:
    """Occupied cells, their share of the extent's cells, and median, mean, quartiles of points in an occupied cell."""
    counts = with_cells(points, cell_m).groupBy(*KEY).agg(F.count("*").alias("n"))
    whole = F.lit(area_cells) if area_cells else (F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)
    return counts.agg(
        F.count("*").alias("occupied"), whole.cast("long").alias("cells"), F.round(F.count("*") / whole, 9).alias("occupancy"),
        F.median("n").alias("n_median"), F.round(F.avg("n"), 9).alias("n_mean"), F.round(F.percentile("n", 0.25), 9).alias("n_q25"), F.round(F.percentile("n", 0.75), 9).alias("n_q75"),
    )


def entropy(points: DataFrame, cell_m: float, bin_m: float, height: str = "h") -> DataFrame:
    """Foliage height diversity -sum p ln p over height bins of each cell, and the same over the log of the bins in use (0 for one
    bin). Cells whose greatest height is not above 0 have neither."""
    rows = with_cells(points, cell_m).where(F.col(height) >= 0).withColumn("bin", F.floor(F.col(height) / bin_m).cast("int"))
    bins = rows.groupBy(*KEY, "bin").agg(F.count("*").alias("n"), F.max(height).alias("top"))
    # sum p ln p = (sum n ln n) / N - ln N, which needs no second pass
    out = bins.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ln("n")).alias("nln"), F.count("*").alias("bins"), F.max("top").alias("top"))
    fhd = F.when(F.col("top") > 0, F.abs(F.ln("n") - F.col("nln") / F.col("n")))
    return out.select(*KEY, F.round(fhd, 6).alias("fhd"), F.round(F.when(F.col("top") > 0, F.when(F.col("bins") > 1, fhd / F.ln(F.greatest("bins", F.lit(2)))).otherwise(0.0)), 6).alias("vci"))


def structure_metrics(points: DataFrame, cell_m: float, bin_m: float, cover_from: float, least: float = 0.0, height: str = "h") -> DataFrame:
    """n, mean, max, sd (population) of heights from least on, the share at cover_from and above, FHD and VCI, by cell."""
    rows = with_cells(points.where(F.col(height) >= least), cell_m)
    stats = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.round(F.avg(height), 6).alias("h_mean"), F.max(height).alias("h_max"), F.round(F.stddev_pop(height), 6).alias("h_sd"),
        F.round(F.avg((F.col(height) >= cover_from).cast("double")), 6).alias("cover"),
    )
    return stats.join(entropy(points.where(F.col(height) >= least), cell_m, bin_m, height), KEY)


def otsu(df: DataFrame, column: str, bins: int = 256, least: int = 1000) -> DataFrame:
    """The histogram edge that parts a column's values with the greatest variance between; NULL for fewer than least values."""
    v = F.col(column)
    values = df.where(v.isNotNull()).select(v.alias("v"))
    lo, hi, n = (values.agg(f).scalar() for f in (F.min("v"), F.max("v"), F.count("v")))
    rows = values.withColumns({"lo": lo, "hi": hi})
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int"))
    hist = rows.groupBy(F.coalesce(index, F.lit(0)).alias("bin"), "lo", "hi").agg(F.count("*").alias("c")).withColumn("n", n)  # at most `bins` rows
    mid = F.col("lo") + (F.col("bin") + 0.5) * width
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.select("*", (F.col("c") * mid).alias("m")).select("*", F.sum("c").over(upto).alias("w0"), F.sum("m").over(upto).alias("m0"), F.sum("m").over(Window.partitionBy()).alias("mt"))
    w1 = F.col("n") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("mt") - F.col("m0")) / F.nullif(w1, F.lit(0))
    between = F.col("w0") * w1 * gap * gap
    best = sums.select("n", "bin", F.round(between, 3).alias("between"), F.round(mid, 9).alias("mid"))
    best = best.agg(F.max(F.struct("between", -F.col("bin"), "mid")).alias("b"), F.max("n").alias("n"))
    return best.select(F.when(F.col("n") >= least, F.col("b.mid")).alias("threshold"))


def top_m(points: DataFrame, cell_m: float, m: int) -> DataFrame:
    """The m lowest z of each cell, by rank."""
    w = Window.partitionBy(*KEY).orderBy("z")
    return with_cells(points, cell_m).select(*KEY, "z", F.row_number().over(w).alias("rank")).where(F.col("rank") <= m)


def envelope(layers: DataFrame, greatest: bool) -> DataFrame:
    """Cell-wise greatest or least value over layers (ix, iy, value); a cell missing in some has the others' value."""
    return layers.groupBy(*KEY).agg((F.max if greatest else F.min)("value").alias("value"))


def sampled(points: DataFrame, most: int, key: str = "point_id") -> DataFrame:
    """At most `most` points, those with the least hashes of their key: the same in every run, whatever the partitions."""
    return points.withColumn("_h", F.xxhash64(key)).orderBy("_h", key).limit(most).drop("_h")


def dataset_summary(tiles: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: the tiles, how many hold points (n > 0), and of those the median of each column's finite values."""
    fine = lambda c: F.when((F.col("n") > 0) & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    return tiles.agg(F.count("*").alias("tiles"), F.count_if(F.col("n") > 0).alias("occupied_tiles"), *[F.median(fine(c)).alias(f"median_{c}") for c in columns])


def stage_summary(records: DataFrame) -> DataFrame:
    """(stage, status counts, mean seconds) of records (stage, status, seconds)."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return records.groupBy("stage").agg(F.count("*").alias("total"), status("ok"), status("skipped"), status("failed"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def metrics(structure: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """The cells' metrics that are wanted, all by default; an unknown name raises."""
    known = [c for c in structure.columns if c not in KEY]
    if unknown := set(wanted) - set(known):
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {known}")
    return structure.select(*KEY, *(c for c in known if not wanted or c in wanted))
