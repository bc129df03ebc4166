"""Neighbourhoods of cells.

Any statistic: each cell is sent to all cells whose window it is in (exploded offsets) and grouped there, an equi-shuffle;
greatest, least, sum and count of large windows: one running window along rows and one along columns, without copies.
Rasters are sparse rows (ix, iy, value); absent cells have no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["ix", "iy"]


def offsets(radius: int, cross: bool = False, centre: bool = True) -> Column:
    """Array of (dx, dy) of a square window, or of the four neighbours and the centre."""
    span = range(-radius, radius + 1)
    pairs = [(dx, dy) for dx in span for dy in span if (not cross or abs(dx) + abs(dy) <= radius) and (centre or (dx, dy) != (0, 0))]
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in pairs])


def spread(cells: DataFrame, radius: int, cross: bool = False, centre: bool = True) -> DataFrame:
    """Each cell at every target whose window it is in: (ix, iy) of the target, dx, dy of the source, and its other columns."""
    rows = cells.withColumn("o", F.explode(offsets(radius, cross, centre)))
    return rows.withColumns({"ix": F.col("ix") + F.col("o.dx"), "iy": F.col("iy") + F.col("o.dy"), "dx": -F.col("o.dx"), "dy": -F.col("o.dy")}).drop("o")


def focal(cells: DataFrame, radius: int, stat: Column, name: str, own_only: bool = True, centre: bool = True) -> DataFrame:
    """cells with the statistic of `value` over their square windows; own_only: for cells that are there, not for empty ones."""
    made = spread(cells.select(*KEY, "value"), radius, centre=centre).groupBy(*KEY).agg(stat.alias(name))
    return cells.join(made, KEY, "left" if own_only else "right")


def running(cells: DataFrame, radius: int, what: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """(ix, iy, value, focal): max, min, sum or count of square windows by two passes."""
    f = getattr(F, "sum" if what == "count" else what)
    wide = cells.withColumn("u", F.lit(1) if what == "count" else F.col("value"))
    # the first pass answers empty cells of a row only where the second needs them: they are given the row's neighbours
    rows = wide.withColumn("o", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    rows = rows.groupBy(*partition, (F.col("ix") + F.col("o")).alias("ix"), "iy").agg(f("u").alias("u"))
    w = Window.partitionBy(*partition, "ix").orderBy("iy").rangeBetween(-radius, radius)
    both = rows.withColumn("focal", f("u").over(w)).select(*partition, *KEY, "focal")
    return cells.join(both, [*partition, *KEY])


def local_maxima(cells: DataFrame, window: int, least: float) -> DataFrame:
    """Cells whose value is their window's greatest and at least `least`; window is an odd number of cells."""
    return running(cells, window // 2, "max").where((F.col("value") == F.col("focal")) & (F.col("value") >= least)).select(*KEY, "value")


def dilate(cells: DataFrame, times: int = 1, square: bool = False) -> DataFrame:
    """The set of cells grown by its four (or eight) neighbours, times over."""
    out = cells.select(*KEY).distinct()
    return spread(out, times, cross=not square).select(*KEY).distinct()


def robust_vote(cells: DataFrame, radius: int, most: float, least_cells: int, floor: float) -> DataFrame:
    """For each cell with values in its window: their median, without those further than most robust deviations (MAD, floored) from
    a first median; NULL where fewer than least_cells are left."""
    near = spread(cells.select(*KEY, "value"), radius).select(*KEY, "value")
    first = near.groupBy(*KEY).agg(F.median("value").alias("mid"))
    apart = near.join(first, KEY)
    mad = apart.groupBy(*KEY).agg(F.median(F.abs(F.col("value") - F.col("mid"))).alias("mad"))
    kept = apart.join(mad, KEY).where(F.abs(F.col("value") - F.col("mid")) / (1.4826 * F.greatest("mad", F.lit(floor))) <= most)
    return kept.groupBy(*KEY).agg(F.count("*").alias("n"), F.median("value").alias("value")).select(*KEY, "n", F.when(F.col("n") >= least_cells, F.col("value")).alias("value"))


def smooth(cells: DataFrame, sigma: float) -> DataFrame:
    """Gaussian of the cells that are there, weights renewed over them, radius ceil(3 sigma), one axis after the other."""
    from math import ceil, exp

    r = max(1, ceil(3 * sigma))
    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(weights)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-r, r + 1), weights, strict=True)])
    for axis in KEY:
        rows = cells.select(*KEY, "value").withColumn("t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("t.k"))
        made = rows.groupBy(*KEY).agg((F.sum(F.col("value") * F.col("t.w")) / F.sum("t.w")).alias("value"))
        cells = cells.select(*KEY).join(made, KEY)
    return cells


def fill_local(cells: DataFrame, holes: DataFrame, radius: int, how: str, least: int = 1, power: float = 2.0) -> DataFrame:
    """Values for holes (ix, iy) from the window around: mean, median, or idw with weights 1/d^power in cells."""
    near = spread(cells.select(*KEY, "value"), radius, centre=False).join(holes.select(*KEY), KEY, "left_semi")
    # whole squares, whose powers are exact where a root's square isn't
    far = F.pow((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"), F.lit(power / 2))
    stat = {"mean": F.avg("value"), "median": F.median("value"), "idw": F.sum(F.col("value") / far) / F.sum(1 / far)}[how]
    return near.groupBy(*KEY).agg(stat.alias("value"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def fix_pits(cells: DataFrame, threshold: float, radius: int = 1) -> DataFrame:
    """Values further than threshold below the median of their window become that median."""
    return focal(cells, radius, F.median("value"), "mid").select(*KEY, F.when(F.col("value") < F.col("mid") - threshold, F.col("mid")).otherwise(F.col("value")).alias("value"))


def mean_repeated(cells: DataFrame, ends: tuple[int, int, int, int], radius: int = 1) -> DataFrame:
    """(ix, iy, value): the mean of every cell's window over the extent (least and greatest ix, iy), edges repeated beyond it; cells
    without a value don't count, and windows without any have none."""
    x0, x1, y0, y1 = ends

    def reach(v: str, lo: int, hi: int) -> Column:
        # a cell on the edge stands for those beyond it, too
        targets = F.sequence(F.greatest(F.lit(lo), F.col(v) - radius), F.least(F.lit(hi), F.col(v) + radius))
        times = lambda t: F.lit(1) + F.when(F.col(v) == lo, F.greatest(F.lit(0), F.lit(lo + radius) - t)).otherwise(0) + F.when(F.col(v) == hi, F.greatest(F.lit(0), t - F.lit(hi - radius))).otherwise(0)
        return F.transform(targets, lambda t: F.struct(t.alias("at"), times(t).alias("n")))

    wide = cells.where("value is not null").withColumn("a", F.explode(reach("ix", x0, x1))).withColumn("b", F.explode(reach("iy", y0, y1)))
    n = F.col("a.n") * F.col("b.n")
    return wide.groupBy(F.col("a.at").alias("ix"), F.col("b.at").alias("iy")).agg((F.sum(F.col("value") * n) / F.sum(n)).alias("value"))
