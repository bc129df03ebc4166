"""Looking a raster up at points, and points up at cells: bilinear, nearest, inverse distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyforge.functions.storage import written

KEY = ["ix", "iy"]


def corners(cells: DataFrame, columns: tuple[str, ...] = ("value",), clamp: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(ix, iy, and v<k> of each column) of every base cell that some cell is a corner of: k = dx + 2 dy for the cell itself, that to the
    right, that above and that to the right above. clamp: least and greatest ix and iy, which corners are moved into."""

    def bases(v: str, lo: int | None, hi: int | None) -> Column:
        pair = lambda at, d: F.array(F.struct((F.col(v) - at).alias("at"), F.lit(d).alias("d")))
        own = F.concat(pair(0, 0), pair(1, 1))
        if lo is None:
            return own
        none = F.filter(own, lambda _: F.lit(False))
        return F.concat(own, F.when(F.col(v) == lo, pair(1, 0)).otherwise(none), F.when(F.col(v) == hi, pair(0, 1)).otherwise(none))

    x0, x1, y0, y1 = clamp or (None,) * 4
    rows = cells.select(*KEY, *columns).withColumn("bx", F.explode(bases("ix", x0, x1))).withColumn("by", F.explode(bases("iy", y0, y1)))
    k = F.col("bx.d") + 2 * F.col("by.d")
    return rows.groupBy(F.col("bx.at").alias("ix"), F.col("by.at").alias("iy")).agg(*[F.max(F.when(k == i, F.col(c))).alias(f"{c}_{i}") for c in columns for i in range(4)])


def bilinear(points: DataFrame, cells: DataFrame, cell_m: float, anchor: str = "corner", columns: tuple[str, ...] = ("value",), clamp: tuple[int, int, int, int] | None = None) -> DataFrame:
    """points with each of the cells' columns interpolated from the four cells around; anchor: cell values are held to be at the cells'
    lower left corners or at their centres. NULL if a corner has no value (for `corner`, the value of the point's own cell then).
    clamp: least and greatest ix and iy, which corners are moved into.

    The raster gets its corners side by side first, so that points are joined once, by their base cell, whatever the number of
    columns; they need no key, and repeated points stay.
    """
    shift = 0.5 if anchor == "centre" else 0.0
    u, v = F.col("x") / cell_m - shift, F.col("y") / cell_m - shift
    i, j = F.floor(u).cast("int"), F.floor(v).cast("int")
    if clamp:
        i_at, j_at = F.greatest(F.lit(clamp[0] - 1), F.least(F.lit(clamp[1]), i)), F.greatest(F.lit(clamp[2] - 1), F.least(F.lit(clamp[3]), j))
    else:
        i_at, j_at = i, j
    wide = corners(cells, columns, clamp).withColumnsRenamed({"ix": "_ix", "iy": "_iy"} | {f"{c}_{k}": f"_{c}_{k}" for c in columns for k in range(4)})
    rows = points.withColumns({"_ix": i_at, "_iy": j_at, "_a": u - i, "_b": v - j}).join(wide, ["_ix", "_iy"], "left")
    made = {}
    for c in columns:
        total = F.lit(0.0)
        for k in range(4):
            w = (F.col("_a") if k % 2 else 1 - F.col("_a")) * (F.col("_b") if k > 1 else 1 - F.col("_b"))
            total = total + w * F.col(f"_{c}_{k}")
        made[c] = F.coalesce(total, F.col(f"_{c}_0")) if anchor == "corner" else total
    return rows.withColumns(made).drop("_ix", "_iy", "_a", "_b", *(f"_{c}_{k}" for c in columns for k in range(4)))


def _blocks(df: DataFrame, size: float, x: str, y: str, around: bool = False) -> DataFrame:
    """df with bx, by of the block of the given size that (x, y) is in; around: once for each of the nine blocks around it."""
    bx, by = F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long")
    if not around:
        return df.withColumns({"bx": bx, "by": by})
    near = F.sequence(F.lit(-1), F.lit(1))
    return df.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns({"bx": bx + F.col("_dx"), "by": by + F.col("_dy")}).drop("_dx", "_dy")


def rounds(wanted: DataFrame, key: list[str], size: float, whole: float, search: Callable[[DataFrame, float, bool], DataFrame], keep: list[str]) -> DataFrame:
    """What search(left, size, last) finds for the wanted rows, with the size doubled for those it leaves open, until none is left or the
    size reaches the whole. Each round is written, so that no round makes those before it again."""
    left, found = wanted, None
    while True:
        last = size >= whole
        done = written(search(left, size, last).select(*keep), "lookup-found")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        left = written(left.join(done.select(*key), key, "left_anti"), "lookup-open")
        if left.isEmpty():
            return found
        size = 2 * size


def _extent(*sides: tuple[DataFrame, str, str]) -> float | None:
    """More than the greatest difference in x or y within and between the tables; None if one of them is empty."""
    ends = [df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first() for df, x, y in sides]
    if any(e[0] is None for e in ends):
        return None
    return max(max(e[2 * d + 1] for e in ends) - min(e[2 * d] for e in ends) for d in (0, 1)) + 1.0


def idw(points: DataFrame, cells: DataFrame, cell_m: float, k: int = 8, power: float = 2.0, reach: int = 2) -> DataFrame:
    """(ix, iy, value) at the centres of cells: the k nearest points weighted by 1/max(d, 1e-6)^power, ties by z.

    Cells look at the nine blocks of `reach` cells around them. That finds the k nearest only where they are all within a
    block's size of the centre; other cells are searched again with twice the size, until none is left or a block covers
    all points, so that the result is exact.
    """
    index = points.select(F.col("x").alias("px"), F.col("y").alias("py"), "z")
    wanted = cells.select(*KEY, ((F.col("ix") + 0.5) * cell_m).alias("cx"), ((F.col("iy") + 0.5) * cell_m).alias("cy"))
    whole = _extent((index, "px", "py"), (wanted, "cx", "cy"))
    if whole is None:
        return cells.select(*KEY, F.lit(None).cast("double").alias("value")).limit(0)

    def search(left: DataFrame, size: float, last: bool) -> DataFrame:
        near = _blocks(left, size, "cx", "cy", True).join(_blocks(index, size, "px", "py"), ["bx", "by"])
        ex, ey = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
        near = near.select(*KEY, (ex * ex + ey * ey).alias("d2"), "z")
        w = Window.partitionBy(*KEY).orderBy("d2", "z")
        best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        weight = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-6)), F.lit(power))
        made = best.groupBy(*KEY).agg((F.sum(F.col("z") * weight) / F.sum(weight)).alias("value"), F.count("*").alias("n"), F.max("d2").alias("far"))
        return made.where(((F.col("n") >= k) & (F.sqrt("far") <= size)) | F.lit(last))

    return rounds(wanted, KEY, reach * cell_m, whole, search, [*KEY, "value"])


def nearest_cell(wanted: DataFrame, cells: DataFrame, reach: int = 4) -> DataFrame:
    """(ix, iy, value, d2) of wanted cells from the nearest cell that has a value (ties: least ix, then iy), by growing blocks."""
    index = cells.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), "value")
    whole = _extent((index, "sx", "sy"), (wanted, "ix", "iy"))
    if whole is None:
        return wanted.select(*KEY, F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("d2")).limit(0)

    def search(left: DataFrame, size: float, last: bool) -> DataFrame:
        near = _blocks(left, size, "ix", "iy", True).join(_blocks(index, size, "sx", "sy"), ["bx", "by"])
        dx, dy = (F.col("sx") - F.col("ix")).cast("long"), (F.col("sy") - F.col("iy")).cast("long")
        best = near.groupBy(*KEY).agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "sx", "sy", "value")).alias("b"))
        return best.select(*KEY, F.col("b.value").alias("value"), F.col("b.d2").alias("d2")).where((F.sqrt("d2") <= size) | F.lit(last))

    return rounds(wanted.select(*KEY), KEY, float(reach), whole, search, [*KEY, "value", "d2"])


def align(cells: DataFrame, reference: DataFrame, cell_m: float, reference_m: float, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """cells (ix, iy, value) of cell_m resampled to the grid of reference (ix, iy) of reference_m, bilinearly at its cells' centres; both in
    one reference system. dx, dy: where the reference's origin lies in that of cells. NULL where a corner has no value. Equal
    grids are left as they are."""
    if cell_m == reference_m and not dx and not dy:
        return reference.select(*KEY).join(cells.select(*KEY, "value"), KEY, "left")
    at = reference.select(*KEY, ((F.col("ix") + 0.5) * reference_m + dx).alias("x"), ((F.col("iy") + 0.5) * reference_m + dy).alias("y"))
    return bilinear(at, cells, cell_m, "centre").select(*KEY, "value")


def normalize_heights(points: DataFrame, ground: DataFrame, cell_m: float) -> DataFrame:
    """points with height: z above the ground raster, not below 0; 0 for ground points and where the raster has no value."""
    got = bilinear(points, ground, cell_m, "centre")
    return got.withColumn("height", F.when(F.col("classification") == 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("z") - F.coalesce("value", "z"))))
