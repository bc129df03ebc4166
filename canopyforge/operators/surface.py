"""Rasters by tile: interpolated surfaces, canopy height models, filters that need a whole window's values.

`per_tile` gives a kernel one tile with its halo as arrays and keeps what it makes for the tile's core, so that tiles don't
depend on each other and their union has each cell once. With a halo of at least a kernel's reach the result is that of an untiled run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyforge.functions.storage import written

from . import kernels

KEY = ["col", "row"]

#: Points that a tile is triangulated from at most, if it has more cells than LEAST_TILE a side.
MOST_POINTS, LEAST_TILE = 100_000, 4


def _halo(v: str, tile: int, halo: int) -> Column:
    return F.explode(F.sequence(F.floor((F.col(v) - halo) / tile).cast("int"), F.floor((F.col(v) + halo) / tile).cast("int")))


def per_tile(cells: DataFrame, kernel: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], schema: str, tile: int = 256, halo: int = 16) -> DataFrame:
    """cells (col, row, value) to (col, row, and the arrays that kernel(values, first col, first row) returns by name); values are
    NaN where a cell is absent. Cells for which all results are NaN (or 0 in whole-number ones) are left out."""
    rows = cells.select(*KEY, F.col("value").cast("double")).withColumn("tx", _halo("col", tile, halo)).withColumn("ty", _halo("row", tile, halo))
    names = [f.split()[0] for f in schema.split(",")]

    def run(key, t):
        tx, ty = (k.as_py() for k in key)
        c0, r0 = tx * tile - halo, ty * tile - halo
        a = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        a[t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0] = t.column("value").to_numpy(zero_copy_only=False)
        core = (slice(halo, halo + tile), slice(halo, halo + tile))
        made = {n: v[core] for n, v in kernel(a, c0, r0).items()}
        there = np.any([np.isfinite(v) if v.dtype.kind == "f" else v != 0 for v in made.values()], axis=0)
        r, c = np.nonzero(there)
        out = {"col": (c + tx * tile).astype(np.int32), "row": (r + ty * tile).astype(np.int32)}
        for n in names:
            v = made[n][r, c]
            out[n] = pa.array(v, from_pandas=True) if v.dtype.kind == "f" else pa.array(v.astype(np.int32))
        return pa.table(out)

    return rows.groupBy("tx", "ty").applyInArrow(run, f"col int, row int, {schema}")


def filtered(cells: DataFrame, how: str, size: int = 3, sigma: float = 1.0, tile: int = 256) -> DataFrame:
    """cells smoothed by `median`, `gaussian`, or `dual_gaussian`; `none` leaves them."""
    if how == "none":
        return cells
    kernel = {
        "median": lambda a: kernels.median_filter(np.where(np.isfinite(a), a, 0.0), size),
        "gaussian": lambda a: kernels.gaussian(np.where(np.isfinite(a), a, 0.0), sigma),
        "dual_gaussian": kernels.dual_gaussian,
    }[how]
    halo = {"median": size // 2, "gaussian": int(4 * sigma + 0.5), "dual_gaussian": 8}[how]
    return per_tile(cells, lambda a, c, r: {"value": np.where(np.isfinite(a), kernel(a), np.nan)}, "value double", tile, max(1, halo))


def tin(points: DataFrame, res: float, ymax: float, xmin: float = 0.0, longest: float | None = None, nearest_outside: bool = True, tile: int = 64, halo: int = 8) -> DataFrame:
    """(col, row, value): z linear in the triangles of the points (x, y, z) at cell centres; outside them the nearest point's, or
    nothing. Points at one place count as the highest.

    Tiles see points within halo cells. A tile is done where the circles of the triangles on its cells, and the nearest points of cells
    outside the cloud's hull, lie within what it sees; others look again with twice the halo, until none is left or they see all points.
    Tiles that would hold more than MOST_POINTS are made smaller.
    """
    p = points.groupBy(*(F.col(c).cast("double").alias(c) for c in "xy")).agg(F.max(F.when(~F.isnan(F.col("z").cast("double")), F.col("z").cast("double"))).alias("z"))
    p = p.select(F.floor((F.col("x") - xmin) / res).cast("int").alias("col"), F.floor((F.lit(ymax) - F.col("y")) / res).cast("int").alias("row"), *"xyz")
    p = written(p, "tin-points")
    ends = p.agg(*(f(c).alias(f"{c}{i}") for c in ("col", "row", "x", "y") for i, f in enumerate((F.min, F.max)))).first()
    if ends.col0 is None:
        return p.select("col", "row", F.col("z").alias("value")).limit(0)
    while tile > LEAST_TILE and p.groupBy(F.floor(F.col("col") / tile), F.floor(F.col("row") / tile)).count().agg(F.max("count")).first()[0] > MOST_POINTS:
        tile = tile // 2
        halo = min(halo, max(1, tile // 8))
    c_min, c_max, r_min, r_max = ends.col0, ends.col1, ends.row0, ends.row1
    bounds = (ends.x0, ends.y0, ends.x1, ends.y1)
    across, down = (c_min // tile, c_max // tile), (r_min // tile, r_max // tile)

    def corners(key, t):
        at = kernels.hull(t.column("x").to_numpy(), t.column("y").to_numpy())
        return pa.table({"x": t.column("x").take(pa.array(at)), "y": t.column("y").take(pa.array(at))})

    rim = p.groupBy(F.floor(F.col("col") / tile).alias("tx"), F.floor(F.col("row") / tile).alias("ty")).applyInArrow(corners, "x double, y double").toPandas().to_numpy()
    rim = rim[kernels.hull(rim[:, 0], rim[:, 1])]

    def to_tiles(v: str, first: int, last: int, halo: int) -> Column:
        lo, hi = F.floor((F.col(v) - halo) / tile).cast("int"), F.floor((F.col(v) + halo) / tile).cast("int")
        return F.explode(F.sequence(F.greatest(lo, F.lit(first)), F.least(hi, F.lit(last))))

    def made(halo: int):
        def run(key, t):
            tx, ty = (k.as_py() for k in key)
            cols = np.arange(max(tx * tile, c_min), min((tx + 1) * tile, c_max + 1))
            rws = np.arange(max(ty * tile, r_min), min((ty + 1) * tile, r_max + 1))
            x, y, z = (t.column(n).to_numpy() for n in ("x", "y", "z"))
            order = np.lexsort((-z, y, x))
            x, y, z = x[order], y[order], z[order]
            first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            x, y, z = x[first], y[first], z[first]
            gx, gy = xmin + (cols + 0.5) * res, ymax - (rws + 0.5) * res
            c0, c1, r0, r1 = tx * tile - halo, (tx + 1) * tile + halo, ty * tile - halo, (ty + 1) * tile + halo
            whole = c0 <= c_min and c1 > c_max and r0 <= r_min and r1 > r_max
            e = 1e-9 * (1 + max(map(abs, bounds)))
            seen = (-np.inf if c0 <= c_min else xmin + c0 * res + e, -np.inf if r1 > r_max else ymax - r1 * res + e, np.inf if c1 > c_max else xmin + c1 * res - e, np.inf if r0 <= r_min else ymax - r0 * res - e)
            done = np.zeros((len(rws), len(cols)), bool)
            a = kernels.tin_raster(x, y, z, gx, gy, longest, None if whole else done, seen, bounds)
            beyond = kernels.outside_hull(rim[:, 0], rim[:, 1], gx, gy)
            if not nearest_outside:
                done |= beyond
            else:
                for r, c in np.argwhere(~np.isfinite(a)).tolist():
                    d2 = (x - gx[c]) ** 2 + (y - gy[r]) ** 2
                    i, far = np.argmin(d2), np.sqrt(d2.min())
                    a[r, c] = z[i]
                    sure = gx[c] - far >= seen[0] and gy[r] - far >= seen[1] and gx[c] + far <= seen[2] and gy[r] + far <= seen[3]
                    done[r, c] = (done[r, c] or beyond[r, c]) and sure
            if not whole and not done.all():
                return pa.table({"tx": pa.array([], pa.int32()), "ty": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "row": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
            r, c = np.nonzero(np.isfinite(a))
            n = len(r) + 1  # the row without a cell says that the tile is done
            return pa.table({"tx": np.full(n, tx, np.int32), "ty": np.full(n, ty, np.int32), "col": pa.array([*cols[c].tolist(), None], pa.int32()), "row": pa.array([*rws[r].tolist(), None], pa.int32()), "value": pa.array([*a[r, c].tolist(), None], pa.float64())})

        return run

    spark = points.sparkSession
    left = spark.range(across[0], across[1] + 1).select(F.col("id").cast("int").alias("tx")).crossJoin(spark.range(down[0], down[1] + 1).select(F.col("id").cast("int").alias("ty")))
    found = None
    while True:
        rows = p.withColumn("tx", to_tiles("col", *across, halo)).withColumn("ty", to_tiles("row", *down, halo))
        rows = rows if found is None else rows.join(left, ["tx", "ty"], "left_semi")
        got = written(rows.groupBy("tx", "ty").applyInArrow(made(halo), "tx int, ty int, col int, row int, value double"), "tin-tiles")
        found = got if found is None else found.unionByName(got)
        left = written(left.join(got.where("col is null"), ["tx", "ty"], "left_anti"), "tin-open")
        if left.isEmpty():
            return found.where("col is not null").select("col", "row", "value")
        halo = 2 * max(1, halo)


def _centres(cells: DataFrame, res: float, ymax: float, xmin: float) -> DataFrame:
    return cells.select((xmin + (F.col("col") + 0.5) * res).alias("x"), (ymax - (F.col("row") + 0.5) * res).alias("y"), F.col("value").alias("z"))


def _stat(points: DataFrame, res: float, ymax: float, xmin: float, stat: Column, height: str = "z") -> DataFrame:
    p = points.withColumns({"col": F.floor((F.col("x") - xmin) / res).cast("int"), "row": F.floor((F.lit(ymax) - F.col("y")) / res).cast("int")})
    return p.groupBy(*KEY).agg(stat.alias("value"))


def elevation_model(ground: DataFrame, res: float, ymax: float, xmin: float = 0.0, method: str = "min") -> DataFrame:
    """A gapless raster of ground points: the `min`, `max`, `mean` or `nearest` of each cell, empty cells from the triangles of
    the others' centres; `tin` of the points themselves; `idw` of the 8 nearest."""
    if method == "tin":
        return tin(ground, res, ymax, xmin)
    if method == "idw":
        from .lookup import idw

        flipped = ground.select((F.col("x") - xmin).alias("x"), (F.lit(ymax) - F.col("y")).alias("y"), "z")
        ends = flipped.agg(F.max(F.floor(F.col("x") / res)).cast("int").alias("c"), F.max(F.floor(F.col("y") / res)).cast("int").alias("r"))
        whole = ends.where("c is not null").select(F.explode(F.sequence(F.lit(0), "c")).alias("ix"), "r").select("ix", F.explode(F.sequence(F.lit(0), "r")).alias("iy"))
        return idw(flipped, whole, res).select(F.col("ix").alias("col"), F.col("iy").alias("row"), "value")
    if method == "nearest":
        dx = F.col("x") - (xmin + (F.floor((F.col("x") - xmin) / res) + 0.5) * res)
        dy = F.col("y") - (ymax - (F.floor((F.lit(ymax) - F.col("y")) / res) + 0.5) * res)
        made = _stat(ground, res, ymax, xmin, F.min(F.struct((dx * dx + dy * dy).alias("d2"), "z"))).select(*KEY, F.col("value.z").alias("value"))
    else:
        made = _stat(ground, res, ymax, xmin, {"min": F.min, "max": F.max, "mean": F.avg}[method]("z"))
    filled = tin(_centres(made, res, ymax, xmin), res, ymax, xmin).withColumnRenamed("value", "between")
    return filled.join(made, KEY, "left").select(*KEY, F.coalesce("value", "between").alias("value"))


def edge_limit(ground: DataFrame, res: float, k: int = 6) -> float:
    """The longest edge of triangles that count as covered by ground points: three times the ninth decile of the distances to the k nearest
    (in the plane, points at one place left out), at least 4 cells and 1 m; that least of clouds under three points."""
    from canopyforge.functions.points import exact_percentile

    from .outliers import place_distances, places_of

    least = max(4 * res, 1.0)
    near = place_distances(places_of(ground, "xy"), k, least, "xy")
    if (near.agg(F.sum("m")).first()[0] or 0) < 3:
        return least
    # distances are few different ones, or else a sum for each is no more than the distances themselves
    each = near.select("m", F.explode("all_d").alias("d")).where("d > 0").groupBy("d").agg(F.sum("m").alias("n"))
    far = exact_percentile(written(each, "edge-distances"), "d", 0.9, "n")
    return least if far is None else max(3 * far, least)


def ground_mask(ground: DataFrame, res: float, ymax: float, xmin: float = 0.0, longest: float | None = None) -> DataFrame:
    """(col, row) that ground points speak for: cells in triangles without edges over longest (by default edge_limit), closed and with
    what they enclose, and the points' own cells grown by one. The closing loses nothing at the raster's border."""
    from .focal import dilate
    from .regions import closed

    as_cells = [F.col("col").alias("ix"), F.col("row").alias("iy")]
    own = dilate(_stat(ground, res, ymax, xmin, F.count("*")).select(*as_cells))
    shape = tin(ground.withColumn("z", F.lit(0.0)), res, ymax, xmin, longest or edge_limit(ground, res), nearest_outside=False)
    whole = own.unionByName(closed(shape.select(*as_cells))).distinct()
    return whole.select(F.col("ix").alias("col"), F.col("iy").alias("row"))


def fill_within(cells: DataFrame, mask: DataFrame, ground: DataFrame, res: float, ymax: float, xmin: float = 0.0, k: int = 8, power: float = 2.0) -> DataFrame:
    """cells (col, row, value) in the mask; the mask's cells without a value get that of the k nearest ground points, weighted by distance."""
    from .lookup import idw

    there = cells.where("value is not null").select(*KEY, "value").join(mask.select(*KEY), KEY, "left_semi")
    flipped = ground.select((F.col("x") - xmin).alias("x"), (F.lit(ymax) - F.col("y")).alias("y"), "z")
    open_ = mask.select(*KEY).join(there, KEY, "left_anti").select(F.col("col").alias("ix"), F.col("row").alias("iy"))
    made = idw(flipped, open_, res, k, power)
    return there.unionByName(made.select(F.col("ix").alias("col"), F.col("iy").alias("row"), "value"))


def surface_model(points: DataFrame, res: float, ymax: float, xmin: float = 0.0, method: str = "max", freeze: float | None = None, above: float | None = None, grow: int = 1) -> DataFrame:
    """A raster of all points: like elevation_model, or `spikefree`: triangles of the cells' highest points without edges longer than
    freeze, held under the cell's highest plus a margin. Kept within grow cells of where points are."""
    top = _stat(points, res, ymax, xmin, F.max("z"))
    if method == "spikefree":
        freeze, above = freeze or max(4 * res, 1.0), above or max(0.25, 0.5 * res)
        made = tin(_centres(top, res, ymax, xmin), res, ymax, xmin, longest=freeze, nearest_outside=False)
        made = made.join(top.withColumnRenamed("value", "top"), KEY, "full").select(*KEY, F.least(F.coalesce("value", "top"), F.col("top") + above).alias("value"))
    else:
        made = elevation_model(points, res, ymax, xmin, method)
    from .focal import dilate

    near = dilate(top.select(F.col("col").alias("ix"), F.col("row").alias("iy")), grow).select(F.col("ix").alias("col"), F.col("iy").alias("row"))
    return made.join(near, KEY, "left_semi")


def select_heights(points: DataFrame, selector: str = "all", at: float | None = None, low: float | None = None, high: float | None = None, first_returns: bool = False, height: str = "h") -> DataFrame:
    """Points of finite heights from 0 on; `below` a height, `above` one, or in a `band` of two (swapped if reversed); on request of
    first returns only, where the cloud has returns."""
    p = points.where(F.col(height) >= 0)
    if first_returns and "return_number" in points.columns:
        p = p.where(F.col("return_number").isNull() | (F.col("return_number") == 1))
    if selector == "below":
        return p.where(F.col(height) <= at)
    if selector == "above":
        return p.where(F.col(height) >= at)
    if selector == "band":
        return p.where(F.col(height).between(min(low, high), max(low, high)))
    return p


def densify(points: DataFrame, radius: float, n: int = 8) -> DataFrame:
    """Each point, and n copies of it on a circle around it."""
    places = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in kernels.circle_offsets(radius, n)])
    wide = points.withColumn("o", F.explode(places))
    return wide.withColumns({"x": F.col("x") + F.col("o.dx"), "y": F.col("y") + F.col("o.dy")}).drop("o")


def canopy_model(
    points: DataFrame, res: float, ymax: float, xmin: float = 0.0, method: str = "p2r", height: str = "h", percentile: float = 0.99, thresholds: tuple[float, ...] = (0, 2, 5, 10, 15), longest: float | None = None,
    least_height: float = 0.0, pit_threshold: float | None = None, smooth: str = "none", ground_below: float = 0.0,
) -> DataFrame:
    """(col, row, value) of heights: `p2r` greatest, `p99` a percentile of each cell, `tin`, `pitfree` (the greatest of triangulations
    of points above each threshold, with edges up to longest), `cloth`. Cells of low points only are 0; values under least_height
    become 0; pits are then fixed and the result smoothed on request."""
    p = points.withColumn("z", F.col(height))
    top = _stat(p, res, ymax, xmin, F.max("z"))
    if method == "p2r":
        made = top
    elif method == "p99":
        made = _stat(p, res, ymax, xmin, F.percentile("z", percentile))
    elif method == "tin":
        made = tin(p, res, ymax, xmin)
    elif method == "pitfree":
        longest = longest or max(4 * res, 1.0)
        made = None
        for t in sorted({0.0, *map(float, thresholds)}):
            layer = tin(_centres(_stat(p.where(F.col("z") >= t), res, ymax, xmin, F.max("z")), res, ymax, xmin), res, ymax, xmin, longest=None if t == 0 else longest, nearest_outside=False)
            made = layer if made is None else made.unionByName(layer)
        made = made.unionByName(top).groupBy(*KEY).agg(F.max("value").alias("value"))
    elif method == "cloth":
        made = per_tile(top, lambda a, c, r: {"value": kernels.cloth(a, np.isfinite(a))}, "value double", 128, 24)
    else:
        raise ValueError(f"unknown method {method!r}")
    made = made.join(top.select(*KEY, F.col("value").alias("top")), KEY, "left")
    made = made.select(*KEY, F.when(F.col("top") <= ground_below, 0.0).when(F.col("value") < least_height, 0.0).otherwise(F.col("value")).alias("value"))
    if pit_threshold is not None:
        made = per_tile(made, lambda a, c, r: {"value": np.where(np.isfinite(a), kernels.fix_pits(a, np.isfinite(a), pit_threshold), np.nan)}, "value double", 256, 2)
    return filtered(made, smooth)


def resample(cells: DataFrame, ratio: int, how: str = "average") -> DataFrame:
    """cells at a whole multiple of their size: the average, nearest (the upper left of the middle), min or max."""
    to = [F.floor(F.col(k) / ratio).cast("int").alias(k) for k in KEY]
    if how == "nearest":
        mid = ratio // 2
        return cells.where((F.pmod("col", F.lit(ratio)) == mid) & (F.pmod("row", F.lit(ratio)) == mid)).select(*to, "value")
    return cells.groupBy(*to).agg({"average": F.avg, "min": F.min, "max": F.max}[how]("value").alias("value"))


def clip(cells: DataFrame, ring: list[tuple[float, float]], res: float, ymax: float, xmin: float = 0.0) -> DataFrame:
    """cells whose centres lie in a polygon."""
    from .crowns import inside

    shape = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    return cells.where(inside(shape, xmin + (F.col("col") + 0.5) * res, F.lit(ymax) - (F.col("row") + 0.5) * res))
