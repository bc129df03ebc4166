"""Map algebra and hydrology of elevation rasters (col, row, z), rows counted southward."""

from __future__ import annotations

from math import cos, hypot, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyforge.functions.points import exact_percentile

KEY = ["col", "row"]
#: Order in which equal slopes are taken: NW, N, NE, W, E, SW, S, SE.
NEIGHBOURS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def _along(df: DataFrame, axis: str, other: str, value: str, step: float) -> Column:
    """Derivative along an axis: central, one-sided at the ends of a run of cells; 0 for a lone cell."""
    w = Window.partitionBy(other).orderBy(axis)
    before = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(value).over(w))
    after = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(value).over(w))
    return F.coalesce((after - before) / (2 * step), (after - F.col(value)) / step, (F.col(value) - before) / step, F.lit(0.0))


def gradients(dem: DataFrame, res: float, value: str = "z", names: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """dem with the derivatives along columns and along rows (southward)."""
    return dem.withColumn(names[0], _along(dem, "col", "row", value, res)).withColumn(names[1], _along(dem, "row", "col", value, res))


def slope_aspect_shade(dem: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """slope in percent and degrees, aspect in degrees from north (NULL where flat), hillshade 0..255."""
    g = gradients(dem, res)
    steep = F.hypot("gx", "gy")
    aspect = F.when(steep >= 1e-8, F.pmod(90.0 - F.degrees(F.atan2("gy", -F.col("gx"))) + 720.0, F.lit(360.0)))
    az, alt = radians(360.0 - azimuth + 90.0), radians(altitude)
    lean = F.atan(F.hypot(F.col("gx") * z_factor, F.col("gy") * z_factor))
    face = F.atan2(F.col("gy"), -F.col("gx"))
    shade = sin(alt) * F.cos(lean) + cos(alt) * F.sin(lean) * F.cos(az - face)
    return g.select(*KEY, (100.0 * steep).alias("slope_pct"), F.degrees(F.atan(steep)).alias("slope_deg"), aspect.alias("aspect"), (255.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))).alias("hillshade"))


def curvature(dem: DataFrame, res: float) -> DataFrame:
    """Sum of the second derivatives."""
    g = gradients(dem, res)
    twice = g.withColumn("gxx", _along(g, "col", "row", "gx", res)).withColumn("gyy", _along(g, "row", "col", "gy", res))
    return twice.select(*KEY, (F.col("gxx") + F.col("gyy")).alias("curvature"))


def tpi(dem: DataFrame, radius: int) -> DataFrame:
    """Height above the mean of the square window, the cell itself included."""
    from .focal import running

    cells = dem.select(F.col("col").alias("ix"), F.col("row").alias("iy"), F.col("z").alias("value"))
    total, n = (running(cells, radius, what).select("ix", "iy", "value", F.col("focal").alias(what)) for what in ("sum", "count"))
    both = total.join(n.drop("value"), ["ix", "iy"])
    return both.select(F.col("ix").alias("col"), F.col("iy").alias("row"), (F.col("value") - F.col("sum") / F.col("count")).alias("tpi"))


def tci(dem: DataFrame, res: float) -> DataFrame:
    """Minus the divergence of the unit vector downslope; NULL where flat."""
    g = gradients(dem, res).withColumn("s", F.hypot("gx", "gy"))
    unit = g.withColumns({"ux": F.when(F.col("s") > 1e-12, -F.col("gx") / F.col("s")).otherwise(0.0), "uy": F.when(F.col("s") > 1e-12, -F.col("gy") / F.col("s")).otherwise(0.0)})
    div = unit.withColumn("a", _along(unit, "col", "row", "ux", res)).withColumn("b", _along(unit, "row", "col", "uy", res))
    return div.select(*KEY, F.when(F.col("s") > 1e-12, -(F.col("a") + F.col("b"))).alias("tci"))


def d8_receivers(dem: DataFrame, res: float) -> DataFrame:
    """(col, row, z, to_col, to_row): the neighbour with the greatest positive slope downward, NULL for pits; by an exploded
    equi-join, so that a raster of any size is one shuffle."""
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(hypot(dx, dy) * res).alias("d")) for k, (dx, dy) in enumerate(NEIGHBOURS)])
    out = dem.select(*KEY, "z", F.explode(moves).alias("m")).select(*KEY, "z", "m.*", (F.col("col") + F.col("m.dx")).alias("c2"), (F.col("row") + F.col("m.dy")).alias("r2"))
    near = dem.select(F.col("col").alias("c2"), F.col("row").alias("r2"), F.col("z").alias("z2"))
    pairs = out.join(near, ["c2", "r2"]).withColumn("slope", (F.col("z") - F.col("z2")) / F.col("d")).where("slope > 0")
    best = pairs.groupBy(*KEY).agg(F.max(F.struct("slope", -F.col("k"), "c2", "r2")).alias("b"))
    return dem.select(*KEY, "z").join(best, KEY, "left").select(*KEY, "z", F.col("b.c2").alias("to_col"), F.col("b.r2").alias("to_row"))


def flow_accumulation(receivers: DataFrame, tile: int = 512, rounds: int = 10_000) -> DataFrame:
    """(col, row, acc): the cells that drain through each, itself included, over a raster of any extent.

    Each tile is solved in one pass over its cells from high to low; what leaves a tile enters the next at a border cell. The inflow
    of border cells is found by rounds over those few cells alone: a tile's answer to inflow is linear, so that only
    (entry, exit) links go round. Ends when no inflow changes.
    """
    import numpy as np
    import pyarrow as pa

    spark = receivers.sparkSession
    cells = receivers.withColumns({"tx": F.floor(F.col("col") / tile).cast("int"), "ty": F.floor(F.col("row") / tile).cast("int")})

    def table(t: pa.Table):
        col, row, z = (t.column(n).to_numpy() for n in ("col", "row", "z"))
        to_c, to_r = (t.column(n).to_pylist() for n in ("to_col", "to_row"))
        at = {(c, r): i for i, (c, r) in enumerate(zip(col.tolist(), row.tolist(), strict=True))}
        to = np.array([-1 if c is None else at.get((c, r), -2) for c, r in zip(to_c, to_r, strict=True)], np.int64)
        return col, row, np.lexsort((row, col, -z)), to, to_c, to_r

    def exits(t: pa.Table) -> pa.Table:
        """For each cell that drains out of the tile: where to, and how many cells of the tile it has; for each cell whether and where it leaves."""
        col, row, order, to, to_c, to_r = table(t)
        acc, leaves = np.ones(len(col), np.int64), np.full(len(col), -1, np.int64)
        for i in order.tolist():
            if to[i] >= 0:
                acc[to[i]] += acc[i]
        for i in order[::-1].tolist():
            leaves[i] = i if to[i] == -2 else leaves[to[i]] if to[i] >= 0 else -1
        out = [i for i in range(len(col)) if leaves[i] >= 0]
        return pa.table({"col": col[out], "row": row[out], "own": pa.array([int(acc[i]) if to[i] == -2 else 0 for i in out], pa.int64()), "to_col": pa.array([to_c[leaves[i]] for i in out], pa.int32()), "to_row": pa.array([to_r[leaves[i]] for i in out], pa.int32())})

    from canopyforge.functions.storage import written

    grouped = cells.groupBy("tx", "ty")
    out = written(grouped.applyInArrow(exits, "col int, row int, own long, to_col int, to_row int"), "flow-exits")
    # inflow of an entry cell = cells of the tiles before it that leave into it, over all rounds of travel
    wave = out.where("own > 0").groupBy("to_col", "to_row").agg(F.sum("own").alias("n"))
    total = None
    for _ in range(rounds):
        wave = written(wave, "flow-wave")
        if wave.isEmpty():
            break
        total = wave if total is None else total.unionByName(wave)
        links = out.select("col", "row", F.col("to_col").alias("c2"), F.col("to_row").alias("r2"))
        wave = wave.join(links, (F.col("to_col") == F.col("col")) & (F.col("to_row") == F.col("row"))).groupBy(F.col("c2").alias("to_col"), F.col("r2").alias("to_row")).agg(F.sum("n").alias("n"))
    inflow = (total if total is not None else spark.createDataFrame([], "to_col int, to_row int, n long")).groupBy("to_col", "to_row").agg(F.sum("n").alias("inflow"))
    fed = cells.join(inflow.select(F.col("to_col").alias("col"), F.col("to_row").alias("row"), "inflow"), KEY, "left")

    def accumulate(t: pa.Table) -> pa.Table:
        col, row, order, to, _, _ = table(t)
        acc = 1 + np.array([x or 0 for x in t.column("inflow").to_pylist()], np.int64)
        for i in order.tolist():
            if to[i] >= 0:
                acc[to[i]] += acc[i]
        return pa.table({"col": col, "row": row, "acc": acc})

    return fed.groupBy("tx", "ty").applyInArrow(accumulate, "col int, row int, acc long")


def twi(dem: DataFrame, res: float, eps: float = 1e-6) -> DataFrame:
    """ln((cells drained * cell size + eps) / max(tan(max(slope, 0.001 degrees)), eps))."""
    acc = flow_accumulation(d8_receivers(dem, res))
    slope = slope_aspect_shade(dem, res).select(*KEY, "slope_deg")
    return acc.join(slope, KEY).select(*KEY, "acc", F.ln((F.col("acc") * res + eps) / F.greatest(F.tan(F.radians(F.greatest("slope_deg", F.lit(0.001)))), F.lit(eps))).alias("twi"))


def channels(acc: DataFrame, res: float) -> DataFrame:
    """(col, row) of cells whose specific catchment area reaches max(50, 1000 / cell area) cell widths; if none does, of the
    hundredth with the greatest."""
    sca = acc.withColumn("sca", F.col("acc") * res)
    most = max(50.0, 1000.0 / (res * res)) * res
    high = sca.where(F.col("sca") >= most)
    if high.isEmpty():
        top = exact_percentile(sca, "sca", 0.99)
        high = sca.where(F.col("sca") >= top) if top is not None else high
    return high.select(*KEY)


def depth_to_water(dem: DataFrame, res: float, farthest: float | None = None) -> DataFrame:
    """z above the nearest channel cell's, not below 0; NULL beyond farthest."""
    from .lookup import nearest_cell

    wet = channels(flow_accumulation(d8_receivers(dem, res)), res)
    water = dem.join(wet, KEY, "left_semi").select(F.col("col").alias("ix"), F.col("row").alias("iy"), F.col("z").alias("value"))
    got = nearest_cell(dem.select(F.col("col").alias("ix"), F.col("row").alias("iy")), water).select(F.col("ix").alias("col"), F.col("iy").alias("row"), "value", "d2")
    depth = F.greatest(F.lit(0.0), F.col("z") - F.col("value"))
    return dem.join(got, KEY).select(*KEY, (depth if farthest is None else F.when(F.sqrt("d2") * res <= farthest, depth)).alias("dtw"))


