"""Ground classification: a thin layer of low points, a robust surface voted by neighbours, and a gate around it; then recovery of
ground in voids and removal of false ground."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyforge.functions.points import exact_percentile, with_cells
from canopyforge.functions.sensors import MEMBRANE, Sensor, adapted, scale, settings
from canopyforge.functions.storage import written

from . import kernels
from .cells import candidate_layer, density_stats
from .focal import dilate, robust_vote, smooth, spread
from .lookup import bilinear
from .regions import components
from .surface import per_tile

KEY = ["ix", "iy"]


def swept_surface(points: DataFrame, cell_m: float) -> DataFrame:
    """(ix, iy, value): the lowest of the lowest points of four grids, shifted by half a cell against each other, by base cell."""
    wide = points.select("x", "y", "z").withColumn("o", F.explode(F.array(*[F.struct(F.lit(i * 0.5).alias("x"), F.lit(j * 0.5).alias("y")) for i in (0, 1) for j in (0, 1)])))
    cell = [F.floor(F.col(c) / cell_m + F.col(f"o.{c}")).alias(f"s{c}") for c in ("x", "y")]
    low = wide.groupBy("o", *cell).agg(F.min(F.struct("z", "x", "y")).alias("p")).select("p.*")
    return with_cells(low, cell_m).groupBy(*KEY).agg(F.min("z").alias("value"))


def snapped(points: DataFrame, surface: DataFrame, cell_m: float) -> DataFrame:
    """(ix, iy, value): in each cell the z nearest to the surface's value; of one above and one below at one distance the one above."""
    p = with_cells(points, cell_m).join(surface.select(*KEY, F.col("value").alias("s")), KEY)
    apart = F.struct(F.abs(F.col("z") - F.col("s")).alias("d"), (F.col("z") < F.col("s")).alias("below"), "z")
    return p.groupBy(*KEY).agg(F.min(apart).alias("b")).select(*KEY, F.col("b.z").alias("value"))


def _filled(surface: DataFrame, rounds: int) -> DataFrame:
    """Cells that the vote left empty, from the medians of their neighbours; a round fills a ring, and a tile's halo is as wide."""
    cells = surface.select(F.col("ix").alias("col"), F.col("iy").alias("row"), "value")
    holes = surface.select(F.col("ix").alias("col"), F.col("iy").alias("row"))
    made = per_tile(cells.where("value is not null"), lambda a, c, r: {"value": kernels.fill_holes_by_median(a, rounds)}, "value double", 256, rounds)
    return made.join(holes, ["col", "row"], "left_semi").select(F.col("col").alias("ix"), F.col("row").alias("iy"), "value")


def lowest_surface(points: DataFrame, cell_m: float) -> DataFrame:
    """(ix, iy, value): the lowest z of each cell, with which terrestrial scans start."""
    return with_cells(points, cell_m).groupBy(*KEY).agg(F.min("z").alias("value"))


def ground_surface(candidates: DataFrame, s: Sensor, sweep: bool = True) -> DataFrame:
    """(ix, iy, value) of the voted ground surface at s.vote_cell_m; sweep: from four shifted grids, not from one."""
    first = swept_surface(candidates, s.vote_cell_m) if sweep else lowest_surface(candidates, s.vote_cell_m)
    return _voted(written(first, "first-surface"), s)


def _voted(first: DataFrame, s: Sensor) -> DataFrame:
    voted = robust_vote(first, s.vote_radius, s.vote_most_z, s.vote_least_cells, s.mad_floor).select(*KEY, "value")
    return smooth(_filled(voted, s.fill_rounds), s.smooth_sigma)


def membrane_seeds(points: DataFrame, cell_m: float) -> DataFrame:
    """(ix, iy, value): the lower quartile of the ground points' z in each cell."""
    return with_cells(points.where("classification = 2"), cell_m).groupBy(*KEY).agg(F.percentile("z", 0.25).alias("value"))


def refine_by_membrane(points: DataFrame, res: float, demote_from: float = 0.06, least_ground: int = 20) -> DataFrame:
    """points (x, y, z, classification) judged by a membrane through their ground: a surface voted from cells' lower quartiles. What the
    gate around it holds becomes ground; ground above the gate and more than max(0.08, demote_from) above the membrane does not stay.
    Clouds of fewer than least_ground ground points are left as they are."""
    if points.where("classification = 2").limit(least_ground).count() < least_ground:
        return points
    s = replace(MEMBRANE, vote_cell_m=max(MEMBRANE.vote_cell_m, res), ground_threshold_m=max(0.10, demote_from))
    surface = written(_voted(written(membrane_seeds(points, s.vote_cell_m), "membrane-seeds"), s), "membrane")
    got = _above(points, surface, s)
    left = F.col("z") - F.col("surface")
    held = _gated(left, F.col("steep"), s) == 2
    new = F.when(held, 2).when((F.col("classification") == 2) & (left > max(0.08, demote_from)), 1).otherwise(F.col("classification"))
    return got.withColumn("classification", new.cast("int")).drop("surface", "steep")


def steepness(surface: DataFrame, cell_m: float) -> DataFrame:
    """(ix, iy, value): the magnitude of the surface's gradient."""
    from .terrain import gradients

    g = gradients(surface.select(F.col("ix").alias("col"), F.col("iy").alias("row"), F.col("value").alias("z")), cell_m)
    return g.select(F.col("col").alias("ix"), F.col("row").alias("iy"), F.hypot("gx", "gy").alias("value"))


def _above(points: DataFrame, surface: DataFrame, s: Sensor) -> DataFrame:
    """points with the surface and its steepness below them, both in one join."""
    both = surface.select(*KEY, F.col("value").alias("surface")).join(steepness(surface, s.vote_cell_m).withColumnRenamed("value", "steep"), KEY, "full")
    return bilinear(points, both, s.vote_cell_m, "corner", ("surface", "steep"))


def gate(points: DataFrame, surface: DataFrame, s: Sensor) -> DataFrame:
    """points with classification 2 where they lie between twice the threshold below the surface and the threshold above; the threshold grows with
    steepness. Elsewhere, and where the surface is unknown, 1."""
    return _above(points, surface, s).withColumn("classification", _gated(F.col("z") - F.col("surface"), F.col("steep"), s)).drop("surface", "steep")


def _gated(residual: Column, steep: Column, s: Sensor) -> Column:
    most = F.greatest(F.lit(s.gate[0]), F.least(F.lit(s.gate[1]), s.ground_threshold_m + s.slope_k * F.coalesce(steep, F.lit(0.0))))
    return F.when((residual <= most) & (residual >= -2 * most), 2).otherwise(1).cast("int")


def classify(points: DataFrame, sensor: str = "ALS", s: Sensor | None = None, least_points: int = 1000, least_ground: int = 500) -> DataFrame:
    """points (x, y, z) with classification 1 or 2; repeated points stay.

    Clouds of under least_points are all 1. If fewer than least_ground are found, those up to the twentieth of z are ground.
    """
    s = s or settings(sensor)
    if points.limit(least_points).count() < least_points:
        return points.withColumn("classification", F.lit(1))
    low = points if sensor == "TLS" else candidate_layer(points, s.cand_cell_m, s.cand_dz_m)
    surface = written(ground_surface(low.select("x", "y", "z"), s, sensor != "TLS"), "ground-surface")
    out = written(gate(points.drop("classification"), surface, s), "classified")
    if out.where("classification = 2").limit(least_ground).count() < least_ground:
        return out.withColumn("classification", F.when(F.col("z") <= exact_percentile(out, "z", 0.05), 2).otherwise(1))
    return recover_in_voids(out, surface, s) if s.recover_voids else out


def adapted_settings(points: DataFrame, sensor: str, cell_m: float | None = None) -> Sensor:
    """The sensor's settings scaled by how dense the cloud is: points in an occupied cell, points a square metre."""
    s = settings(sensor)
    cell_m = cell_m or s.vote_cell_m
    stats = density_stats(points, cell_m).select("n_median", (F.col("n_mean") * F.col("occupied") / (F.col("cells") * cell_m * cell_m)).alias("density"), "occupancy")
    none = F.lit(None).cast("double")
    found = stats.select(scale(sensor, F.col("n_median"), F.col("density"), none, none, none, none).alias("k")).first()
    return adapted(sensor, found.k if found and found.k else 1.0)


def recover_in_voids(points: DataFrame, surface: DataFrame, s: Sensor, cell_m: float = 2.0, buffer_m: float = 0.5, sizes: tuple[int, int] = (2, 500), least_bank: int = 6, tolerance: float = 0.18, above: float = 0.04, near: float = 0.05) -> DataFrame:
    """points with ground promoted in voids: connected cells with candidates but no ground, of two to some hundred cells.

    The ground cells around a void are its bank, to which a plane is fitted. Cells that are vertically compact take a target, the median of
    the bank's median and lower tenth, the plane and the surface; points within `near` of the lowest candidate that agrees become ground.
    """
    p = with_cells(points, cell_m)
    grid = written(p.groupBy(*KEY).agg(F.count_if(F.col("classification") == 2).alias("n_ground"), F.min(F.when(F.col("classification") == 2, F.col("z"))).alias("ground_z"), F.stddev_pop("z").alias("sd"), (F.max("z") - F.min("z")).alias("span"), F.count_distinct(F.floor(F.col("z") / 0.2)).alias("bins"), F.min("z").alias("low")), "void-cells")
    void = grid.where("n_ground = 0").select(*KEY)
    named = written(components(void, True), "voids")
    named = named.join(named.groupBy("label").count().where(F.col("count").between(*sizes)).select("label"), "label")
    r = max(1, int(np.ceil(buffer_m / cell_m)))
    bank = spread(named, r).select(*KEY, "label").distinct().join(grid.where("n_ground > 0").select(*KEY, F.col("ground_z").alias("z")), KEY)
    bx, by = (F.col("ix") + 0.5) * cell_m, (F.col("iy") + 0.5) * cell_m
    fit = bank.select("label", bx.alias("bx"), by.alias("by"), "z").groupBy("label").agg(
        F.count("*").alias("n"), F.median("z").alias("mid"), F.percentile("z", 0.1).alias("p10"), F.avg("bx").alias("mx"), F.avg("by").alias("my"), F.avg("z").alias("mz"),
        F.covar_pop("bx", "z").alias("xz"), F.covar_pop("by", "z").alias("yz"), F.covar_pop("bx", "by").alias("xy"), F.var_pop("bx").alias("xx"), F.var_pop("by").alias("yy"),
    ).where(F.col("n") >= least_bank)
    det = F.nullif(F.round(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), 9), F.lit(0.0))
    fit = fit.withColumns({"a": (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, "b": (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det})
    plane = F.col("mz") + F.coalesce("a", F.lit(0.0)) * (bx - F.col("mx")) + F.coalesce("b", F.lit(0.0)) * (by - F.col("my"))
    scale = cell_m / s.vote_cell_m
    at = surface.select(F.floor(F.col("ix") / scale).cast("int").alias("ix"), F.floor(F.col("iy") / scale).cast("int").alias("iy"), "value").groupBy(*KEY).agg(F.avg("value").alias("surface"))
    cells = named.join(fit, "label").join(grid, KEY).join(at, KEY, "left").withColumn("plane", plane)
    cells = cells.where((F.col("bins") <= 2) & (F.col("sd") <= 0.12) & (F.col("span") <= 0.35))
    cells = cells.withColumn("target", F.element_at(F.array_sort(F.array_compact(F.array("mid", "p10", "plane", "surface"))), 2))
    fits = (F.col("low") - F.col("target")).between(-tolerance, above) & (F.abs(F.col("low") - F.col("plane")) <= tolerance)
    best = cells.where(fits).select(*KEY, F.col("low").alias("best"))
    got = p.join(best, KEY, "left").withColumn("classification", F.when(F.abs(F.col("z") - F.col("best")) <= near, 2).otherwise(F.col("classification")).cast("int"))
    return got.drop("best", *KEY)


def _ring_median(cells: DataFrame, value: str, name: str) -> DataFrame:
    """cells with the median of a column over their eight neighbours."""
    near = spread(cells.select(*KEY, F.col(value).alias("v")), 1, centre=False).groupBy(*KEY).agg(F.median("v").alias(name))
    return cells.join(near, KEY, "left")


def demote_high_cells(points: DataFrame, cell_m: float) -> DataFrame:
    """Ground points of cells with at most two of them that lie a jump above the median of the cells around become non-ground."""
    jump = 1.0 if cell_m >= 0.75 else 0.5
    low = with_cells(points.where("classification = 2"), cell_m).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("z").alias("low"))
    bad = _ring_median(low, "low", "around").where((F.col("n") <= 2) & (F.col("low") - F.col("around") > jump)).select(*KEY, F.lit(True).alias("bad"))
    got = with_cells(points, cell_m).join(bad, KEY, "left")
    return got.withColumn("classification", F.when(F.col("bad") & (F.col("classification") == 2), 1).otherwise(F.col("classification")).cast("int")).drop("bad", *KEY)


def demote_coarse(points: DataFrame, cell_m: float = 4.0, least: int = 8, range_m: float = 1.2, mad_m: float = 0.18, rise_m: float = 0.6, k: float = 3.0, score: float = 3.5, offset: float = 0.18, share: float = 0.45) -> DataFrame:
    """Ground points far above their coarse cell's median become non-ground, in cells whose range, spread and height stick out of the
    eight around; cells that would lose more than share of their points keep all."""
    g = with_cells(points, cell_m)
    own = g.where("classification = 2")
    mid = own.groupBy(*KEY).agg(F.count("*").alias("n"), F.median("z").alias("mid"), (F.max("z") - F.min("z")).alias("range"))
    mad = own.join(mid.select(*KEY, "mid"), KEY).groupBy(*KEY).agg(F.median(F.abs(F.col("z") - F.col("mid"))).alias("mad"))
    cells = written(mid.join(mad, KEY).where(F.col("n") >= least), "coarse-cells")
    around = spread(cells.select(*KEY, "mid", "range", "mad"), 1, centre=False).groupBy(*KEY).agg(F.median("mid").alias("mid_a"), F.median("range").alias("range_a"), F.median("mad").alias("mad_a"))
    spread_of = F.col("mad_a") * 1.4826 * k
    bad = cells.join(around, KEY).where((F.col("range") > F.greatest(F.lit(range_m), F.col("range_a") + spread_of)) & (F.col("mad") > F.greatest(F.lit(mad_m), F.col("mad_a"))) & (F.col("mid") - F.col("mid_a") > rise_m))
    flagged = own.join(bad.select(*KEY, "mid", "mad", "n"), KEY).withColumn("out", (0.6745 * (F.col("z") - F.col("mid")) / (F.col("mad") + 1e-12) > score) & (F.col("z") > F.col("mid") + offset))
    few = flagged.groupBy(*KEY).agg(F.count_if("out").alias("gone"), F.max("n").alias("n"), F.max("mid").alias("mid"), F.max("mad").alias("mad")).where(F.col("gone") <= share * F.col("n")).select(*KEY, "mid", "mad")
    got = g.join(few, KEY, "left")
    out = (0.6745 * (F.col("z") - F.col("mid")) / (F.col("mad") + 1e-12) > score) & (F.col("z") > F.col("mid") + offset) & (F.col("classification") == 2)
    return got.withColumn("classification", F.when(out, 1).otherwise(F.col("classification")).cast("int")).drop("mid", "mad", *KEY)


def demote_weak(points: DataFrame, cell_m: float = 10.0, count: int = 10, share: float = 0.35, range_m: float = 1.0, k: float = 2.5, ring: int = 20, above: float = 0.25) -> DataFrame:
    """In connected coarse cells with few ground points and a high range, ground more than `above` over the median of well-supported
    cells around becomes non-ground."""
    g = with_cells(points, cell_m)
    cells = written(g.where("classification = 2").groupBy(*KEY).agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("range"), F.median("z").alias("mid")), "weak-cells")
    n_mid, r_mid = exact_percentile(cells, "n", 0.5), exact_percentile(cells, "range", 0.5)
    if n_mid is None:
        return points
    mad = exact_percentile(cells, F.abs(F.col("range") - r_mid), 0.5)
    weak = cells.where(((F.col("n") <= count) | (F.col("n") <= share * n_mid)) & (F.col("range") > max(range_m, r_mid + k * 1.4826 * mad)))
    named = written(components(weak.select(*KEY), True), "weak-regions")
    rim = spread(named, 1).select(*KEY, "label").distinct().join(named.select(*KEY), KEY, "left_anti").join(cells.where(F.col("n") >= ring), KEY)
    level = rim.groupBy("label").agg(F.count("*").alias("n"), F.median("mid").alias("level")).where("n >= 3")
    bad = named.join(level.select("label", "level"), "label").select(*KEY, "level")
    got = g.join(bad, KEY, "left")
    return got.withColumn("classification", F.when((F.col("z") > F.col("level") + above) & (F.col("classification") == 2), 1).otherwise(F.col("classification")).cast("int")).drop("level", *KEY)


def fix_false_ground(points: DataFrame, res: float = 0.25, promote_to: float = 0.0, demote_from: float = 0.06, membrane: bool = True) -> DataFrame:
    """The passes that follow classification: coarse cells, weakly supported regions, then each point's height over the raster of
    the nearest ground: non-ground up to promote_to becomes ground, ground above demote_from doesn't stay; and the membrane through
    what is ground then."""
    p = written(demote_weak(demote_coarse(points)), "fix-points")
    cells = with_cells(p.where("classification = 2"), res).groupBy(*KEY).agg(F.min("z").alias("value"))
    got = bilinear(p, cells, res, "centre")
    left = F.col("z") - F.col("value")
    new = F.when((F.col("classification") != 2) & (left <= promote_to), 2).when((F.col("classification") == 2) & (left > demote_from), 1).otherwise(F.col("classification"))
    out = got.withColumn("classification", new.cast("int")).drop("value")
    return refine_by_membrane(written(out, "core-points"), res, demote_from) if membrane else out


def grown_mask(points: DataFrame, cell_m: float, times: int = 1) -> DataFrame:
    """(ix, iy) of the cells that hold points, grown."""
    return dilate(with_cells(points, cell_m).select(*KEY), times)
