"""Whole folders of rasters at once: small voids filled, other resolutions, cut to polygons; and the command line for it.

    python -m canopyforge.plans.post IN OUT fill|resample|clip

Rasters are the rows of gtiff.read; all files of a folder are one plan.
"""

from __future__ import annotations

import argparse
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyforge.functions.names import stem
from canopyforge.functions.points import numbered
from canopyforge.functions.storage import written
from canopyforge.operators import crowns, regions
from canopyforge.sources import gtiff, vectors

PLACE = list(gtiff.PLACE)


def fill(rasters: DataFrame, how: str = "hybrid", most: int = 25, radius: int = 2, least: int = 3, diagonal: bool = True, exclude_edge: bool = True, keep_negative: bool = True) -> DataFrame:
    """rasters with their small holes filled as by regions.fill_small_voids; keep_negative=False: values under 0 become 0.

    All rasters are laid on one plane with gaps wider than any fill reaches, so that one run fills all and none sees another.
    """
    files = written(rasters.groupBy("path").agg(*(F.first(c).alias(c) for c in PLACE)), "raster-files")
    ends = files.agg(F.count("*").alias("n"), F.max("width").alias("w"), F.max("height").alias("h")).first()
    if not ends.n:
        return rasters
    side, gap = math.ceil(math.sqrt(ends.n)), max(most, radius) + 1
    at = numbered(files, "path", "k").withColumn("x0", ((F.col("k") - 1) % side) * (ends.w + gap)).withColumn("y0", (F.floor((F.col("k") - 1) / side) * (ends.h + gap)).cast("int"))
    at = written(at.withColumn("x1", F.col("x0") + F.col("width") - 1).withColumn("y1", F.col("y0") + F.col("height") - 1).drop("k"), "raster-places")
    plane = rasters.select("path", "col", "row", "value").join(at.select("path", "x0", "y0"), "path")
    cells = written(plane.select((F.col("col") + F.col("x0")).alias("ix"), (F.col("row") + F.col("y0")).alias("iy"), "value"), "raster-plane")
    filled = regions.fill_small_voids(cells, how, most, radius, least, diagonal=diagonal, exclude_edge=exclude_edge, frames=at.select("x0", "x1", "y0", "y1"))
    spot = {"gx": F.floor(F.col("ix") / (ends.w + gap)), "gy": F.floor(F.col("iy") / (ends.h + gap))}
    home = at.select("path", *PLACE, "x0", "y0", F.floor(F.col("x0") / (ends.w + gap)).alias("gx"), F.floor(F.col("y0") / (ends.h + gap)).alias("gy"))
    value = F.col("value") if keep_negative else F.greatest("value", F.lit(0.0))
    got = filled.withColumns(spot).join(home, ["gx", "gy"])
    return got.select("path", (F.col("ix") - F.col("x0")).alias("col"), (F.col("iy") - F.col("y0")).alias("row"), value.alias("value"), *PLACE)


def _pieces(v: str, ratio: Column) -> Column:
    """The new cells that the old cell v meets, and how much of each, in new cells."""
    lo, hi = F.col(v) / ratio, (F.col(v) + 1) / ratio
    first, last = F.floor(lo).cast("int"), F.greatest(F.floor(lo), F.ceil(hi) - 1).cast("int")
    return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("at"), (F.least(i + 1, hi) - F.greatest(i, lo)).alias("part")))


def resample(rasters: DataFrame, resolutions: list[float], how: str = "average") -> DataFrame:
    """rasters at each of the resolutions, with it as `resolution`: the average by area of the cells that have a value, or the nearest to
    the new cell's centre. Sizes are rounded to whole cells, so cells need not be exact squares; any ratio will do, larger or smaller."""
    wanted = rasters.withColumn("resolution", F.explode(F.array(*map(F.lit, map(float, resolutions)))))
    size = {f"new_{n}": F.greatest(F.lit(1), F.rint(F.col(n) * F.col("res") / F.col("resolution")).cast("int")) for n in ("width", "height")}
    wanted = wanted.withColumns(size)
    across, down = F.col("width") / F.col("new_width"), F.col("height") / F.col("new_height")
    place = [F.col("xmin"), F.col("ymax"), (F.col("res") * across).alias("res"), (F.col("res_y") * down).alias("res_y"), F.col("new_width").alias("width"), F.col("new_height").alias("height")]
    if how == "nearest":
        # the new cells whose centres, in old cells (i + 0.5) * ratio, fall into this one
        def centres(v: str, ratio: Column) -> Column:
            near = F.sequence(F.floor(F.col(v) / ratio - 0.5).cast("int"), F.ceil((F.col(v) + 1) / ratio - 0.5).cast("int"))
            return F.filter(near, lambda i: F.floor((i + F.lit(0.5)) * ratio) == F.col(v))

        got = wanted.withColumn("c", F.explode(centres("col", across))).withColumn("r", F.explode(centres("row", down)))
        return got.select("path", "resolution", F.col("c").alias("col"), F.col("r").alias("row"), "value", *place)
    if how != "average":
        raise ValueError(f"unknown method {how!r}")
    got = wanted.withColumn("c", F.explode(_pieces("col", across))).withColumn("r", F.explode(_pieces("row", down)))
    part = F.col("c.part") * F.col("r.part")
    keys = ["path", "resolution", F.col("c.at").alias("col"), F.col("r.at").alias("row"), *place]
    got = got.where(part > 0).groupBy(*keys).agg((F.sum(F.col("value") * part) / F.sum(part)).alias("value"))
    return got.select("path", "resolution", "col", "row", "value", *PLACE)


def clip(rasters: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """rasters' cells whose centres lie in one of the polygons (as of vectors.read_polygons), cut to the cells that are left.

    cell: the size of the blocks by which cells and polygons meet.
    """
    key = F.struct("path", "col", "row")
    centres = rasters.select(key.alias("key"), (F.col("xmin") + (F.col("col") + 0.5) * F.col("res")).alias("x"), (F.col("ymax") - (F.col("row") + 0.5) * F.col("res_y")).alias("y"))
    inside = crowns.assign(centres, polygons, cell).where("crown_id is not null").select("key.*")
    left = written(rasters.join(inside, ["path", "col", "row"], "left_semi"), "clipped-cells")
    ends = left.groupBy("path").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    moved = {"xmin": F.col("xmin") + F.col("c0") * F.col("res"), "ymax": F.col("ymax") - F.col("r0") * F.col("res_y"), "width": F.col("c1") - F.col("c0") + 1, "height": F.col("r1") - F.col("r0") + 1}
    return left.join(ends, "path").withColumns(moved | {"col": F.col("col") - F.col("c0"), "row": F.col("row") - F.col("r0")}).select("path", "col", "row", "value", *PLACE)


def run(spark: SparkSession, source: str, target: str, operation: str, how: str = "", resolutions: list[float] | None = None, polygons: str = "", cell: float = 100.0, **options) -> int:
    """Applies the operation to all rasters under source and writes them into target, a folder that all executors share, as
    NAME_filled, NAME_0p5m (one for each resolution) or NAME_clipped; returns how many. Files of one name under source raise."""
    rasters = gtiff.read(spark, source)
    if operation == "fill":
        made, suffix = fill(rasters, how or "hybrid", **options), F.lit("_filled")
    elif operation == "resample":
        if not resolutions:
            raise ValueError("resample needs resolutions")
        made = resample(rasters, resolutions, how or "average")
        suffix = F.concat(F.lit("_"), F.replace(F.col("resolution").cast("string"), F.lit("."), F.lit("p")), F.lit("m"))
    elif operation == "clip":
        if not polygons:
            raise ValueError("clip needs polygons")
        made, suffix = clip(rasters, vectors.read_polygons(spark, polygons), cell), F.lit("_clipped")
    else:
        raise ValueError(f"unknown operation {operation!r}")
    named = written(made.withColumn("name", F.concat(stem(F.col("path")), suffix)), "post-rasters")
    if named.groupBy("name").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").count():
        raise ValueError("files of one name would overwrite each other")
    return len(gtiff.write_placed(named.drop("path"), target).collect())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="canopyforge-post", description="Fills, resamples or clips all rasters of a folder.")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("operation", choices=["fill", "resample", "clip"])
    p.add_argument("--how", default="", help="fill: nearest, mean, median, idw, hybrid; resample: average, nearest")
    p.add_argument("--resolutions", nargs="+", type=float)
    p.add_argument("--polygons", default="", help="GeoJSON, or a shapefile")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("canopyforge-post").getOrCreate()
    run(spark, a.source, a.target, a.operation, a.how, a.resolutions, a.polygons)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
