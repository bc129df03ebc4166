"""Tiles of a point cloud: planning, halos, clipping to cores, mosaics."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bounds = tuple[float, float, float, float]


def union(a: Bounds, b: Bounds) -> Bounds:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def intersection(a: Bounds, b: Bounds) -> Bounds | None:
    out = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return out if out[0] < out[2] and out[1] < out[3] else None


def area(b: Bounds | None) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) if b else 0.0


def grown(b: Bounds, by: float) -> Bounds:
    return b[0] - by, b[1] - by, b[2] + by, b[3] + by


@dataclass(frozen=True)
class Tile:
    name: str
    core: Bounds
    buffer: Bounds


def plan(extent: Bounds, size: float, halo: float, label: str = "tile", merge_below: float = 0.25) -> list[Tile]:
    """Square tiles from the extent's lower left corner, the last row and column cut off at its end.

    Tiles of less than merge_below of a full tile's area are joined to a neighbour, so that cores always partition the extent: a
    thin last column to the tiles left of it, then a thin last row to the tiles below. A halo surrounds every core.
    """
    if not size > 0 or halo < 0:
        raise ValueError("a tile needs a size above 0 and a halo of 0 or more")

    def edges(lo: float, hi: float) -> list[float]:
        n = max(1, ceil((hi - lo) / size))
        out = [lo + i * size for i in range(n)] + [hi]
        if n > 1 and (out[-1] - out[-2]) < merge_below * size:
            del out[-2]
        return out

    xs, ys = edges(extent[0], extent[2]), edges(extent[1], extent[3])
    out = []
    for j, (y0, y1) in enumerate(zip(ys[:-1], ys[1:], strict=True)):
        for i, (x0, x1) in enumerate(zip(xs[:-1], xs[1:], strict=True)):
            core = (x0, y0, x1, y1)
            out.append(Tile(f"{label}_{i:04d}_{j:04d}", core, grown(core, halo)))
    return out


def as_table(spark: SparkSession, tiles: list[Tile]) -> DataFrame:
    kind = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    return spark.createDataFrame([(t.name, t.core, t.buffer) for t in tiles], f"tile string, core {kind}, buffer {kind}")


def assign(points: DataFrame, size: float, halo: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """points once for each tile of a regular grid whose buffered square (closed) holds them: tx, ty, is_core (half-open).

    The tiles come from the coordinates, without a join; at most four a point while the halo is under half a tile.
    """

    def span(v: str, o: float) -> Column:
        lo, hi = F.floor((F.col(v) - halo - o) / size), F.floor((F.col(v) + halo - o) / size)
        # a point on the lower edge of the halo belongs to the closed square too
        first = F.when((F.col(v) - halo - o) == lo * size, lo - 1).otherwise(lo)
        return F.sequence(first.cast("int"), hi.cast("int"))

    wide = points.withColumn("tx", F.explode(span("x", x0))).withColumn("ty", F.explode(span("y", y0)))
    core = (F.floor((F.col("x") - x0) / size) == F.col("tx")) & (F.floor((F.col("y") - y0) / size) == F.col("ty"))
    return wide.withColumn("is_core", core)


def clip_to_core(points: DataFrame, tiles: DataFrame, closed: bool = False) -> DataFrame:
    """points (with tile) inside their tile's core: half-open, so that no point is in two, or closed."""
    t = tiles.select("tile", "core")
    c = points.join(t, "tile")
    upper = (F.col("x") <= F.col("core.xmax")) & (F.col("y") <= F.col("core.ymax")) if closed else (F.col("x") < F.col("core.xmax")) & (F.col("y") < F.col("core.ymax"))
    return c.where((F.col("x") >= F.col("core.xmin")) & (F.col("y") >= F.col("core.ymin")) & upper).drop("core")


def mosaic(layers: DataFrame, order: str = "tile", value: str = "value") -> DataFrame:
    """One value for each global (col, row): that of the first tile in order that has one."""
    return layers.where(F.col(value).isNotNull()).groupBy("col", "row").agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def sources_of_tiles(tiles: DataFrame, files: DataFrame, cell: float) -> DataFrame:
    """(tile, paths): the files whose bounds meet a tile's buffer, closed; by cells of the given size, as an equi-join.

    tiles: (tile, buffer); files: (path, bounds), both structs of xmin, ymin, xmax, ymax.
    """

    def cells(b: str) -> list[Column]:
        return [F.explode(F.sequence(F.floor(F.col(f"{b}.{lo}") / cell), F.floor(F.col(f"{b}.{hi}") / cell))) for lo, hi in (("xmin", "xmax"), ("ymin", "ymax"))]

    def spread(df: DataFrame, b: str) -> DataFrame:
        gx, gy = cells(b)
        return df.withColumn("gx", gx).withColumn("gy", gy)

    t, f = spread(tiles.select("tile", "buffer"), "buffer"), spread(files.select("path", "bounds"), "bounds")
    meet = (F.col("buffer.xmin") <= F.col("bounds.xmax")) & (F.col("bounds.xmin") <= F.col("buffer.xmax")) & (F.col("buffer.ymin") <= F.col("bounds.ymax")) & (F.col("bounds.ymin") <= F.col("buffer.ymax"))
    return t.join(f, ["gx", "gy"]).where(meet).groupBy("tile").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def compatible(headers: DataFrame, *columns: str) -> None:
    """Raises unless all rows of headers agree in the columns: point format, version, scales, offsets, reference system."""
    kinds = headers.select(*columns).distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"sources differ in {', '.join(c for c in columns if kinds[0][c] != kinds[1][c])}")


def overlaps(files: DataFrame, cell: float) -> DataFrame:
    """(a, b, area) of files (path, bounds) whose bounds overlap by an area; by cells, so that only near ones meet."""
    gx = F.explode(F.sequence(F.floor(F.col("bounds.xmin") / cell), F.floor(F.col("bounds.xmax") / cell)))
    gy = F.explode(F.sequence(F.floor(F.col("bounds.ymin") / cell), F.floor(F.col("bounds.ymax") / cell)))
    f = files.select("path", "bounds").withColumn("gx", gx).withColumn("gy", gy)
    a, b = f.select("gx", "gy", F.col("path").alias("a"), F.col("bounds").alias("p")), f.select("gx", "gy", F.col("path").alias("b"), F.col("bounds").alias("q"))
    w = F.least("p.xmax", "q.xmax") - F.greatest("p.xmin", "q.xmin")
    h = F.least("p.ymax", "q.ymax") - F.greatest("p.ymin", "q.ymin")
    return a.join(b, ["gx", "gy"]).where((F.col("a") < F.col("b")) & (w > 0) & (h > 0)).select("a", "b", (w * h).alias("area")).distinct()


def diagnosis(files: DataFrame, cell: float) -> DataFrame:
    """One row: files, their area, that of the extent, its covered share (by sums), pairs that overlap, and whether gaps are likely."""
    area = (F.col("bounds.xmax") - F.col("bounds.xmin")) * (F.col("bounds.ymax") - F.col("bounds.ymin"))
    whole = (F.max("bounds.xmax") - F.min("bounds.xmin")) * (F.max("bounds.ymax") - F.min("bounds.ymin"))
    one = files.agg(F.count("*").alias("files"), F.sum(area).alias("area"), whole.alias("extent"))
    pairs = overlaps(files, cell).agg(F.count("*")).scalar()
    share = F.col("area") / F.nullif("extent", F.lit(0.0))
    return one.select("files", "area", "extent", F.round(share, 9).alias("covered"), pairs.alias("overlapping"), (share < 0.98).alias("gaps"))


def merge(layers: DataFrame, product: str, tiles: DataFrame | None = None) -> DataFrame:
    """A product's tiles as one table: points clipped to their tiles' cores, rasters with the first tile's value for each cell (of each
    variant, where the table has that column). Other products raise."""
    if product in ("CLASSIFIED", "NORMALIZED", "TREECLOUDS"):
        if tiles is None:
            raise ValueError("points are clipped to the cores of tiles")
        return clip_to_core(layers, tiles)
    if product not in ("DEM", "DSM", "CHM", "TERRAIN", "STRUCTURE", "CHANGE"):
        raise ValueError(f"{product} is not merged from tiles")
    by = ["variant"] if "variant" in layers.columns else []
    return layers.where("value is not null").groupBy(*by, "col", "row").agg(F.min_by("value", "tile").alias("value"), F.min("tile").alias("tile"))
