"""Connected regions of cells, holes, and their filling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyforge.functions.points import numbered
from canopyforge.functions.storage import written

KEY = ["ix", "iy"]


def _label(ix: np.ndarray, iy: np.ndarray, diagonal: bool) -> np.ndarray:
    """Index of the first cell, in order of (ix, iy), of each cell's component; cells must be in that order and distinct."""
    at = {c: i for i, c in enumerate(zip(ix.tolist(), iy.tolist(), strict=True))}
    root = list(range(len(ix)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    back = [(-1, 0), (0, -1)] + ([(-1, -1), (-1, 1)] if diagonal else [])
    for (x, y), i in at.items():
        for dx, dy in back:
            j = at.get((x + dx, y + dy))
            if j is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(root))], np.int64)


def components(cells: DataFrame, diagonal: bool = True, tile: int = 1024) -> DataFrame:
    """(ix, iy, label) of distinct cells; the label is the least ix * 2^32 + iy (as ix, iy order) of the component.

    Union-find labels the cells of each tile by themselves; tiles are joined over pairs of neighbouring cells on their
    borders only, whose labels go through rounds of least neighbours until none changes.
    """
    place = F.shiftleft(F.col("ix").cast("long"), 32) + F.col("iy") + F.lit(1 << 31)
    rows = cells.select(*KEY).distinct().withColumns({"tx": F.floor(F.col("ix") / tile).cast("int"), "ty": F.floor(F.col("iy") / tile).cast("int")})

    def run(t: pa.Table) -> pa.Table:
        ix, iy = t.column("ix").to_numpy(), t.column("iy").to_numpy()
        order = np.lexsort((iy, ix))
        ix, iy = ix[order], iy[order]
        root = _label(ix, iy, diagonal)
        return pa.table({"ix": ix, "iy": iy, "own": (ix[root].astype(np.int64) << 32) + iy[root] + (1 << 31)})

    own = written(rows.groupBy("tx", "ty").applyInArrow(run, "ix int, iy int, own long"), "regions")
    edge = own.where((F.pmod("ix", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("iy", F.lit(tile)).isin(0, tile - 1)))
    moves = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    near = edge.withColumn("m", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in moves])))
    near = near.select((F.col("ix") + F.col("m.dx")).alias("ix"), (F.col("iy") + F.col("m.dy")).alias("iy"), F.col("own").alias("a"))
    links = near.join(edge.select(*KEY, F.col("own").alias("b")), KEY).where("a <> b").select("a", "b").distinct()
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "region-links")
    if links.isEmpty():
        return own.select(*KEY, F.col("own").alias("label"))
    least = written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "region-labels")
    while True:
        heard = links.join(least.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        # a label points to a node, whose own label may be less: following it halves the way
        nxt = least.join(heard, "a").join(least.select(F.col("a").alias("label"), F.col("label").alias("further")), "label", "left")
        nxt = written(nxt.select("a", F.least("label", "heard", "further").alias("label"), F.col("label").alias("before")), "region-labels")
        if nxt.where("label <> before").isEmpty():
            break
        least = nxt.select("a", "label")
    return own.join(least.select(F.col("a").alias("own"), "label"), "own", "left").select(*KEY, F.coalesce("label", "own").alias("label"))


def small_holes(valid: DataFrame, most: int = 25, diagonal: bool = True, exclude_edge: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """(ix, iy, label) of cells without a value inside the extent of those with one, in components of at most `most` cells;
    exclude_edge: and not touching the extent's border. frames (x0, x1, y0, y1): several extents instead, with a gap between them."""
    if frames is None:
        x0, x1, y0, y1 = valid.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
        if x0 is None:
            return valid.select(*KEY, F.lit(None).cast("long").alias("label")).limit(0)
        # columns of cells are dealt over all tasks
        column = valid.sparkSession.range(x0, x1 + 1).select(F.col("id").cast("int").alias("ix"))
        column = column.select("ix", *(F.lit(v).alias(n) for n, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))))
    else:
        column = frames.select("*", F.explode(F.sequence("x0", "x1")).alias("ix")).repartition("ix")
    whole = column.select("*", F.explode(F.sequence("y0", "y1")).alias("iy"))
    edge = F.col("ix").isin(F.col("x0"), F.col("x1")) | F.col("iy").isin(F.col("y0"), F.col("y1"))
    empty = whole.join(valid.select(*KEY), KEY, "left_anti").withColumn("edge", edge)
    empty = written(empty.select(*KEY, "edge"), "empty-cells")
    named = components(empty, diagonal).join(empty, KEY)
    size = named.groupBy("label").agg(F.count("*").alias("n"), F.max("edge").alias("edge"))
    good = size.where((F.col("n") <= most) & (~F.col("edge") | F.lit(not exclude_edge)))
    return named.join(good.select("label"), "label").select(*KEY, "label")


def fill_small_voids(cells: DataFrame, how: str = "nearest", most: int = 25, radius: int = 3, least: int = 1, power: float = 2.0, diagonal: bool = True, exclude_edge: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """cells (ix, iy, value) with small holes filled: nearest, mean, median, idw, or hybrid (the mean, and where too few cells are
    near the nearest). frames: as in small_holes."""
    from .focal import fill_local
    from .lookup import nearest_cell

    valid = cells.where("value is not null").select(*KEY, "value")
    holes = small_holes(valid, most, diagonal, exclude_edge, frames)
    if how == "nearest":
        made = nearest_cell(holes, valid).select(*KEY, "value")
    elif how == "hybrid":
        made = fill_local(valid, holes, radius, "mean", least, power)
        rest = holes.join(made, KEY, "left_anti")
        made = made.unionByName(nearest_cell(rest, valid).select(*KEY, "value"))
    else:
        made = fill_local(valid, holes, radius, how, least, power)
    return valid.unionByName(made.select(*KEY, "value"))


def drop_small(labels: DataFrame, least_cells: int) -> DataFrame:
    """(ix, iy, label) without labels of fewer cells, the rest numbered 1, 2, ... in their order."""
    kept = labels.groupBy("label").count().where(F.col("count") >= least_cells)
    return labels.join(numbered(kept.select("label"), "label", "segment"), "label").select(*KEY, "segment")


def enclosed(valid: DataFrame, diagonal: bool = False) -> DataFrame:
    """(ix, iy) of the cells without a value that valid cells enclose, whatever their number."""
    return small_holes(valid, (1 << 62), diagonal).select(*KEY)


def closed(mask: DataFrame, times: int = 1) -> DataFrame:
    """(ix, iy) of a mask closed by its four neighbours (grown, then shrunk, `times` over) with what it encloses then filled."""
    from .focal import dilate, spread

    grown = dilate(mask, times)
    # a cell stays if all cells within the cross around it are in the grown mask
    whole = 2 * times * (times + 1) + 1
    kept = spread(grown, times, cross=True).groupBy(*KEY).count().where(F.col("count") == whole).select(*KEY)
    kept = written(kept.unionByName(mask.select(*KEY)).distinct(), "closed-mask")
    return kept.unionByName(enclosed(kept))


def fill_enclosed(cells: DataFrame, least: float = 0.0) -> DataFrame:
    """cells (ix, iy, value) with enclosed holes, cells without a value of at least `least`, given the greatest value around them, and
    cells outside left as they are; cells of a hole that no valid cell touches stay as they are, too."""
    from .focal import spread

    valid = cells.where(F.col("value") >= least).select(*KEY, "value")
    top = spread(valid, 1).groupBy(*KEY).agg(F.max("value").alias("top")).join(enclosed(valid), KEY, "left_semi")
    return cells.select(*KEY, "value").join(top, KEY, "full").select(*KEY, F.coalesce("top", "value").alias("value"))
