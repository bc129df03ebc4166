"""Points and tree crowns: point-in-polygon with priority, leftovers to the nearest crown, residual segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyforge.functions.storage import written

from .lookup import _blocks, _extent, rounds


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Is (x, y) in the ring, an array of (x, y) structs whose last joins its first? By the parity of edges to its right."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), after.alias("b"))

    def cross(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + cross(e)) % 2 == 1


#: Crowns that a block holds on average at most, if blocks can be smaller.
MOST_CROWNS = 64


def _places(points: DataFrame) -> DataFrame:
    """(x, y): points at one place have one crown."""
    return points.select("x", "y").where("x is not null and y is not null").distinct()


def _at_places(places: DataFrame, crowns: DataFrame, cell: float, rectangles: bool) -> DataFrame:
    """(x, y, crown_id) of the places that a crown holds: the smallest, of equal ones that of the smaller id."""
    # of crowns of one shape, only the first can be the smallest
    shape = ["area", "xmin", "ymin", "xmax", "ymax", *([] if rectangles else ["ring"])]
    only = written(crowns.groupBy(*shape).agg(F.min("crown_id").alias("crown_id")), "crown-shapes")
    gx = F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell)))
    gy = F.explode(F.sequence(F.floor(F.col("ymin") / cell), F.floor(F.col("ymax") / cell)))
    boxes = only.withColumn("gx", gx).withColumn("gy", gy)
    p = places.select("x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    hit = p.join(boxes.hint("merge"), ["gx", "gy"]).where((F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax")))
    if not rectangles:
        hit = hit.where(inside(F.col("ring"), F.col("x"), F.col("y")))
    return hit.groupBy("x", "y").agg(F.min(F.struct("area", "crown_id")).alias("best")).select("x", "y", F.col("best.crown_id").alias("crown_id"))


def assign(points: DataFrame, crowns: DataFrame, cell: float, rectangles: bool = False) -> DataFrame:
    """points with crown_id of the smallest crown that holds them (ties: the smaller id), NULL if none does.

    crowns: (crown_id, area, xmin, ymin, xmax, ymax, and ring unless rectangles). The points' places and the crowns are dealt to cells; a
    crown goes to all cells that its box meets, a place to one, so that the join is by cell and the exact test is for the few left.
    Points get their place's crown.
    """
    first = written(_at_places(_places(points), crowns, cell, rectangles), "crown-places")
    return points.join(first.hint("merge"), ["x", "y"], "left").select(*points.columns, "crown_id")


def nearest_crown(points: DataFrame, crowns: DataFrame, cell: float, key: str = "point_id") -> DataFrame:
    """(key, crown_id) of the crown with the nearest centre (cx, cy), ties to the smaller id; by growing blocks, from `cell` on."""
    near = _nearest_at(_places(points), crowns, cell)
    if near is None:
        return points.select(key, F.lit(None).cast("int").alias("crown_id")).limit(0)
    return points.select(key, "x", "y").join(near.hint("merge"), ["x", "y"]).select(key, "crown_id")


def _nearest_at(places: DataFrame, crowns: DataFrame, cell: float) -> DataFrame | None:
    """(x, y, crown_id) of places, by the nearest centre; None without places or crowns."""
    # of crowns with one centre, only the first can be the nearest
    c = written(crowns.groupBy("cx", "cy").agg(F.min("crown_id").alias("crown_id")), "crown-centres")
    p = written(places.select(F.col("x").alias("px"), F.col("y").alias("py")), "nearest-places")
    whole = _extent((p, "px", "py"), (c, "cx", "cy"))
    if whole is None:
        return None
    n = c.count()
    while n > MOST_CROWNS * _blocks(c, cell, "cx", "cy").select("bx", "by").distinct().count():
        cell = cell / 2

    def search(left: DataFrame, size: float, last: bool) -> DataFrame:
        # centres go to the nine blocks around theirs, as they are the fewer
        near = _blocks(left, size, "px", "py").join(_blocks(c, size, "cx", "cy", True).hint("merge"), ["bx", "by"])
        ex, ey = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
        best = near.groupBy("px", "py").agg(F.min(F.struct((ex * ex + ey * ey).alias("d2"), "crown_id")).alias("b"))
        return best.where((F.sqrt("b.d2") <= size) | F.lit(last)).select("px", "py", F.col("b.crown_id").alias("crown_id"))

    return rounds(p, ["px", "py"], cell, whole, search, ["px", "py", "crown_id"]).withColumnsRenamed({"px": "x", "py": "y"})


def segment(points: DataFrame, crowns: DataFrame, cell: float, least_height: float, rectangles: bool = False) -> DataFrame:
    """points of least_height and more with their crown: the smallest that holds them, else the one with the nearest centre."""
    high = points.where(F.col("height") >= least_height)
    places = _places(high)
    at = written(places.join(_at_places(places, crowns, cell, rectangles).hint("merge"), ["x", "y"], "left"), "crown-places")
    near = _nearest_at(at.where("crown_id is null").select("x", "y"), crowns, cell)
    how = F.when(F.col("crown_id").isNotNull(), "inside").otherwise("nearest")
    at = at.withColumn("how", how)
    if near is not None:
        at = at.where("how = 'inside'").unionByName(near.withColumn("how", F.lit("nearest")))
    got = high.join(at.hint("merge"), ["x", "y"], "left")
    return got.select(*points.columns, "crown_id", F.coalesce("how", F.lit("nearest")).alias("how"))


def residual_segments(points: DataFrame, cell: float, by: str = "crown_id") -> DataFrame:
    """points with segment: within each crown, the four-connected components of cells that hold its points, numbered from 1 by
    their first cell. A crown is a task's group; its cells are a crown's, not its points'."""
    import numpy as np
    import pyarrow as pa

    from .regions import _label

    rows = points.withColumns({"ix": F.floor(F.col("x") / cell).cast("int"), "iy": F.floor(F.col("y") / cell).cast("int")})
    kind = dict(points.dtypes)[by]

    def run(t: pa.Table) -> pa.Table:
        ix, iy = t.column("ix").to_numpy(), t.column("iy").to_numpy()
        order = np.lexsort((iy, ix))
        ix, iy = ix[order], iy[order]
        _, segment = np.unique(_label(ix, iy, False), return_inverse=True)
        return pa.table({by: t.column(by), "ix": ix, "iy": iy, "segment": (segment + 1).astype(np.int32)})

    named = rows.select(by, "ix", "iy").distinct().groupBy(by).applyInArrow(run, f"{by} {kind}, ix int, iy int, segment int")
    return rows.join(named, [by, "ix", "iy"]).drop("ix", "iy")


def peak_counts(segments: DataFrame, peaks: DataFrame) -> DataFrame:
    """(segment, peaks): how many peaks lie in each segment."""
    return segments.join(peaks.select("ix", "iy"), ["ix", "iy"]).groupBy("segment").agg(F.count("*").alias("peaks"))


