"""Points that stand alone, and robust scores."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyforge.functions.points import exact_percentile, finite
from canopyforge.functions.storage import written

from . import kernels


def isolated(points: DataFrame, radius: float, least: int = 2, key: str = "point_id") -> DataFrame:
    """points with fewer than `least` others within radius (in space). Each looks at the 27 cells of that size around it."""
    cell = {c: F.floor(F.col(c) / radius).cast("long").alias(f"g{c}") for c in "xyz"}
    p = points.select(key, "x", "y", "z", *cell.values())
    moves = F.array(*[F.struct(*(F.lit(d).alias(n) for d, n in zip(m, "ijk", strict=True))) for m in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))])
    wide = p.withColumn("m", F.explode(moves)).select(F.col(key).alias("of"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), (F.col("gx") + F.col("m.i")).alias("gx"), (F.col("gy") + F.col("m.j")).alias("gy"), (F.col("gz") + F.col("m.k")).alias("gz"))
    d2 = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 + (F.col("z") - F.col("z2")) ** 2
    crowd = p.join(wide, ["gx", "gy", "gz"]).where((F.col(key) != F.col("of")) & (d2 <= radius * radius)).groupBy(key).agg(F.count("*").alias("near"))
    return points.join(crowd, key, "left").where(F.coalesce("near", F.lit(0)) < least).drop("near")


#: About how many places a tile of the neighbour search holds, and how many at most where tiles can be smaller.
TILE_PLACES, MOST_PLACES = 40_000, 300_000
#: Most rows that are broadcast; more are joined by a shuffle, whatever their size on disk.
MOST_BROADCAST = 50_000


def place_distances(places: DataFrame, k: int, reach: float, axes: str = "xyz", listed: bool = True) -> DataFrame:
    """(axes, m, n, mean_d, all_d) of places (axes, m), distinct and finite, with m points each: the mean distance of a point there to the
    k nearest others, whatever their distance, how many there were, and their distances (not unless listed).

    Places are dealt to tiles with a halo, in which a kernel looks for each place's neighbours. That proves them where the edge of what a
    tile sees is no nearer than the last; other places look again with twice the halo, until none is left or it covers all.
    """
    import pyarrow as pa

    names = list(axes)
    p = written(places.select(*names, F.col("m").cast("long").alias("m")), "neighbour-places")
    ends = p.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{i}") for c in names for i, f in enumerate((F.min, F.max)))).first()
    lo, hi = ([ends[f"{c}{i}"] or 0.0 for c in names] for i in (0, 1))
    whole = max(b - a for a, b in zip(lo, hi, strict=True))

    def tile(size: float) -> list[Column]:
        return [F.floor(F.col(c) / size).cast("long").alias(f"t{c}") for c in names]

    held = p.select(*tile(reach)).distinct().count()
    halo = reach * min(1.0, 1.5 * (k * held / max(1, ends.n)) ** (1 / len(names)))
    size = halo * (TILE_PLACES / k) ** (1 / len(names))
    while size > halo / 8 and (p.groupBy(*tile(size)).count().agg(F.max("count")).first()[0] or 0) > MOST_PLACES:
        size = size / 2
    halo = min(halo, size)
    kind = ", ".join(f"{c} double" for c in names) + ", m long, n long, mean_d double" + (", all_d array<double>" if listed else "")

    def search(size: float, halo: float, last: bool):
        def run(key, t):
            at = np.array([v.as_py() for v in key], float)
            xyz, m, flag = np.column_stack([t.column(c).to_numpy() for c in names]), t.column("m").to_numpy(), t.column("flag").to_numpy()
            e = 1e-9 * (1 + max(map(abs, (*lo, *hi))))
            low, high = at * size - halo + e, (at + 1) * size + halo - e
            low, high = np.where(low <= lo, -np.inf, low), np.where(high > hi, np.inf, high)
            wanted, own = xyz[flag > 0], m[flag > 0]
            margin = np.full(len(wanted), np.inf) if last else np.minimum(wanted - low, high - wanted).min(1, initial=np.inf)
            d, take = kernels.nearest(xyz[flag < 2], m[flag < 2], wanted, k, margin)
            n = take.sum(1)
            ok = (n >= k) | (np.isinf(margin) & (n > 0))
            d, take, n, wanted, own = d[ok], take[ok], n[ok], wanted[ok], own[ok]
            far = np.where(take > 0, d, 0.0)
            out = {c: wanted[:, i] for i, c in enumerate(names)} | {"m": own, "n": n, "mean_d": (far * take).sum(1) / n}
            if listed:
                out["all_d"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.repeat(far.ravel(), take.ravel()))
            return pa.table(out)

        return run

    left, found = None, None
    while True:
        last = halo > whole
        rows = p
        for c in names:
            span = F.sequence(*(F.floor((F.col(c) + d) / size).cast("long") for d in (-halo, halo)))
            rows = rows.withColumn(f"t{c}", F.explode(span))
        own = functools.reduce(lambda a, b: a & b, [F.col(f"t{c}") == F.floor(F.col(c) / size) for c in names])
        if left is None:
            rows = rows.withColumn("flag", own.cast("int"))
        else:
            ask = left.select("*", *tile(size))
            keys = [f"t{c}" for c in names]
            rows = rows.join(ask.select(*keys).distinct(), keys, "left_semi").withColumn("flag", F.lit(0)).unionByName(ask.withColumn("flag", F.lit(2)))
        done = written(rows.groupBy(*(f"t{c}" for c in names)).applyInArrow(search(size, halo, last), kind), "neighbour-distances")
        found = done if found is None else found.unionByName(done)
        if last or found.count() == ends.n:
            return found
        left = written((p if left is None else left).join(done.select(*names).hint("merge"), names, "left_anti"), "neighbours-open")
        halo = 2 * halo
        size = max(size, halo)


def places_of(points: DataFrame, axes: str) -> DataFrame:
    """(axes, m): the places of points with finite coordinates and their number there."""
    p = points.select(*(F.col(c).cast("double").alias(c) for c in axes))
    return finite(p, *axes).dropna(subset=list(axes)).groupBy(*axes).agg(F.count("*").alias("m"))


def neighbour_distance(points: DataFrame, k: int, reach: float, key: str = "point_id", axes: str = "xyz") -> DataFrame:
    """(key, n, mean_d, all_d): the mean distance to the k nearest points, whatever their distance, how many there were (k, or all others
    of a smaller cloud), and their distances. Points without finite coordinates take no part. reach: a distance to start from."""
    made = place_distances(places_of(points, axes), k, reach, axes)
    p = points.select(key, *(F.col(c).cast("double").alias(c) for c in axes))
    return p.join(made.hint("merge"), list(axes)).select(key, "n", "mean_d", "all_d")


def statistical_outliers(points: DataFrame, k: int = 20, most: float = 3.0, reach: float = 5.0) -> DataFrame:
    """points whose mean distance to the k nearest is more than `most` standard deviations (of a sample) above the mean of all, and those
    without finite coordinates; none of clouds of up to k + 1 points. reach: where the search starts."""
    d = place_distances(places_of(points, "xyz"), k, reach, listed=False)
    n, total = d.agg(F.sum("m"), F.sum(F.col("m") * F.col("mean_d"))).first()
    if (n or 0) <= k + 1:
        return points.limit(0)
    mean = total / n
    sd = (d.agg(F.sum(F.col("m") * (F.col("mean_d") - mean) ** 2)).first()[0] / (n - 1)) ** 0.5
    far = written(d.where((F.col("mean_d") - mean > most * sd) & F.lit(sd > 0)).select(*(F.col(c).alias(f"_{c}") for c in "xyz")), "outlier-places")
    far = F.broadcast(far) if far.count() <= MOST_BROADCAST else far.hint("merge")
    at = [F.col(c).cast("double") for c in "xyz"]
    odd = functools.reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in at])
    return points.join(far, [v == F.col(f"_{c}") for v, c in zip(at, "xyz", strict=True)], "left_semi").unionByName(points.where(odd))


def robust_z(df: DataFrame, column: str, *by: str) -> DataFrame:
    """df with robust_z: (value - median) / (1.4826 MAD + 1e-12), by group, or over
    the whole table; aggregates joined back, not windows."""
    if not by:
        mid = exact_percentile(df, column, 0.5)
        mad = None if mid is None else exact_percentile(df, F.abs(F.col(column) - mid), 0.5)
        return df.withColumn("robust_z", F.lit(None).cast("double") if mid is None else (F.col(column) - mid) / (1.4826 * mad + 1e-12))
    mid = df.groupBy(*by).agg(F.median(column).alias("_mid"))
    mad = df.join(mid, list(by)).groupBy(*by).agg(F.median(F.abs(F.col(column) - F.col("_mid"))).alias("_mad"))
    return df.join(mid.join(mad, list(by)), list(by)).withColumn("robust_z", (F.col(column) - F.col("_mid")) / (1.4826 * F.col("_mad") + 1e-12)).drop("_mid", "_mad")


def quantiles(df: DataFrame, column: str, qs: tuple[float, ...], *by: str) -> DataFrame:
    """Exact linear quantiles of a column by group, as q0, q1, ..."""
    return df.groupBy(*by).agg(*[F.percentile(column, q).alias(f"q{i}") for i, q in enumerate(qs)])
