"""Individual trees of a canopy raster: peaks, screening, crowns, features."""

from __future__ import annotations

import json
from math import ceil, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyforge.functions.points import numbered

from . import kernels
from .surface import KEY, per_tile

#: What a method does: smooth before, screen pairs of peaks, grow crowns.
METHODS = {"lmf": ("gaussian", False, None), "watershed": ("gaussian", True, kernels.watershed), "yun2021": ("dual", True, kernels.water_expansion)}


def detect(canopy: DataFrame, res: float, method: str = "watershed", least_height: float = 2.0, window_m: float = 3.0, apart_m: float = 1.5, angle: float = 110.0, pair_m: float = 6.0, tile: int = 256, halo: int = 24) -> tuple[DataFrame, DataFrame]:
    """(peaks, crowns): peaks (col, row, height), crowns (col, row, tree) of a raster (col, row, value).

    A tree is named by its peak's cell (row * 2^20 + col), whatever tile it is seen from, so that crowns that reach over a tile's
    border are one. halo must cover a crown's radius and the distance of pairs.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    smooth, paired, grow = METHODS[method]
    window = max(3, int(round(window_m / res)) | 1)

    def kernel(a: np.ndarray, c0: int, r0: int) -> dict[str, np.ndarray]:
        z = kernels.dual_gaussian(a) if smooth == "dual" else np.where(np.isfinite(a), kernels.gaussian(a, 0.7), np.nan)
        peaks = kernels.prune(kernels.local_maxima(z, window, least_height), res, apart_m)
        if paired:
            peaks = kernels.screen(z, peaks, res, angle, pair_m)
        top, crown = np.full(a.shape, np.nan), np.zeros(a.shape, np.int64)
        for r, c in peaks:
            top[r, c] = z[r, c]
        if grow is not None:
            canopy_mask = np.isfinite(z) & (z >= least_height)
            labels = grow(z, peaks, canopy_mask, res) if grow is kernels.water_expansion else grow(z, peaks, canopy_mask)
            names = np.array([0] + [(r + r0) * (1 << 20) + c + c0 for r, c in peaks], np.int64)
            crown = names[labels]
        return {"peak": top, "tree": crown.astype(np.float64)}

    made = per_tile(canopy, kernel, "peak double, tree double", tile, halo)
    peaks = made.where("peak is not null").select(*KEY, F.col("peak").alias("height"))
    return peaks, made.where("tree > 0").select(*KEY, F.col("tree").cast("long").alias("tree"))


def crown_table(crowns: DataFrame, canopy: DataFrame, peaks: DataFrame, res: float, least_area: float = 0.75) -> DataFrame:
    """One row a tree: cells, area, radius of an equal circle, greatest and mean height, peaks inside, and whether several. Crowns of
    under least_area are left out; the rest is numbered from 1 in order of names."""
    cells = crowns.join(canopy, KEY).join(peaks.select(*KEY, F.lit(1).alias("p")), KEY, "left")
    t = cells.groupBy("tree").agg(F.count("*").alias("area_px"), F.max("value").alias("max_h_m"), F.avg("value").alias("mean_h_m"), F.count("p").alias("pk_count"))
    t = t.where(F.col("area_px") >= ceil(least_area / (res * res)))
    area = F.col("area_px") * (res * res)
    return numbered(t, "tree", "tree_id").select("tree_id", "tree", "area_px", area.alias("area_m2"), F.sqrt(area / pi).alias("rad_m"), "max_h_m", "mean_h_m", "pk_count", (F.col("pk_count") > 1).alias("multi_apx"))


def outlines(crowns: DataFrame, res: float, ymax: float, xmin: float = 0.0) -> DataFrame:
    """(tree, rings) of each crown: a JSON array of rings of (x, y), outer ones anticlockwise. A crown is one group, of its own cells."""

    def run(key, t):
        import pyarrow as pa

        rows, cols = t.column("row").to_numpy(), t.column("col").to_numpy()
        a = np.zeros((np.ptp(rows) + 1, np.ptp(cols) + 1), np.int32)
        a[rows - rows.min(), cols - cols.min()] = 1
        rings = kernels.outlines(a, xmin + int(cols.min()) * res, ymax - int(rows.min()) * res, res)[1]
        return pa.table({"tree": [key[0].as_py()], "rings": [json.dumps(rings)]})

    return crowns.groupBy("tree").applyInArrow(run, "tree long, rings string")


def point_features(peaks: DataFrame, res: float, ymax: float, xmin: float = 0.0) -> DataFrame:
    """One GeoJSON feature a peak, as text."""
    x, y = xmin + (F.col("col") + 0.5) * res, F.lit(ymax) - (F.col("row") + 0.5) * res
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    properties = F.struct((F.col("row") * (1 << 20) + F.col("col")).alias("peak_id"), F.col("height").alias("h_m"))
    return peaks.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))
