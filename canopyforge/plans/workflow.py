"""Whole runs: products and what they depend on, from point files to tables and rasters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyforge.functions.sensors import settings
from canopyforge.functions.storage import written
from canopyforge.operators import cells, change, crowns, ground, lookup, surface, terrain, trees
from canopyforge.sources import gtiff, las, layout

# The products, and which others each is made from.
NEEDS = {
    "CLASSIFIED": (), "DEM": ("CLASSIFIED",), "NORMALIZED": ("CLASSIFIED", "DEM"), "DSM": (), "CHM": ("NORMALIZED",), "TERRAIN": ("DEM",), "STRUCTURE": ("NORMALIZED",),
    "ITD": ("CHM",), "TREECLOUDS": ("ITD", "NORMALIZED"), "CHANGE": (),
}
ALL = ("CLASSIFIED", "DEM", "NORMALIZED", "DSM", "CHM", "TERRAIN", "STRUCTURE")
TERRAIN = ("slope_pct", "slope_deg", "aspect", "hillshade", "curvature", "tpi", "tci", "twi", "dtw")


def resolve(products: list[str]) -> list[str]:
    """The products asked for, in order, each after what it is made from; `all` stands for the seven of a plain run."""
    out: list[str] = []

    def add(name: str) -> None:
        if name not in NEEDS:
            raise ValueError(f"unknown product {name!r}; there are {sorted(NEEDS)}")
        for n in NEEDS[name]:
            add(n)
        if name not in out:
            out.append(name)

    for p in products:
        for name in ALL if p.lower() == "all" else (p.upper(),):
            add(name)
    return out


@dataclass(frozen=True)
class CanopySpec:
    """How a canopy model is made, from text like `pitfree`, `p99:smooth=median` or `band:p2r:low=2:high=10`."""

    method: str = "p2r"
    selector: str = "all"
    options: dict = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> CanopySpec:
        methods, selectors = ("p2r", "p99", "tin", "pitfree", "cloth"), ("below", "above", "band")
        method, selector, options = None, "all", {}
        for part in filter(None, (p.strip() for p in text.lower().split(":"))):
            name, eq, value = part.partition("=")
            if eq:
                options[name.strip()] = float(value) if value.replace(".", "", 1).lstrip("-").isdigit() else value
            elif part in methods:
                method = part
            elif part in selectors:
                selector = part
            else:
                raise ValueError(f"cannot read {part!r} in canopy spec {text!r}")
        return CanopySpec(method or "p2r", selector, options)

    @property
    def label(self) -> str:
        """A name for folders: 2.5 becomes 2p5."""
        own = [self.selector] * (self.selector != "all") + [self.method]
        return "_".join(own + [f"{k}{v:g}".replace(".", "p") if isinstance(v, float) else f"{k}{v}" for k, v in sorted(self.options.items())])


def run(spark: SparkSession, points: DataFrame, sensor: str, products: list[str], res: float = 0.5, canopy: str = "", fix: bool = False, dem: str = "min", dsm: str = "max", itd: str = "watershed", key: str = "point_id", adaptive: bool = False) -> dict[str, DataFrame]:
    """Each product as a DataFrame by name. Nothing is made that isn't asked for or needed; what several need is written once.

    A failed product raises; there is no partial success. adaptive: settings follow the cloud's density.
    """
    s, made = settings(sensor), {}
    wanted = resolve(products)
    ymax, xmin = grid_of(points, res)
    for name in wanted:
        if name == "CLASSIFIED":
            out = ground.classify(points, sensor, ground.adapted_settings(points, sensor) if adaptive else None)
            made[name] = written(ground.fix_false_ground(out) if fix else out, "classified")
        elif name == "DEM":
            made[name] = written(surface.elevation_model(made["CLASSIFIED"].where("classification = 2"), res, ymax, xmin, dem), "dem")
        elif name == "NORMALIZED":
            low = made["DEM"].select(F.col("col").alias("ix"), (-F.col("row") - 1).alias("iy"), "value")
            moved = made["CLASSIFIED"].withColumns({"x0": F.col("x"), "y0": F.col("y"), "x": F.col("x") - xmin, "y": F.col("y") - ymax})
            got = lookup.normalize_heights(moved, low, res).drop("x", "y", "value").withColumnsRenamed({"x0": "x", "y0": "y", "height": "h"})
            made[name] = written(got, "normalized")
        elif name == "DSM":
            made[name] = surface.surface_model(points, res, ymax, xmin, dsm)
        elif name == "CHM":
            spec = CanopySpec.parse(canopy or s.canopy_method)
            o = spec.options
            p = surface.select_heights(made["NORMALIZED"], spec.selector, o.get("at"), o.get("low"), o.get("high"))
            made[name] = written(surface.canopy_model(p, res, ymax, xmin, spec.method, thresholds=s.canopy_thresholds, smooth=o.get("smooth", "none"), least_height=o.get("min_height", 0.0), pit_threshold=o.get("pit")), "chm")
        elif name == "TERRAIN":
            made[name] = terrain_products(made["DEM"], res)
        elif name == "STRUCTURE":
            cell, least, bin_m, cover = s.structure
            made[name] = cells.structure_metrics(made["NORMALIZED"].where("h is not null"), cell, bin_m, cover, least)
        elif name == "ITD":
            peaks, crown = trees.detect(made["CHM"], res, itd)
            made[name], made["CROWNS"] = peaks, written(crown, "crowns")
        elif name == "TREECLOUDS":
            made[name] = crown_points(made["NORMALIZED"], made["CROWNS"], res, ymax, xmin, key)
        elif name == "CHANGE":
            raise ValueError("CHANGE compares rasters of epochs; use change_of()")
    return {n: made[n] for n in wanted if n in made} | ({"CROWNS": made["CROWNS"]} if "CROWNS" in made else {})


def grid_of(points: DataFrame, res: float) -> tuple[float, float]:
    """(ymax, xmin) of a grid that snaps to whole cells, so that tiles and epochs share it."""
    ends = points.agg(F.max("y").alias("ymax"), F.min("x").alias("xmin")).first()
    if ends.ymax is None:
        raise ValueError("there are no points")
    return (int(ends.ymax // res) + 1) * res, int(ends.xmin // res) * res


def derive(spark: SparkSession, classified: DataFrame, products: list[str], res: float = 0.5, dem: str = "min") -> dict[str, DataFrame]:
    """DEM and NORMALIZED from points that are classified already; other products raise."""
    if unknown := {p.upper() for p in products} - {"DEM", "NORMALIZED"}:
        raise ValueError(f"{sorted(unknown)} are not derived from classified points")
    ymax, xmin = grid_of(classified, res)
    model = written(surface.elevation_model(classified.where("classification = 2"), res, ymax, xmin, dem), "dem")
    out = {"DEM": model}
    if "NORMALIZED" in {p.upper() for p in products}:
        low = model.select(F.col("col").alias("ix"), (-F.col("row") - 1).alias("iy"), "value")
        moved = classified.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x": F.col("x") - xmin, "y": F.col("y") - ymax})
        out["NORMALIZED"] = lookup.normalize_heights(moved, low, res).drop("x", "y", "value").withColumnsRenamed({"x0": "x", "y0": "y", "height": "h"})
    return {p: t for p, t in out.items() if p in {q.upper() for q in products}}


def save(spark: SparkSession, tables: dict[str, DataFrame], points: DataFrame, root: str, res: float, settings: dict, overwrite: bool = False, files: bool = False) -> dict[str, int]:
    """Rows of each product, kept as a table under root; one that is there with the same settings is not made again. files: point
    products as LAS and rasters as GeoTIFF files, too, one for each tile or column, into folders that executors share."""
    ymax, xmin = grid_of(points, res)
    out = {}
    for name, table in tables.items():
        kept = layout.keep(table, layout.product_folder(root, name), settings, overwrite)
        out[name] = kept.count()
        folder = f"{layout.product_folder(root, name)}-files".removeprefix("file://")
        if files and {"x", "y", "z"} <= set(kept.columns):
            las.write_points(kept.withColumn("name", F.lit(name.lower())), folder, "name").collect()
        elif files and "col" in kept.columns:
            for value in (c for c in kept.columns if c not in ("col", "row")):
                rows = kept.select("col", "row", F.col(value).cast("double").alias("value"), F.lit(value).alias("name"))
                gtiff.write(rows.where("value is not null"), folder, "name", xmin, ymax, res).collect()
    return out


def terrain_products(dem: DataFrame, res: float, products: tuple[str, ...] = TERRAIN, radius: int = 3) -> DataFrame:
    """(col, row, and a column for each product) of an elevation raster (col, row, value)."""
    unknown = set(products) - set(TERRAIN)
    if unknown:
        raise ValueError(f"unknown terrain products {sorted(unknown)}")
    z = dem.select("col", "row", F.col("value").alias("z"))
    parts = [
        (("slope_pct", "slope_deg", "aspect", "hillshade"), lambda: terrain.slope_aspect_shade(z, res)), (("curvature",), lambda: terrain.curvature(z, res)), (("tpi",), lambda: terrain.tpi(z, radius)),
        (("tci",), lambda: terrain.tci(z, res)), (("twi",), lambda: terrain.twi(z, res)), (("dtw",), lambda: terrain.depth_to_water(z, res)),
    ]
    out = None
    for names, make in parts:
        own = [n for n in names if n in products]
        if own:
            part = make().select("col", "row", *own)
            out = part if out is None else out.join(part, ["col", "row"], "full")
    return out


def crown_points(points: DataFrame, crown: DataFrame, res: float, ymax: float, xmin: float, key: str, least_height: float = 2.0) -> DataFrame:
    """points of least_height and more with the tree whose crown's cells hold them, else the tree with the nearest centre."""
    at = points.where(F.col("h") >= least_height).withColumns({"col": F.floor((F.col("x") - xmin) / res).cast("int"), "row": F.floor((F.lit(ymax) - F.col("y")) / res).cast("int")})
    got = at.join(crown, ["col", "row"], "left").drop("col", "row")
    centre = crown.groupBy("tree").agg(F.avg(xmin + (F.col("col") + 0.5) * res).alias("cx"), F.avg(F.lit(ymax) - (F.col("row") + 0.5) * res).alias("cy")).withColumnRenamed("tree", "crown_id")
    rest = crowns.nearest_crown(got.where("tree is null"), centre, 8 * res, key).withColumnRenamed("crown_id", "near")
    return got.join(rest, key, "left").withColumn("tree", F.coalesce("tree", "near")).drop("near")


def change_of(rasters: DataFrame, res: float, mode: str = "pairwise", baseline: int = 0, threshold: float = 0.0, sigma1: float | None = None, sigma2: float | None = None, limit_mode: str = "threshold_only") -> tuple[DataFrame, DataFrame]:
    """(cells, summary) of change between the epochs of (epoch, col, row, v)."""
    limit = change.detection_limit(threshold, sigma1, sigma2, limit_mode)
    found = change.change(rasters, change.pairs(rasters, mode, baseline), limit)
    return found, change.summary(found, res * res)


def from_las(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The points of LAS files with a unique key of their file and place."""
    if not las.read_headers(spark, path, recursive).take(1):
        raise FileNotFoundError(f"no LAS points under {path}")
    return las.read_points(spark, path, recursive).withColumn("point_id", F.struct("path", "ordinal"))
