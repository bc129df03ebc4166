"""Command line: python -m canopyforge.plans.cli IN OUT --sensor ALS --products DEM CHM."""

from __future__ import annotations

import argparse

from canopyforge.functions.sensors import SENSORS

from canopyforge.sources import layout

from . import workflow


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="canopyforge", description="Products of LiDAR point clouds, made with Spark.")
    p.add_argument("source", help="a LAS file or a folder of them")
    p.add_argument("target", help="where a table for each product is written")
    p.add_argument("--sensor", choices=sorted(SENSORS), default="ALS")
    p.add_argument("--products", nargs="+", default=["all"])
    p.add_argument("--res", type=float, default=0.5)
    p.add_argument("--canopy", default="", help="for example pitfree, p99:smooth=median, band:p2r:low=2:high=10")
    p.add_argument("--dem", choices=["min", "max", "mean", "nearest", "tin", "idw"], default="min")
    p.add_argument("--dsm", choices=["min", "max", "mean", "nearest", "tin", "idw", "spikefree"], default="max")
    p.add_argument("--itd", choices=["lmf", "watershed", "yun2021"], default="watershed")
    p.add_argument("--fix", action="store_true", help="remove false ground after classification")
    p.add_argument("--adaptive", action="store_true", help="let settings follow the cloud's density")
    p.add_argument("--files", action="store_true", help="write LAS and GeoTIFF files beside the tables")
    p.add_argument("--from-classified", action="store_true", help="the source is classified; only DEM and NORMALIZED are derived")
    p.add_argument("--not-recursive", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(argv)
    workflow.resolve(a.products)
    spark = SparkSession.builder.appName("canopyforge").getOrCreate()
    points = workflow.from_las(spark, a.source, not a.not_recursive)
    if a.from_classified:
        made = workflow.derive(spark, points, ["DEM", "NORMALIZED"] if a.products == ["all"] else a.products, a.res, a.dem)
    else:
        made = workflow.run(spark, points.drop("classification"), a.sensor, a.products, a.res, a.canopy, a.fix, a.dem, a.dsm, a.itd, adaptive=a.adaptive)
    settings = {k: v for k, v in vars(a).items() if k not in ("target", "overwrite", "files", "products")}
    workflow.save(spark, made, points, layout.output_root(a.source, a.target, a.sensor), a.res, settings, a.overwrite, a.files)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
