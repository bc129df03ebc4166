"""GeoJSON and shapefile features, manifests and summaries as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shapefile

FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(crown_id, ring, area, xmin, ymin, xmax, ymax, cx, cy) of the polygons' outer rings; the id is crown_id, else tree_id, else the
    place in the file. path: of GeoJSON, or of a shapefile if it ends so."""
    if path.lower().endswith(".shp"):
        p = shapefile.read(spark, path).where("kind = 'Polygon'").select("i", F.col("properties").alias("p"), F.col("rings")[0].alias("ring"))
    else:
        text = spark.read.text(path, wholetext=True)
        f = text.select(F.posexplode(F.from_json("value", FEATURES)["features"]).alias("i", "f"))
        rings = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
        p = f.where(F.col("f.geometry.type") == "Polygon").select("i", F.col("f.properties").alias("p"), F.transform(rings[0], lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))).alias("ring"))
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    area = F.abs(F.aggregate(F.arrays_zip(F.col("ring").alias("a"), after.alias("b")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2
    xs, ys = F.transform("ring", lambda q: q["x"]), F.transform("ring", lambda q: q["y"])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, q: s + q) / F.size(v)
    ident = F.coalesce(F.try_element_at("p", F.lit("crown_id")), F.try_element_at("p", F.lit("tree_id"))).cast("int")
    return p.select(F.coalesce(ident, F.col("i") + 1).alias("crown_id"), "ring", area.alias("area"), F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"), mean(xs).alias("cx"), mean(ys).alias("cy"))


def write_collection(features: DataFrame, path: str) -> None:
    """features (value: a GeoJSON feature) as feature collections, one a file, as many as partitions have features."""

    def whole(batches):
        import pyarrow as pa

        held = [x for b in batches for x in b.column(0).to_pylist()]
        if held:
            yield pa.RecordBatch.from_pydict({"value": ['{"type":"FeatureCollection","features":[' + ",".join(held) + "]}"]})

    features.select("value").mapInArrow(whole, "value string").write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """features (value: a GeoJSON feature) as newline-delimited GeoJSON, which any number of tasks can write."""
    features.write.mode("overwrite").text(path)


def write_manifest(tiles: DataFrame, path: str) -> None:
    tiles.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", "true").csv(path)
