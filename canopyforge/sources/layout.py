"""Where products lie, and how inputs are found among them: folders by product and variant, tiles by name, manifests, skipping."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyforge.functions.names import dataset_label, stem

MANIFEST = "tile_manifest.json"
#: File endings of a product's tiles.
ENDINGS = {"CLASSIFIED": "las", "NORMALIZED": "las", "TREECLOUDS": "las", "DEM": "tif", "DSM": "tif", "CHM": "tif", "TERRAIN": "tif", "STRUCTURE": "tif", "CHANGE": "tif"}
#: Products whose tiles lie in a folder for each variant: canopy methods, terrain products, metrics.
WITH_VARIANTS = ("CHM", "TERRAIN", "STRUCTURE", "ITD")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in path, in order; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def files(spark: SparkSession, path: str, ending: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, stem, label, length, modified) of the files under path, listed without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", ending).load(path)
    return found.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), stem(F.col("path")).alias("stem"), dataset_label(F.col("path")).alias("label"), "length", F.col("modificationTime").alias("modified"))


def output_root(source: str, target: str, sensor: str) -> str:
    """A file's results lie beside it in `target`, a folder's in `Processed_<SENSOR>` in it; a target with a slash is taken as it is."""
    if "/" in target:
        return target.rstrip("/")
    parent, _, last = source.rstrip("/").rpartition("/")
    return f"{parent}/{target}" if "." in last else f"{source.rstrip('/')}/Processed_{sensor.upper()}"


def workspace(source: str, sensor: str) -> str:
    """Where tiles of a source are kept: `<SENSOR>_tiles` beside a file or in a folder."""
    parent, _, last = source.rstrip("/").rpartition("/")
    return f"{parent if '.' in last else source.rstrip('/')}/{sensor.upper()}_tiles"


def product_folder(root: str, product: str, variant: str = "") -> str:
    if variant and product not in WITH_VARIANTS:
        raise ValueError(f"{product} has no variants")
    return f"{root}/{product.lower()}" + (f"/{variant}" if variant else "")


def expected_tile(root: str, product: str, tile: str, variant: str = "") -> str:
    """Where a product's tile is written."""
    if product not in ENDINGS:
        raise ValueError(f"{product} has no tiles")
    return f"{product_folder(root, product, variant)}/{tile}.{ENDINGS[product]}"


def variants(spark: SparkSession, root: str, product: str) -> list[str]:
    """A product's variants that are there: its folders."""
    return folders(spark, product_folder(root, product))


def one_variant(found: list[str], wanted: str = "") -> str:
    """The variant that is wanted, or the only one; several without a wish, or none, raise."""
    if wanted:
        if wanted not in found:
            raise FileNotFoundError(f"no variant {wanted!r}; there are {found}")
        return wanted
    if len(found) != 1:
        raise FileNotFoundError(f"name one of the variants {found}" if found else "there are no variants")
    return found[0]


def surface_input(spark: SparkSession, root: str, variant: str = "", first: bool = False) -> str:
    """The raster folder that trees are sought in: root itself if it holds rasters, a canopy variant (with first, the first in order where
    none is named), else the surface model."""
    if root.lower().endswith((".tif", ".tiff")) or (not folders(spark, root) and exists(spark, root)):
        return root
    found = variants(spark, root, "CHM")
    if found:
        return product_folder(root, "CHM", found[0] if first and not variant else one_variant(found, variant))
    if exists(spark, path := product_folder(root, "DSM")):
        return path
    raise FileNotFoundError(f"no canopy or surface raster under {root}")


def product_input(spark: SparkSession, root: str, product: str) -> str:
    """root, if it is the product's folder or holds files alone, else the product's folder in it."""
    path = product_folder(root, product)
    if root.rstrip("/").rsplit("/", 1)[-1].lower() == product.lower():
        return root
    if exists(spark, path):
        return path
    if exists(spark, root) and not folders(spark, root):
        return root
    raise FileNotFoundError(f"no {product.lower()} under {root}")


def change_groups(rasters: DataFrame, root: str) -> DataFrame:
    """files() of a processed root, or of a folder of rasters, with the group that each is compared in: the folders below root."""
    return rasters.withColumn("group", F.regexp_replace(F.regexp_extract("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/(.*?)/?[^/]+$", 1), "/", "_"))


def find_above(spark: SparkSession, path: str, name: str = MANIFEST) -> str | None:
    """The nearest file or folder of that name in path or a folder above it."""
    while path and not path.endswith(":"):
        if exists(spark, found := f"{path.rstrip('/')}/{name}"):
            return found
        path = path.rstrip("/").rpartition("/")[0]
    return None


def matched(tile_files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files() joined with the manifest's tiles by name, whatever folder they lie in."""
    return tile_files.join(manifest, tile_files["stem"] == manifest["tile"])


def crs_of(headers: DataFrame, sources: DataFrame, default: str | None = None) -> DataFrame:
    """(path, crs): a file's own reference system, else that of the first of its tile's sources that has one, else the default.

    headers: (path, crs_wkt, sources: array of paths); sources: (path, crs_wkt).
    """
    own = headers.select("path", "crs_wkt", F.posexplode_outer("sources").alias("i", "source"))
    there = sources.where("crs_wkt is not null").select(F.col("path").alias("source"), F.col("crs_wkt").alias("theirs"))
    first = F.min(F.when(F.col("theirs").isNotNull(), F.struct("i", "theirs")))
    got = own.join(there, "source", "left").groupBy("path").agg(F.max("crs_wkt").alias("own"), first.alias("first"))
    return got.select("path", F.coalesce("own", "first.theirs", F.lit(default)).alias("crs"))


def settings_digest(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def reusable(spark: SparkSession, path: str, settings: dict, overwrite: bool = False) -> bool:
    """Was what lies at path made whole, and with these settings? False with overwrite."""
    if overwrite or not exists(spark, f"{path}/_SUCCESS") or not exists(spark, f"{path}.settings"):
        return False
    return spark.read.text(f"{path}.settings").first()[0] == settings_digest(settings)


def keep(df: DataFrame, path: str, settings: dict, overwrite: bool = False) -> DataFrame:
    """df as a table at path: written, or read where it is there already with the same settings. Another one's table isn't
    overwritten unasked."""
    spark = df.sparkSession
    if not reusable(spark, path, settings, overwrite):
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        spark.createDataFrame([(settings_digest(settings),)], "digest string").coalesce(1).write.mode("overwrite").text(f"{path}.settings")
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a workspace of tiles: only a folder that is named as one."""
    if not path.rstrip("/").endswith("_tiles"):
        raise ValueError(f"{path} is not a workspace of tiles")
    fs, p = _fs(spark, path)
    fs.delete(p, True)
