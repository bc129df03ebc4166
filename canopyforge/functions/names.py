"""Names: tokens that are safe in paths, labels of datasets, what a raster's name says, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_token(name: Column) -> Column:
    """All but letters, digits and _ become one _ a run."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_")


def sanitized(name: Column) -> Column:
    """All but letters, digits, _ - and . become _, and these are taken off the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_"), r"^[_.-]+|[_.-]+$", "")


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), r"\.[^.]*$", "")


def dataset_label(path: Column) -> Column:
    return safe_token(stem(path))


def pair_name(first: Column, second: Column) -> Column:
    return F.concat_ws("__to__", first, second)


def surface_of(path: Column) -> Column:
    """(kind, variant) that a raster's name gives away: `..._CHM_<variant>`, `..._DSM` or `..._DEM`; NULL if none."""
    low = F.lower(stem(path))
    kind = F.upper(F.regexp_extract(low, r"(?:^|_)(chm|dsm|dem)(?:_|$)", 1))
    return F.when(kind != "", F.struct(kind.alias("kind"), F.nullif(F.regexp_extract(low, r"(?:^|_)chm_(.+)$", 1), F.lit("")).alias("variant")))


def duration(seconds: Column) -> Column:
    """12.3s below a minute, else mm:ss, else hh:mm:ss."""
    s = F.floor(seconds).cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    minutes, hours = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return F.when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit("s"))).when(seconds < 3600, F.concat_ws(":", two(minutes), two(s % 60))).otherwise(F.concat_ws(":", two(hours), two(minutes % 60), two(s % 60)))
