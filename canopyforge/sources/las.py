"""LAS point files (uncompressed, versions 1.0-1.4, point formats 0-10) as DataFrames, and back.

Files are read by Spark's own binaryFile reader, so that they can be in any store, and decoded where they are read; a header
scan reads no points into rows. A point's id is its file and its place in it, which are the same in every run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The LAS specification's record layouts.
SHORT = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("cls", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("source_id", "<u2")]
LONG = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("cls", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("source_id", "<u2"), ("gps_time", "<f8")]
SIZES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}

POINTS = "path string, ordinal long, x double, y double, z double, intensity int, classification int, return_number int, number_of_returns int"
HEADERS = "path string, version string, point_format int, points long, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, scale array<double>, offset array<double>, crs_wkt string, compressed boolean"


def header(data: bytes) -> dict:
    """The header of a LAS or LAZ file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    size, start, n_vlr = struct.unpack_from("<HII", data, 94)
    kind, length, points = struct.unpack_from("<BHI", data, 104)
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", data, 179)
    if minor >= 4 and size >= 375:
        points = struct.unpack_from("<Q", data, 247)[0] or points
    out = {"version": f"{major}.{minor}", "point_format": kind & 0x3F, "compressed": bool(kind & 0xC0), "length": length, "start": start, "points": points, "scale": list(scale), "offset": list(offset), "bounds": (xmin, ymin, zmin, xmax, ymax, zmax), "crs_wkt": None, "extra": []}
    at = size
    for _ in range(n_vlr):
        user, record, n = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", data, at + 18)
        body = data[at + 54 : at + 54 + n]
        if user == b"LASF_Projection" and record == 2112:
            out["crs_wkt"] = body.rstrip(b"\0").decode("utf-8", "replace")
        elif user == b"LASF_Spec" and record == 4:
            out["extra"] = [(body[i + 4 : i + 36].rstrip(b"\0").decode(), EXTRA_TYPES[body[i + 2]]) for i in range(0, n - 191, 192) if body[i + 2] in EXTRA_TYPES]
        at += 54 + n
    return out


def records(data: bytes, head: dict) -> np.ndarray:
    """The points of a file as one structured array, without a copy."""
    if head["compressed"]:
        raise ValueError("LAZ files need a decoder that isn't installed; decompress them to LAS")
    fields = list(LONG if head["point_format"] >= 6 else SHORT)
    known = SIZES[head["point_format"]]
    used = sum(np.dtype(t).itemsize for _, t in fields)
    kind = np.dtype([*fields, ("rest", f"V{known - used}")] if known > used else fields)
    extra = head["extra"] if sum(np.dtype(t).itemsize for _, t in head["extra"]) <= head["length"] - known else []
    spare = head["length"] - known - sum(np.dtype(t).itemsize for _, t in extra)
    kind = np.dtype([*((n, kind.fields[n][0]) for n in kind.names), *extra, *([("spare", f"V{spare}")] if spare else [])])
    return np.frombuffer(data, kind, head["points"], head["start"])


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[lL][aA][sSzZ]").load(path)


def read_points(spark: SparkSession, path: str, recursive: bool = True, extra: str = "") -> DataFrame:
    """The points of all LAS files under path; extra: further columns, `name type, ...`, of extra bytes."""
    names = [e.split()[0] for e in extra.split(",") if e.strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                head = header(memoryview(data).tobytes()[:400_000] if len(data) < 400_000 else bytes(memoryview(data)[:400_000]))
                rows = records(data, head)
                for at in range(0, len(rows), 200_000):
                    r = rows[at : at + 200_000]
                    (sx, sy, sz), (ox, oy, oz) = head["scale"], head["offset"]
                    long = head["point_format"] >= 6
                    cols = [pa.array([path] * len(r)), np.arange(at, at + len(r)), r["X"] * sx + ox, r["Y"] * sy + oy, r["Z"] * sz + oz, r["intensity"].astype(np.int32), (r["cls"] if long else r["cls"] & 31).astype(np.int32), (r["bits"] & (15 if long else 7)).astype(np.int32), ((r["bits"] >> 4) if long else (r["bits"] >> 3) & 7).astype(np.int32)]
                    cols += [r[n].astype(np.float64 if r[n].dtype.kind == "f" else np.int64) if n in (r.dtype.names or ()) else pa.nulls(len(r), pa.int64()) for n in names]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in cols], ["path", "ordinal", "x", "y", "z", "intensity", "classification", "return_number", "number_of_returns", *names])

    return _files(spark, path, recursive).select("path", "content").mapInArrow(run, POINTS + (f", {extra}" if extra else ""))


def read_headers(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row a file: what its header says. Files without points are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = header(batch.column(1)[i].as_py())
                names = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
                row = {"path": batch.column(0)[i].as_py(), "version": h["version"], "point_format": h["point_format"], "points": h["points"], **dict(zip(names, h["bounds"], strict=True)), "scale": h["scale"], "offset": h["offset"], "crs_wkt": h["crs_wkt"], "compressed": h["compressed"]}
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 6, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    # headers and their variable records come before the points: what is read of a file is its first part
    return _files(spark, path, recursive).select("path", F.substring("content", 1, 400_000).alias("content")).mapInArrow(run, HEADERS).where("points > 0")


def to_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray | None = None, returns: tuple[np.ndarray, np.ndarray] | None = None, extra: dict[str, np.ndarray] | None = None, scale: float = 0.001, crs_wkt: str | None = None) -> bytes:
    """A LAS 1.4 file of point format 6; coordinates are rounded half to even at scale. extra: whole numbers, kept as 32 bits."""
    n, extra = len(x), extra or {}
    offset = [float(np.floor(v.min())) if n else 0.0 for v in (x, y, z)]
    kind = np.dtype([*LONG, *((k, "<u4") for k in extra)])
    r = np.zeros(n, kind)
    for name, v, o in zip("XYZ", (x, y, z), offset, strict=True):
        r[name] = np.rint((v - o) / scale).astype(np.int64)
    r["cls"] = 0 if classification is None else classification
    first, of = returns if returns is not None else (np.ones(n, int), np.ones(n, int))
    r["bits"] = (np.asarray(first) & 15) | ((np.asarray(of) & 15) << 4)
    for k, v in extra.items():
        r[k] = v
    records_ = []
    if extra:
        records_.append((b"LASF_Spec", 4, b"".join(struct.pack("<2xBB32s156x", 5, 0, k.encode()[:32]) for k in extra)))
    if crs_wkt:
        records_.append((b"LASF_Projection", 2112, crs_wkt.encode() + b"\0"))
    vlrs = b"".join(struct.pack("<H16sHH32s", 0, user, record, len(body), b"") + body for user, record, body in records_)
    ends = [b(v) if n else 0.0 for v in (x, y, z) for b in (np.max, np.min)]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI20s3d3d6d", b"LASF", 0, 16 if crs_wkt else 0, 0, 0, 0, b"", 1, 4, b"", b"", 1, 1, 375, 375 + len(vlrs), len(records_), 6, kind.itemsize, 0, b"", scale, scale, scale, *offset, *ends)
    return head + struct.pack("<QQIQ15Q", 0, 0, 0, n, *[0] * 15) + vlrs + r.tobytes()


def write_points(points: DataFrame, folder: str, by: str, extra: tuple[str, ...] = (), scale: float = 0.001) -> DataFrame:
    """Writes one LAS file for each value of `by` into a folder that all executors share, and returns (name, points). Each file
    appears whole under its name or not at all, so that a task that runs again does no harm. A file's points are one group."""
    import os
    import uuid

    def run(key, t):
        col = {c: t.column(c).to_numpy() for c in t.column_names if c != by}
        data = to_bytes(col["x"], col["y"], col["z"], col.get("classification"), (col["return_number"], col["number_of_returns"]) if "number_of_returns" in col else None, {e: col[e] for e in extra}, scale)
        name = f"{key[0].as_py()}.las"
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, os.path.join(folder, name))
        return pa.table({"name": [name], "points": [t.num_rows]})

    return points.groupBy(by).applyInArrow(run, "name string, points long")
