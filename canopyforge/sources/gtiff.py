"""Single-band GeoTIFF rasters as DataFrames (path, col, row, value), and back.

Read are strips or tiles, uncompressed or deflated, of 8 to 64-bit numbers, either byte order; written are deflated strips.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Sizes of TIFF field types and the tags that are used.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
#: Columns that say where a raster lies.
PLACE = ("xmin", "ymax", "res", "res_y", "width", "height")


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """The band, nodata as NaN in rasters of decimals, and xmin, ymax, res, nodata."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple | bytes] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = TYPE_SIZES.get(kind, 1) * n
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        tags[tag] = bytes(data[place : place + size]) if kind in (2, 7) else struct.unpack_from(order + f"{n}{TYPE_CODES[kind]}", data, place) if kind in TYPE_CODES else ()
    w, h, bits = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BITS, (8,))[0]
    if tags.get(SAMPLES, (1,))[0] != 1 or tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError("only one band is read, uncompressed or deflated")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(bits // 8))
    tiled = TILE_W in tags
    bw, bh = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (w, tags.get(ROWS_PER_STRIP, (h,))[0])
    out = np.zeros((h, w), kind.newbyteorder("="))
    across = -(-w // bw)
    for i, (place, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
        raw = bytes(data[place : place + size])
        raw = raw if tags.get(COMPRESSION, (1,))[0] == 1 else zlib.decompress(raw)
        r, c = i // across * bh, i % across * bw
        block = np.frombuffer(raw, kind, len(raw) // kind.itemsize).reshape(-1, bw)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, 1, dtype=block.dtype)
        out[r : r + bh, c : c + bw] = block[: h - r, : w - c]
    nodata = float(tags[NODATA].rstrip(b"\0").decode() or "nan") if NODATA in tags else None
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIEPOINT, (0.0,) * 6)
    if out.dtype.kind == "f" and nodata is not None:
        out[out == nodata] = np.nan
    return out, {"xmin": tie[3] - tie[0] * scale[0], "ymax": tie[4] + tie[1] * scale[1], "res": scale[0], "res_y": scale[1], "nodata": nodata, "width": w, "height": h}


def encode(band: np.ndarray, xmin: float, ymax: float, res: float, nodata: float | None = None, strip: int = 64, res_y: float | None = None) -> bytes:
    """A deflated, north-up GeoTIFF of one band of 32-bit decimals or whole numbers; cells are square unless res_y is given."""
    band = np.ascontiguousarray(band, "<f4" if band.dtype.kind == "f" else "<i4")
    h, w = band.shape
    strips = [zlib.compress(band[r : r + strip].tobytes()) for r in range(0, h, strip)]
    nodata = float("nan") if nodata is None and band.dtype.kind == "f" else nodata
    tags: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (32,)), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (OFFSETS, 4, (0,) * len(strips)), (SAMPLES, 3, (1,)),
        (ROWS_PER_STRIP, 4, (strip,)), (COUNTS, 4, tuple(map(len, strips))), (FORMAT, 3, (3 if band.dtype.kind == "f" else 2,)),
        (PIXEL_SCALE, 12, (res, res_y or res, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, xmin, ymax, 0.0)), (34735, 3, (1, 1, 0, 1, 1025, 0, 1, 1)),
    ]
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:g}".encode() + b"\0"))
    fixed = 8 + 2 + 12 * len(tags) + 4
    sizes = [len(v) if k == 2 else TYPE_SIZES[k] * len(v) for _, k, v in tags]
    places, at = [], fixed
    for s in sizes:
        places.append(at if s > 4 else 0)
        at += s + s % 2 if s > 4 else 0
    starts = np.cumsum([at, *map(len, strips)])[:-1].tolist()
    tags = [(t, k, tuple(starts)) if t == OFFSETS else (t, k, v) for t, k, v in tags]
    entries, body = b"", b""
    for (t, k, v), s, place in zip(tags, sizes, places, strict=True):
        raw = v if k == 2 else struct.pack(f"<{len(v)}{TYPE_CODES[k]}", *v)
        entries += struct.pack("<HHI", t, k, len(v)) + (struct.pack("<I", place) if s > 4 else raw.ljust(4, b"\0"))
        body += (raw + b"\0" * (s % 2)) if s > 4 else b""
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + body + b"".join(strips)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, col, row, value, xmin, ymax, res, res_y, width, height) of the cells that have a value, of all TIFF files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, g = decode(batch.column(1)[i].as_py())
                a = a.astype(np.float64)
                if g["nodata"] is not None:
                    a[a == g["nodata"]] = np.nan
                r, c = np.nonzero(np.isfinite(a))
                for at in range(0, len(r), 500_000):
                    rr, cc = r[at : at + 500_000], c[at : at + 500_000]
                    n = len(rr)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n), pa.array(cc.astype(np.int32)), pa.array(rr.astype(np.int32)), pa.array(a[rr, cc]), *(pa.array(np.full(n, float(g[k]))) for k in PLACE[:4]), *(pa.array(np.full(n, g[k], np.int32)) for k in PLACE[4:])], ["path", "col", "row", "value", *PLACE])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][iI][fF]*").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, col int, row int, value double, xmin double, ymax double, res double, res_y double, width int, height int")


def _put(folder: str, name: str, data: bytes) -> None:
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(folder, name))


def _band(t: pa.Table, shape: tuple[int, int], whole_numbers: bool, c0: int = 0, r0: int = 0) -> np.ndarray:
    a = np.zeros(shape, np.int32) if whole_numbers else np.full(shape, np.nan, np.float32)
    a[t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0] = t.column("value").to_numpy()
    return a


def write(cells: DataFrame, folder: str, by: str, xmin: float, ymax: float, res: float, whole_numbers: bool = False) -> DataFrame:
    """Writes one raster for each value of `by` (col, row, value) into a folder that all executors share; returns (name, cells)."""

    def run(key, t):
        c, r = t.column("col").to_numpy(), t.column("row").to_numpy()
        a = _band(t, (np.ptp(r) + 1, np.ptp(c) + 1), whole_numbers, c.min(), r.min())
        name = f"{key[0].as_py()}.tif"
        _put(folder, name, encode(a, xmin + int(c.min()) * res, ymax - int(r.min()) * res, res, 0 if whole_numbers else None))
        return pa.table({"name": [name], "cells": [t.num_rows]})

    return cells.groupBy(by).applyInArrow(run, "name string, cells long")


def write_placed(rasters: DataFrame, folder: str) -> DataFrame:
    """Writes rasters (name, col, row, value and the columns of PLACE) whole, each where it lies; returns (name, cells)."""

    def run(key, t):
        place = {k: t.column(k)[0].as_py() for k in PLACE}
        a = _band(t, (place["height"], place["width"]), False)
        _put(folder, f"{key[0].as_py()}.tif", encode(a, place["xmin"], place["ymax"], place["res"], res_y=place["res_y"]))
        return pa.table({"name": [f"{key[0].as_py()}.tif"], "cells": [t.num_rows]})

    return rasters.groupBy("name").applyInArrow(run, "name string, cells long")
