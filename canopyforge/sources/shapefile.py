"""Shapefiles of polygons or points with attributes, as tables (path, i, kind, rings, properties), and back.

Rings are as in GeoJSON: outer ones anticlockwise, holes clockwise; the files hold them the other way round, and points as one ring
of one place. Read are types 1 and 5; a file's attributes lie in the .dbf beside it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: file code, version, shape types, the greatest size of a file, a field's width in the .dbf.
CODE, VERSION, POINT, POLYGON, MOST_BYTES, WIDTH = 9994, 1000, 1, 5, (1 << 31) - 1, 254
RINGS = "array<array<struct<x:double,y:double>>>"

Ring = list[tuple[float, float]]


def _shape(rings: list[Ring], polygon: bool) -> bytes:
    if not rings:
        return struct.pack("<i", 0)
    if not polygon:
        return struct.pack("<i2d", POINT, *rings[0][0])
    xy = np.array([q for ring in rings for q in ring[::-1]], "<f8")
    starts = np.cumsum([0, *map(len, rings[:-1])])
    head = struct.pack("<i4d2i", POLYGON, *xy.min(0), *xy.max(0), len(rings), len(xy))
    return head + starts.astype("<i4").tobytes() + xy.tobytes()


def encode(shapes: list[list[Ring]], polygon: bool = True) -> tuple[bytes, bytes]:
    """The .shp and the .shx of the shapes."""
    bodies = [_shape(s, polygon) for s in shapes]
    places = np.array([q for s in shapes for ring in s for q in ring]).reshape(-1, 2)
    box = (*places.min(0), *places.max(0)) if len(places) else (0.0,) * 4
    whole = 100 + sum(8 + len(b) for b in bodies)
    if whole > MOST_BYTES:
        raise ValueError(f"a shapefile holds at most {MOST_BYTES} bytes; deal the features to more files")

    def head(size: int) -> bytes:
        return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, POLYGON if polygon else POINT, *box, 0, 0, 0, 0)

    shp, shx, at = [head(whole)], [head(100 + 8 * len(bodies))], 100
    for i, b in enumerate(bodies):
        shp += [struct.pack(">2i", i + 1, len(b) // 2), b]
        shx.append(struct.pack(">2i", at // 2, len(b) // 2))
        at += 8 + len(b)
    return b"".join(shp), b"".join(shx)


def _text(v: object) -> bytes:
    return b"" if v is None else (repr(v) if isinstance(v, float) else str(v)).encode()


def encode_table(columns: dict[str, list]) -> bytes:
    """The .dbf of the columns: numbers as such, everything else as text; names are cut to ten characters and must then differ."""
    names = [n.encode()[:10].decode(errors="ignore") for n in columns]
    if len(set(names)) < len(names):
        raise ValueError(f"the first ten characters of the columns {list(columns)} must differ")
    fields, cells = [], []
    for name, values in zip(names, columns.values(), strict=True):
        number = all(v is None or (isinstance(v, (int, float)) and not isinstance(v, bool)) for v in values)
        decimal = number and any(isinstance(v, float) for v in values)
        texts = [_text(v) for v in values]
        width = max(1, *map(len, texts))
        if width > WIDTH:
            raise ValueError(f"a text of {name} has more than {WIDTH} bytes")
        fields.append(struct.pack("<11sc4xBB14x", name.encode(), b"N" if number else b"C", width, 15 if decimal else 0))
        cells.append([t.rjust(width) if number else t.ljust(width) for t in texts])
    n = len(cells[0]) if cells else 0
    size = 1 + sum(len(c[0]) for c in cells) if n else 1
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 32 + 32 * len(fields) + 1, size)
    return head + b"".join(fields) + b"\r" + b"".join(b" " + b"".join(row) for row in zip(*cells)) + b"\x1a"


def decode(data: bytes) -> Iterator[tuple[str, list[Ring]]]:
    """The kind and rings of each record."""
    if struct.unpack_from(">i", data)[0] != CODE:
        raise ValueError("not a shapefile")
    at, end = 100, 2 * struct.unpack_from(">i", data, 24)[0]
    while at < end:
        size, kind = 2 * struct.unpack_from(">i", data, at + 4)[0], struct.unpack_from("<i", data, at + 8)[0]
        body = at + 12
        if kind == 0:
            yield "Null", []
        elif kind == POINT:
            yield "Point", [[struct.unpack_from("<2d", data, body)]]
        elif kind == POLYGON:
            parts, n = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), n]
            xy = np.frombuffer(data, "<f8", 2 * n, body + 40 + 4 * parts).reshape(-1, 2).tolist()
            yield "Polygon", [[tuple(q) for q in xy[a:b][::-1]] for a, b in zip(starts, starts[1:])]
        else:
            raise ValueError(f"shapes of type {kind} are not read")
        at += 8 + size


def decode_table(data: bytes) -> list[dict[str, str]]:
    """The records as text by field; empty fields are left out."""
    n, start, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    for at in range(32, start - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]))
    out = []
    for i in range(n):
        at, row = start + i * size + 1, {}
        for name, width in fields:
            if text := data[at : at + width].strip(b" \0").decode("utf-8", "replace"):
                row[name] = text
            at += width
        out.append(row)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, kind, rings, properties) of all features of the shapefiles under path; a file without a .dbf has no properties."""
    one = path.lower().endswith(".shp")
    folder, _, name = path.rpartition("/") if one else (path, "", "")
    pattern = f"{name[:-4]}.{{shp,dbf,SHP,DBF}}" if one else "*.{shp,dbf,SHP,DBF}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(not one).lower()).option("pathGlobFilter", pattern).load(folder)
    stem, ending = F.regexp_extract("path", r"^(.*)\.[^.]+$", 1), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    parts = files.select(stem.alias("stem"), ending.alias("ending"), "path", "content")
    shp, dbf = parts.where("ending = 'shp'"), parts.where("ending = 'dbf'").select("stem", F.col("content").alias("attributes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content, attributes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = decode_table(attributes) if attributes else []
                held: dict[str, list] = {"path": [], "i": [], "kind": [], "rings": [], "properties": []}
                for i, (kind, rings) in enumerate(decode(content)):
                    values = (p, i, kind, [[{"x": x, "y": y} for x, y in ring] for ring in rings], list((rows[i] if i < len(rows) else {}).items()))
                    for k, v in zip(held, values, strict=True):
                        held[k].append(v)
                    if len(held["i"]) >= 2000:
                        yield pa.RecordBatch.from_pydict(held, schema)
                        held = {k: [] for k in held}
                yield pa.RecordBatch.from_pydict(held, schema)

    place = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("path", pa.string()), ("i", pa.int32()), ("kind", pa.string()), ("rings", pa.list_(pa.list_(place))), ("properties", pa.map_(pa.string(), pa.string()))])
    joined = shp.join(dbf, "stem", "left").select("path", "content", "attributes")
    return joined.mapInArrow(run, f"path string, i int, kind string, rings {RINGS}, properties map<string,string>")


def write(features: DataFrame, folder: str, by: str, polygon: bool = True, crs_wkt: str | None = None) -> DataFrame:
    """Writes one shapefile for each value of `by` from (rings, any columns of attributes) into a folder that all executors share; returns
    (name, features). A file is one task's and at most 2 GB, the format's own bound. A table without features raises."""
    from .gtiff import _put

    if features.isEmpty():
        raise ValueError("there are no features to write")
    names = [c for c in features.columns if c not in (by, "rings")]

    def run(key, t):
        name = str(key[0].as_py())
        shapes = [[[(q["x"], q["y"]) for q in ring] for ring in rings or []] for rings in t.column("rings").to_pylist()]
        shp, shx = encode(shapes, polygon)
        files = {"shx": shx, "dbf": encode_table({n: t.column(n).to_pylist() for n in names}), "cpg": b"UTF-8"}
        if crs_wkt:
            files["prj"] = crs_wkt.encode()
        for ending, data in (files | {"shp": shp}).items():  # the .shp last: where it is, the others are
            _put(folder, f"{name}.{ending}", data)
        return pa.table({"name": [f"{name}.shp"], "features": [t.num_rows]})

    return features.groupBy(by).applyInArrow(run, "name string, features long")
