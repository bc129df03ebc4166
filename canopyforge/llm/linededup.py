"""Line deduplication with two Bloom filters.

The first filter holds the hashes of lines seen once, the second those seen again: an insert whose bits the first already has
goes to the second. Each task fills its own pair over distinct (document, line) and sends them by slab, as compressed bits;
merged slabs add to the second filter what both sides' first ones have, so that a line in two documents is always in it.
Only lines that the second filter knows are shuffled, as digests, for exact confirmation and the choice of the least doc_id.

The filters' size follows the number of lines up to `MOST_BITS`, which bounds what is broadcast; beyond it more lines are
suspected and shuffled, and the result stays the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, column_lists, cut, forget, read

LEAST_CHARS = 10
#: Tasks whose slabs are merged by one group at each level of the tree; the last level merges what is left.
MERGED = (64, 64 * 64)
BLANKS = " \t\n\r\x0b\x0c"
#: Bits of a slab, bits for each line, probes of a line, most bits of one filter (64 MB).
SLAB, PER_LINE, PROBES, MOST_BITS = 1 << 20, 16, 4, 1 << 29


def line_key(line: str) -> bytes | None:
    """What lines are compared by, or None for lines too short to be compared."""
    key = line.strip(BLANKS)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= LEAST_CHARS else None


def _probes(hashes: np.ndarray, slabs: int) -> tuple[np.ndarray, np.ndarray]:
    """Slab and bit positions in it, one column for each probe."""
    slab = hashes % np.uint64(slabs)
    mixed = (hashes // np.uint64(slabs)) * np.uint64(0x9E3779B97F4A7C15)
    a, b = mixed >> np.uint64(44), (mixed >> np.uint64(20)) | np.uint64(1)
    return slab.astype(np.int64), np.stack([(a + np.uint64(i) * b) & np.uint64(SLAB - 1) for i in range(PROBES)], 1).astype(np.int64)


def _document_hashes(text: str | None) -> set[int]:
    return {xxhash.xxh3_64_intdigest(k) for x in (text or "").split("\n") if (k := line_key(x)) is not None}


def _fill(slabs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task = TaskContext.get().partitionId()
        known: list[np.ndarray] = []
        for (texts,) in column_lists(batches, "text"):
            for t in texts:
                h = _document_hashes(t)
                known.append(np.fromiter(h, np.uint64, len(h)))
        if not known:
            return
        hashes, counts = np.unique(np.concatenate(known), return_counts=True)
        del known
        slab, probes = _probes(hashes, slabs)
        order = np.argsort(slab, kind="stable")
        slab, probes, counts = slab[order], probes[order], counts[order]
        edges = np.searchsorted(slab, np.arange(slabs + 1))
        for s in range(slabs):
            part = slice(edges[s], edges[s + 1])
            if edges[s] == edges[s + 1]:
                continue
            bits = [np.zeros(SLAB, bool), np.zeros(SLAB, bool)]
            bits[0][probes[part].ravel()] = True
            bits[1][probes[part][counts[part] > 1].ravel()] = True
            once, twice = (zlib.compress(np.packbits(x).tobytes(), 1) for x in bits)
            yield pa.RecordBatch.from_pydict({"slab": [s], "salt": [task], "once": [once], "twice": [twice]}, pa.schema([("slab", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The slabs of one group: the first filters joined, and what any two of them or a second one has."""
    once, twice = np.zeros(SLAB // 8, np.uint8), np.zeros(SLAB // 8, np.uint8)
    for a, b in zip(table.column("once"), table.column("twice"), strict=True):
        a, b = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
        twice |= b | (once & a)
        once |= a
    out = {"slab": [table.column("slab")[0].as_py()], "salt": [table.column("salt")[0].as_py()], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]}
    return pa.table(out, schema=pa.schema([("slab", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


_SLABS = "slab int, salt int, once binary, twice binary"


def twice_seen(documents: DataFrame) -> dict[int, bytes]:
    """The second filter over all lines, by slab; at most MOST_BITS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = documents.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = SLAB
    while bits < min(PER_LINE * lines, MOST_BITS):
        bits *= 2
    filled = documents.select(F.col("text").cast("string")).mapInArrow(_fill(bits // SLAB), _SLABS)
    merged = filled
    for tasks in MERGED:  # a tree: no group has more than so many tasks' slabs
        merged = merged.groupBy("slab", F.floor(F.col("salt") / tasks).alias("group")).applyInArrow(_merge, _SLABS)
    merged = merged.groupBy("slab").applyInArrow(_merge, _SLABS)
    return {"slabs": bits // SLAB} | {r.slab: bytes(r.twice) for r in merged.select("slab", "twice").collect()}


def _suspects(twice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = twice.value
        slabs = held["slabs"]
        bits = np.zeros((slabs, SLAB // 8), np.uint8)
        for s, x in held.items():
            if s != "slabs":
                bits[s] = np.frombuffer(zlib.decompress(x), np.uint8)
        for ids, texts, rows in column_lists(batches, "doc_id", "text", "row", rows=500):
            keys, owner, row = [], [], []
            for i, t, r in zip(ids, texts, rows, strict=True):
                found = {k for x in (t or "").split("\n") if (k := line_key(x)) is not None}
                keys += found
                owner += [i] * len(found)
                row += [r] * len(found)
            if not keys:
                continue
            slab, probes = _probes(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), slabs)
            seen = ((bits[slab[:, None], probes >> 3] >> (7 - (probes & 7)).astype(np.uint8)) & 1).all(1)
            at = np.nonzero(seen)[0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(keys[i]).digest() for i in at], pa.binary()), pa.array([owner[i] for i in at], pa.int64()), pa.array([row[i] for i in at], pa.int64())], ["line", "doc_id", "row"])

    return run


def _drop(texts: list[str | None], drops: list[list[bytes] | None]) -> list[pa.Array]:
    kept, n_lines, n_dropped = [], [], []
    for t, d in zip(texts, drops, strict=True):
        lines = (t or "").split("\n")
        left = lines
        if d:
            gone = set(d)
            left = [x for x in lines if (k := line_key(x)) is None or hashlib.sha256(k).digest() not in gone]
        kept.append("\n".join(left))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
    return [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]


def drop_repeated_lines(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of documents (doc_id, text): kept (its text without lines that a document of smaller doc_id also has),
    n_lines, n_dropped, and after doc_id the columns named in keep.

    Lines are compared without ASCII white space at the ends and without case of A-Z; those of under 10 characters stay.
    A null or empty text is one empty line. Rows with one doc_id are one document: each keeps what the document keeps. A null
    doc_id counts as a document larger than all others. All lines of a document may go; its kept text is then empty. An
    empty table gives no rows.
    """
    spark = documents.sparkSession
    # rows without an id are told apart by their texts, so that they are no one group
    row = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.alias("row"))
    twice = spark.sparkContext.broadcast(twice_seen(docs))
    suspects = cut(docs.mapInArrow(_suspects(twice), "line binary, doc_id long, row long"), "suspected-lines")
    repeated = suspects.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    # written, so that the join below deals both sides anew and can split a line that very many documents have
    repeated = cut(repeated.where("first < last or (unnamed and first is not null)").select("line", "first"), "repeated-lines")
    drops = suspects.join(repeated, "line").where("doc_id is null or doc_id > first").groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))
    rows = documents.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"), row.alias("_row"))
    rows = rows.join(drops.select(F.col("doc_id").alias("_of"), F.col("row").alias("_of_row"), F.col("lines").alias("_lines")), F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_of_row")), "left").drop("_of", "_of_row", "_row")
    return annotate(rows, ["_text", "_lines"], {"kept": "string", "n_lines": "long", "n_dropped": "long"}, _drop).drop("_text", "_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select rid, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select rid, doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line
        from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
repeated as (select key, min(doc_id) as first from lines where length(key) >= 10 group by key having count(distinct doc_id) + max((doc_id is null)::int) > 1),
marked as (select l.*, r.key is not null and (doc_id is null or doc_id > first) as gone from lines l left join repeated r using (key))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by rid
"""
