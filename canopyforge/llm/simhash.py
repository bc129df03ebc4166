"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each. So every distinct fingerprint
stands for its variants within r bits (2,081 of 64 bits for r = 2), and equal variants link fingerprints. The shuffle is by a
variant's leading bits: a fingerprint is sent once to each prefix that its variants can have (37 of 8 bits), with the number
of flips that the prefix has used up, and the rest of each variant is made where it is compared. That is the same pairs of
variant and fingerprint, at a fiftieth of the bytes.

A prefix that too many fingerprints meet in, as a large group of near copies does, is split by further bits until it has
at most `MOST` of them; all 64 bits name one variant, whose ball has 2,081 fingerprints at most, so that this always ends.
Within a prefix, members of a variant are chained to one of them, verified by their distance, and joined by union-find;
what leaves is one link a fingerprint and prefix. Components over all links follow in `components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENTS_A_PART, annotate, cut, in_parts, read
from .components import components

#: Bits that one level of prefixes has, and the fingerprints that may meet in one prefix.
STEP, MOST = 8, 3000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles: a bit is 1 if over half of the shingles' XXH64 have it."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, only ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, digest, n = (ends - lengths).tolist(), xxhash.xxh64_digest, len(found) - words + 1
    ends, counts = ends.tolist(), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        upto = min(n, at + (1 << 16))
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at:upto], ends[at + words - 1 : upto + words - 1], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns named in keep, fp): fp is the fingerprint as a signed long. Texts are read whole, however long."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.fromiter((fingerprint(t, words, seed) for t in texts), np.uint64, len(texts)).view(np.int64))]

    rows = documents.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"))
    return annotate(rows, ["_text"], {"fp": "long"}, make, rows=2000).drop("_text")


def _flips(bits: int, n: int, low: int = 0) -> np.ndarray:
    """All masks with n of the bits low..low+bits-1."""
    return np.array([sum(1 << (low + i) for i in c) for c in combinations(range(bits), n)], np.uint64)


def _spread(rows: DataFrame, depth: int, radius: int) -> DataFrame:
    """Each (fp, first, used) to the prefixes of depth + STEP bits that its variants under its present prefix can have."""
    low = 64 - depth - STEP
    masks = [_flips(STEP, n, low) for n in range(min(radius, STEP) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                fp, first, used, prefix = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                fp, prefix = fp.view(np.uint64), prefix.view(np.uint64)
                # the bits above this level are the prefix's, those of it and below are the fingerprint's own
                own = (fp & np.uint64((1 << (64 - depth)) - 1)) | prefix
                out = []
                for n, m in enumerate(masks):
                    who = np.nonzero(used + n <= radius)[0]
                    at_prefix = (own[who][:, None] ^ m[None, :]) & np.uint64(((1 << (depth + STEP)) - 1) << low)
                    who = np.repeat(who, len(m))
                    out.append((fp[who].view(np.int64), first[who], (used[who] + n).astype(np.int32), at_prefix.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["fp", "first", "used", "prefix"])

    return rows.select("fp", "first", "used", "prefix").mapInArrow(run, "fp long, first long, used int, prefix long")


def _link(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]


def _meet(depth: int, radius: int):
    """For the rows of one prefix: the links between fingerprints that have a common variant under it."""
    masks = [_flips(64 - depth, n) for n in range(radius + 1)]

    def run(table: pa.Table) -> pa.Table:
        fp, first, used, prefix = (table.column(n).to_numpy() for n in ("fp", "first", "used", "prefix"))
        own = (fp.view(np.uint64) & np.uint64((1 << (64 - depth)) - 1)) | prefix.view(np.uint64)
        made, who = [], []
        for u in range(radius + 1):
            at = np.nonzero(used == u)[0].astype(np.int32)
            for n in range(radius - u + 1):
                if len(at) and len(masks[n]):
                    made.append((own[at][:, None] ^ masks[n][None, :]).ravel())
                    who.append(np.repeat(at, len(masks[n])))
        made, who = np.concatenate(made), np.concatenate(who)
        order = np.argsort(made)
        made, who = made[order], who[order]
        same = np.nonzero(made[1:] == made[:-1])[0]
        pairs = np.unique(who[same].astype(np.int64) * len(fp) + who[same + 1])  # neighbours chain the members of a variant
        a, b = pairs // len(fp), pairs % len(fp)
        near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= 2 * radius
        root = _link(len(fp), a[near], b[near])
        linked = root != np.arange(len(fp))
        return pa.table({"a": first[linked], "b": first[root[linked]]})

    return run


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) between the `first` of distinct (fp, first) whose fp differ in at most distance bits (even): enough of these
    links that their components are those of all such pairs."""
    if distance % 2:
        raise ValueError("distance must be even")
    radius = distance // 2
    spread = sum(len(_flips(STEP, i)) for i in range(radius + 1))
    n = nodes.count() * spread
    rows = _spread(nodes.select("fp", "first", F.lit(0).alias("used"), F.lit(0).cast("long").alias("prefix")), 0, radius)
    out, depth = None, STEP
    while True:
        hot = cut(rows.groupBy("prefix").count().where(F.col("count") > MOST).select("prefix"), "hot-prefixes", min(n, 1 << depth)) if depth < 56 else None
        if hot is not None and hot.isEmpty():
            hot = None
        here = rows if hot is None else rows.join(hot, "prefix", "left_anti")
        found = here.groupBy("prefix").applyInArrow(_meet(depth, radius), "a long, b long")
        if hot is None:
            return found if out is None else out.unionByName(found)
        # both are written, so that no level makes those above it once more
        out = cut(found if out is None else out.unionByName(found), "simhash-pairs", n)
        meet = cut(rows.join(hot, "prefix", "left_semi"), "hot-variants", n)
        n = meet.count() * spread
        rows = _spread(meet, depth, radius)
        depth += STEP


def near_duplicates(documents: DataFrame, words: int = 4, distance: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of documents (doc_id, text): the columns named in keep, fp (signed long) and component_id, the least doc_id
    reachable over fingerprints that differ in at most `distance` bits.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; very long texts are read whole. Rows with one
    fingerprint are one node, whatever their number; repeated doc_ids keep all their rows. Rows with a null doc_id link nothing;
    they get the component of their own fingerprint, or null if no other row has it. Columns not named in keep are not
    looked at, whatever their names. An empty table gives no rows.
    """
    n = documents.count()
    each = cut(fingerprints(in_parts(documents, n, DOCUMENTS_A_PART), words, seed, keep), "fingerprints")
    nodes = cut(each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints", n)
    # a document may have two rows with two texts, so that its id names two fingerprints: they are one node of the graph
    found = components(links(nodes.select("fp", F.col("least").alias("first")), distance), "simhash-links", n)
    known = nodes.join(found.withColumnRenamed("node", "least"), "least", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return in_parts(each.join(known, "fp", "left").select("doc_id", *keep, "fp", "component_id"), n, DOCUMENTS_A_PART)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
