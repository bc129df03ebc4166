"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and dealt into blocks of rows. In a block, each component less its least value is kept as
bit slices: bitmaps over the block's rows. A query adds slices with bitmap arithmetic: slice b of a component counts at bit
b + j for each bit j of the query's component (the complement of the slice, where that is negative), carry-save adders turn all
bitmaps of one weight into one and carries, and what is left is the score of every row as slices. The best rows are
chosen from the most significant slice downward; rows that tie at the boundary are resolved exactly by their ids.

Equal rows are one row of the index with its number of copies, so that a very frequent vector is no large block. A block has as
many slices as its widest components need, up to a long's 64 bits, and sums have as many as they take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Rows of a block, queries that meet a block at once, tasks worth having.
BLOCK, QUERIES, TASKS = 32_768, 4096, 48
#: Bits of the lower two of the three longs that hold a score.
LOWER = 62
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q: array<long>) of the rows of (vec_id, embedding) that take part: floor(scale * x) of each component; one beyond
    a long is the nearest long."""
    x = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    q = F.transform(x, lambda v: F.when(v >= F.lit(2.0**63), F.lit(_LONG)).when(v < F.lit(-(2.0**63)), F.lit(-_LONG - 1)).otherwise(F.floor(v)))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", "embedding").where(fit).select(F.col("vec_id").cast("long"), q.cast("array<long>").alias("q"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    rows = lists.to_pylist()
    wide = max(map(len, rows), default=0)
    out = np.zeros((len(rows), wide), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def _build(table: pa.Table) -> pa.Table:
    """The index of one block: ids in order and their copies, each component's least value and number of slices, all slices."""
    ids, copies, m = table.column("vec_id").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("q"))
    order = np.argsort(ids, kind="stable")
    ids, copies, m = ids[order], copies[order], m[order]
    low = m.min(0) if len(m) else np.zeros(0, np.int64)
    m = m.view(np.uint64) - low.view(np.uint64)  # up to 64 bits wide
    widths = [int(x).bit_length() for x in m.max(0)] if len(m) else []
    slices = [_pack((m[:, d] >> np.uint64(b)) & np.uint64(1) != 0) for d, w in enumerate(widths) for b in range(w)]
    held = np.concatenate(slices).tobytes() if slices else b""
    out = {"block": [table.column("block")[0].as_py()], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "low": [low.tolist()], "widths": [widths], "slices": [held]}
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("low", pa.list_(pa.int64())), ("widths", pa.list_(pa.int32())), ("slices", pa.binary())]))


class Block:
    """A block's index, ready for queries."""

    def __init__(self, ids: bytes, copies: bytes, low: list[int], widths: list[int], slices: bytes) -> None:
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.low, self.widths = low, np.array(widths, np.int64)
        self.all = _pack(np.ones(len(self.ids), bool))
        plain = np.frombuffer(slices, np.uint64).reshape(-1, len(self.all))
        self.slices = np.concatenate([plain, ~plain & self.all])
        self.of = np.repeat(np.arange(len(widths)), self.widths)  # component and bit of each slice
        self.bit = np.concatenate([np.arange(w) for w in widths]) if len(self.of) else np.zeros(0, np.int64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of every row's score, least significant first, and what is to be added to it."""
        wide = len(self.low)
        q = np.zeros(wide, np.int64)
        q[: min(wide, len(query))] = query[:wide]
        down = q < 0
        size = np.where(down, -q.view(np.uint64), q.view(np.uint64))  # as unsigned numbers, which hold the least long's size
        given, widths = q.tolist(), self.widths.tolist()
        constant = sum(x * least + (x * ((1 << w) - 1) if x < 0 else 0) for x, least, w in zip(given, self.low, widths, strict=True))
        rows = np.arange(len(self.of)) + len(self.of) * down[self.of]
        at: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length() if wide else 0):
            used = (size[self.of] >> np.uint64(j)) & np.uint64(1) != 0
            for w in np.unique(self.bit[used]).tolist():
                at.setdefault(w + j, []).append(rows[used & (self.bit == w)])
        out, carried, w = [], [], 0
        while carried or any(k >= w for k in at):
            given = [self.slices[np.concatenate(at[w])]] if w in at else []
            x = np.concatenate([*given, *carried, np.zeros((0, len(self.all)), np.uint64)])
            carried = []
            if not len(x):
                x = np.zeros((1, len(self.all)), np.uint64)
            while len(x) > 2:  # full adders: of three bitmaps one stays and one is carried
                k = len(x) // 3
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (c & half))
                x = np.concatenate([half ^ c, x[3 * k :]])
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0])
            w += 1
        return out, constant

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """ids, copies and exact scores of the k best rows (ties: the smaller ids), without rows of the id own."""
        slices, constant = self.scores(query)
        tied, sure = self.all.copy(), np.zeros_like(self.all)
        for r in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            tied[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        for s in reversed(slices):
            higher = sure | (tied & s)
            n = int(np.bitwise_count(higher).sum())
            if n > k:
                tied = tied & s
            else:
                sure, tied = higher, tied & ~s
                if n == k:
                    tied[:] = 0
                    break
        at = np.concatenate([self._rows(sure), self._rows(tied)[: k - int(np.bitwise_count(sure).sum())]])
        if len(slices) <= LOWER:
            score = np.zeros(len(at), np.int64)
            for w, s in enumerate(slices):
                score += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
            exact = [constant + x for x in score.tolist()]
        else:
            exact = [constant + sum((int(s[r >> 6]) >> (r & 63) & 1) << w for w, s in enumerate(slices)) for r in at.tolist()]
        return self.ids[at], self.copies[at], exact

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


def _search(k: int):
    names = ("query_no", "query_id", "vec_id", "copies", "upper", "middle", "lower")
    kinds = pa.schema([(n, pa.int64()) for n in names])

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {n: [] for n in names}
        for i in range(index.num_rows if queries.num_rows else 0):
            block = Block(*(index.column(n)[i].as_py() for n in ("ids", "copies", "low", "widths", "slices")))
            for no, own, q in zip(queries.column("query_no").to_pylist(), queries.column("query_id").to_pylist(), _matrix(queries.column("q")), strict=True):
                ids, copies, scores = block.best(q, own, k)
                low = (1 << LOWER) - 1
                held = ([s >> 2 * LOWER for s in scores], [s >> LOWER & low for s in scores], [s & low for s in scores])
                for name, x in zip(names, ([no] * len(ids), [own] * len(ids), ids.tolist(), np.minimum(copies, k).tolist(), *held), strict=True):
                    found[name] += x
        return pa.table(found, schema=kinds)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query of (vec_id, embedding) the k vectors with the highest integer inner
    product, ties to the smaller vec_id; all, if there are fewer.

    Rows with a query's vec_id are its own and aren't found by it. Null vectors, vectors with null or non-finite components and null
    ids take no part. A quantised component beyond a long counts as the nearest long; scores are exact and ranked as
    such, and one beyond a long is returned as the nearest long. Components that one of two vectors lacks count as 0. Repeated rows
    are found repeatedly; equal queries are asked once. Empty vectors score 0. Other columns are not looked at, whatever
    their names. No rows, no results.
    """
    base = quantised(vectors, scale).groupBy("vec_id", "q").agg(F.count("*").alias("copies"))
    base = cut(base, "quantised")
    n, asked = base.count(), cut(quantised(queries, scale).distinct().withColumn("query_no", F.xxhash64("vec_id", "q")), "queries")
    blocks = max(1, -(-n // BLOCK))
    parts = max(-(-TASKS // blocks), -(-asked.count() // QUERIES))  # each meets every block
    index = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_build, "block int, ids binary, copies binary, low array<long>, widths array<int>, slices binary")
    index = cut(index, "bit-slices").select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = asked.select("query_no", F.col("vec_id").alias("query_id"), "q", F.pmod("query_no", F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = index.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_search(k), "query_no long, query_id long, vec_id long, copies long, upper long, middle long, lower long")
    found = found.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("upper"), F.desc("middle"), F.desc("lower"), "vec_id"))
    # a score is a long if what is above its lowest part is one of -2, -1, 0 and 1
    above = F.when(F.col("upper") == 0, F.col("middle")).when(F.col("upper") == -1, F.col("middle") - F.lit(1 << LOWER)).when(F.col("upper") > 0, F.lit(_LONG)).otherwise(F.lit(-_LONG))
    score = F.when(above > 1, F.lit(_LONG)).when(above < -2, F.lit(-_LONG - 1)).otherwise(F.shiftleft(above, LOWER).bitwiseOR(F.col("lower")))
    return found.select("query_id", rank.alias("rank"), "vec_id", score.alias("score")).where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
  from (select distinct * from v where vec_id % 50 = 0) a, v b where a.vec_id <> b.vec_id)
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs) where rank <= 5
"""
