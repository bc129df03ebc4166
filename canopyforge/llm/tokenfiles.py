"""Token files: ids of whole documents in order of doc_id, coded by range asymmetric numeral systems (rANS).

One frequency table, counted over all ids and scaled to a power of two, is shared by all blocks. A block holds whole documents,
about `BLOCK` ids, dealt in turn to interleaved lanes, each a 64-bit rANS state that writes 32-bit words into one stream. Every
`EVERY` steps a checkpoint keeps all lanes' states and the place in the stream, so that a block's parts are decoded side by
side; a CRC32 over the ids and the lanes' final states tell damage. Blocks don't depend on each other.

On disk: `<path>/frequencies` (id, frequency) and `<path>/blocks/shard=<n>`, one row a block. Shards are ranges of ascending
doc_id; `first` is the number of ids before a block. Files are written by Spark, so that they can be in any store
and a lost task leaves no part of one behind.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_lists, forget, lasting, read, shared_path

LANES, BLOCK, EVERY = 2048, 1 << 19, 128
#: The least state, and the bits of a word.
LOW, WORD = 1 << 31, 32
END_ID = 2
#: Units of text whose ids a task remembers.
MEMORY = 1_200_000

#: Latin letters and then punctuation, which the vocabulary's rule splits just there. No apostrophes: they bind letters.
_RUNS = re.compile(r"([\n\r\t]+)")
_LETTERS_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?|%$#&*()]*)")


def _shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies show bytes: printable ones as they are, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_SHOWN = _shown_bytes()


class Units(dict):
    """Ids, as bytes, of units of text; frequent ones are remembered. A unit is what stands here, with a space before it or bare."""

    def __init__(self, owner: Encoder, space: str) -> None:
        self.owner, self.space = owner, space
        self.shown_space = _SHOWN[32] if space else ""

    def __missing__(self, unit: str) -> bytes:
        own = self.owner
        # letters, with the space before them, are one word of the vocabulary's rule, which the model alone codes
        if unit.isascii() and unit.isalpha():
            ids = b"".join([own.raw[t.id] for t in own.tokenize(self.shown_space + unit)])
        elif m := _LETTERS_THEN_MARKS.fullmatch(unit):
            if m[2]:
                ids = self[m[1]] + own.bare[m[2]]
            else:
                ids = b"".join([own.raw[t.id] for t in own.tokenize(self.shown_space + unit.encode().decode("latin-1").translate(_SHOWN))])
        elif not unit or unit[-1].isspace():
            raise BlankBeforeSpace
        else:
            parts = _RUNS.split(unit)
            if len(parts) > 1 and not any(not p or p[0].isspace() or p[-1].isspace() for p in parts[::2]):
                # the rule parts a run of blanks from what stands round it; units joined by one seldom recur
                return self[parts[0]] + b"".join([own.run(r) + own.bare[p] for r, p in zip(parts[1::2], parts[2::2], strict=True)])
            ids = own.plain(self.space + unit)
        if len(self) < MEMORY:
            self[unit] = ids
        return ids


class BlankBeforeSpace(Exception):
    """The text can't be cut at its spaces alone."""


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Such a vocabulary's rule never joins a space to the character before it. So a text falls into units at each space that
    follows a non-blank, the units' ids are the text's, and frequent units are coded once. Texts with a blank before a space are
    coded whole, and so are all where the file states another rule than the byte-level one.
    """

    def __init__(self, path: str, width: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        rule = stated.get("pre_tokenizer") or {}
        self.by_units = stated.get("normalizer") is None and stated["model"]["type"] == "BPE" and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.tokenize = self.tokenizer.model.tokenize
        self.raw = [i.to_bytes(int(width[2]), "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known, self.bare = Units(self, " "), Units(self, "")
        self.runs: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def run(self, blanks: str) -> bytes:
        """Ids of blanks before what is not blank: the rule takes all but the last together, and then the last."""
        if blanks not in self.runs:
            if len(self.runs) > 1000:
                self.runs.clear()
            self.runs[blanks] = (self.plain(blanks[:-1]) if len(blanks) > 1 else b"") + self.plain(blanks[-1])
        return self.runs[blanks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian numbers of this encoder's width."""
        if not self.by_units:
            return [self.plain(t) if t else b"" for t in texts]
        get, bare, out = self.known.__getitem__, self.bare, []
        for t in texts:
            if not t:
                out.append(b"")
                continue
            first, *parts = t.split(" ")
            last = b""
            try:
                if parts and (not parts[-1] or parts[-1][-1].isspace()) and not (parts[-2] if len(parts) > 1 else first)[-1:].isspace():
                    last = self.plain(" " + parts.pop())  # blanks that nothing follows
                out.append((bare[first] if first else b"") + b"".join(map(get, parts)) + last)
            except BlankBeforeSpace:
                out.append(self.plain(t))
        return out


def scaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that add up to a power of two, at least 1 for each id that occurs; and that power."""
    used = int((counts > 0).sum())
    bits = min(24, max(14, used.bit_length() + 5))
    if not used:
        return counts.astype(np.int64), bits
    total = 1 << bits
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((total - used) / counts.sum()) + 0.5)), 0).astype(np.int64)
    order = np.lexsort((np.arange(len(freq)), -freq))
    off, i = total - int(freq.sum()), 0
    while off:  # what rounding left over goes to, or is taken from, the commonest
        step = max(off, 1 - int(freq[order[i]])) if off < 0 else off
        freq[order[i]] += step
        off -= step
        i += 1
    return freq, bits


class Coder:
    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(31 - bits + WORD)
        self.of_slot: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> dict:
        n, lanes = len(ids), max(1, min(LANES, len(ids) // 16))
        steps, k = -(-n // lanes), np.uint64(self.bits)
        f, c, limit = self.freq[ids], self.below[ids], self.limit[ids]
        x, words, marks = np.full(lanes, LOW, np.uint64), [], []
        sizes = np.zeros(steps, np.int64)
        for t in range(steps - 1, -1, -1):
            at = slice(t * lanes, min(n, (t + 1) * lanes))
            ft = f[at]
            xt = x[: len(ft)]
            over = xt >= limit[at]
            out = (xt[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            sizes[t] = len(out)
            xt = np.where(over, xt >> np.uint64(WORD), xt)
            q = xt // ft
            x[: len(ft)] = (q << k) + (xt - q * ft) + c[at]
            if t % EVERY == 0:
                marks.append(x.copy())
        places = np.concatenate([[0], np.cumsum(sizes)])[0:steps:EVERY] if steps else np.zeros(0, np.int64)
        return {"lanes": lanes, "states": np.concatenate(marks[::-1]).astype("<u8").tobytes() if marks else b"", "places": places.astype("<i8").tobytes(), "words": b"".join(w.tobytes() for w in words[::-1])}

    def decode(self, n: int, lanes: int, states: bytes, places: bytes, words: bytes) -> np.ndarray:
        if self.of_slot is None:
            self.of_slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        steps, k, mask = -(-n // lanes), np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        stream, x = np.frombuffer(words, "<u4").astype(np.uint64), np.frombuffer(states, "<u8").reshape(-1, lanes).astype(np.uint64)
        stream = np.concatenate([stream, np.zeros(1, np.uint64)])
        place, parts = np.frombuffer(places, "<i8").copy(), len(x)
        out = np.zeros((parts * EVERY, lanes), np.uint32)
        rows = np.arange(parts) * EVERY
        for i in range(EVERY if parts else 0):
            live = parts if rows[-1] + i < steps else parts - 1
            if not live:
                break
            xs = x[:live]
            slot = xs & mask
            ids = self.of_slot[slot.astype(np.int64)]
            out[rows[:live] + i] = ids
            nxt = self.freq[ids] * (xs >> k) + slot - self.below[ids]
            if rows[live - 1] + i == steps - 1 and n % lanes:  # the last step is short
                nxt[live - 1, n % lanes :] = xs[live - 1, n % lanes :]
            low = nxt < np.uint64(LOW)
            count = low.cumsum(1)
            at = place[:live, None] + count - 1
            x[:live] = np.where(low, (nxt << np.uint64(WORD)) | stream[np.where(low, at, len(stream) - 1)], nxt)
            place[:live] += count[:, -1]
        if parts and not ((x[-1] == LOW).all() and place[-1] == len(stream) - 1):
            raise ValueError("a block's final states are wrong")
        return out.reshape(-1)[:n]


_TOKENS = "shard int, before long, n_tokens long, doc_ids array<long>, lengths array<int>, ids binary, counts binary"
_BLOCKS = "shard int, first long, n_tokens long, doc_ids array<long>, lengths array<int>, lanes int, states binary, places binary, words binary, crc32 long"
_LISTS = [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
_TOKEN_SCHEMA = pa.schema([("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), *_LISTS, ("ids", pa.binary()), ("counts", pa.binary())])
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), *_LISTS, ("lanes", pa.int32()), ("states", pa.binary()), ("places", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())])
#: Blocks are large rows: bytes of a row group, so that a reader holds few at once.
ROW_GROUP = 16 << 20


def _ranges(ids: DataFrame, n: int) -> Column | None:
    """The place of doc_id among n ranges of about as many rows, from the ids alone: a range partitioner would read all texts to
    sample them. A binary search over one literal of at most n - 1 bounds; None where there are no bounds."""
    bounds = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    if not bounds:
        return None
    bounds = sorted(set(bounds))
    held = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    step = f"if(get({held}, cast((s.lo + s.hi) div 2 as int)) < doc_id, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))"
    found = f"aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> if(s.lo < s.hi, {step}, s), s -> s.lo)"
    return F.coalesce(F.expr(f"if(doc_id is null, 0, {found})"), F.lit(0))


def tokenize(documents: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> tuple[DataFrame, str]:
    """Ids of documents (doc_id, text) in order of doc_id, one row a block of whole documents, and the ids' width: (shard: the place
    of a range of doc_ids, before: ids that the shard has before the block, n_tokens, doc_ids, lengths, ids, counts: of the
    shard's ids so far, on its last row). Null texts have the end id only.
    """
    with open(tokenizer, encoding="utf-8") as f:
        highest = max([*json.load(f)["model"]["vocab"].values(), end_id or 0])
    width = "<u2" if highest < 1 << 16 else "<u4"
    end = b"" if end_id is None else np.array([end_id], width).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, before = lasting(("tokens", tokenizer, width), lambda: Encoder(tokenizer, width)), TaskContext.get().partitionId(), 0
        counts = np.zeros(highest + 1, np.int64)
        names: list[int] = []
        made: list[bytes] = []
        size = 0

        def block(last: bool) -> pa.RecordBatch:
            nonlocal before, size, counts
            lengths, raw = [len(x) // int(width[2]) for x in made], b"".join(made)
            counts += np.bincount(np.frombuffer(raw, width), minlength=len(counts))
            row = {"shard": shard, "before": before, "n_tokens": sum(lengths), "doc_ids": list(names), "lengths": lengths, "ids": raw, "counts": counts.astype("<i8").tobytes() if last else None}
            before, size = before + row["n_tokens"], 0
            names.clear()
            made.clear()
            return pa.RecordBatch.from_pylist([row], _TOKEN_SCHEMA)

        gc.disable()  # a million remembered units make collections dear, and nothing here is cyclic
        try:
            for ids, texts in column_lists(batches, "doc_id", "text", rows=500):
                for i, x in zip(ids, own.encode(texts), strict=True):
                    if size >= BLOCK * int(width[2]):
                        yield block(False)
                    names.append(i)
                    made.append(x + end)
                    size += len(x) + len(end)
            if names:
                yield block(True)
        finally:
            gc.enable()

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = _ranges(docs, n)
    ordered = docs.repartitionById(n, F.lit(0) if place is None else place).sortWithinPartitions("doc_id", "text")
    path = shared_path(spark, "token-ids")
    ordered.mapInArrow(run, _TOKENS).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(_TOKENS).parquet(path), width


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> None:
    """Writes the ids of documents (doc_id, text), an end id after each, as token files at path.

    Order: doc_id, null first, then text, so that repeated rows have a place too. A null or empty text is its end id only; a very
    long one is a block by itself. An empty table writes an empty frequency table and no blocks. Extra columns are not looked at.
    """
    spark = documents.sparkSession
    tokens, width = tokenize(documents, tokenizer, end_id)
    # one row a shard, of which there are as many as shuffle partitions, and of each its counts, one at a time
    first, upto = {}, 0
    for r in sorted(tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        first[r.shard], upto = upto, upto + r.n
    freq, bits = scaled(_counted(tokens))
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.nonzero(freq)[0]], "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    held = spark.sparkContext.broadcast((freq, bits, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        freq, bits, first = held.value
        coder = Coder(freq, bits)
        for batch in batches:
            shards, before, sizes = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(5)[i].as_buffer(), width).astype("<u4")
                made = coder.encode(ids)
                made = {"shard": shards[i], "first": first[shards[i]] + before[i], "n_tokens": sizes[i], "crc32": zlib.crc32(ids)} | made
                columns = [batch.column(_TOKEN_SCHEMA.get_field_index(f.name)).slice(i, 1) if f.name in ("doc_ids", "lengths") else pa.array([made[f.name]], f.type) for f in _BLOCK_SCHEMA]
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK_SCHEMA)

    tokens.drop("counts").mapInArrow(run, _BLOCKS).write.partitionBy("shard").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")


def _counted(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, from the shards' counts; ids without a count before the last are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                found = np.frombuffer(x.as_buffer(), "<i8")
                total = np.pad(total, (0, len(found) - len(total))) + found if len(found) > len(total) else total + found
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    sums = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = sums.toArrow()  # at most the vocabulary
    ids, n = (counted.column(c).to_numpy() for c in ("id", "n"))
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = n
    return counts


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids: little-endian unsigned 32-bit numbers) of each document of the token files at path."""
    table = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/frequencies").collect()}
    freq = np.zeros(max(table, default=0) + 1, np.int64)
    for i, n in table.items():
        freq[i] = n
    held = spark.sparkContext.broadcast((freq, max(0, int(freq.sum()).bit_length() - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        coder = Coder(*held.value)
        for batch in batches:
            at = {f: batch.column(batch.schema.get_field_index(f)) for f in batch.schema.names}
            for i in range(batch.num_rows):
                first, n, lanes, crc = (at[f][i].as_py() for f in ("first", "n_tokens", "lanes", "crc32"))
                raw = coder.decode(n, lanes, *(at[f][i].as_buffer() for f in ("states", "places", "words"))).astype("<u4")
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"the block at id {first} is damaged")
                ends = np.concatenate([[0], np.cumsum(at["lengths"][i].values.to_numpy(), dtype=np.int64)])
                texts = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([at["doc_ids"][i].values, pa.array(first + ends[:-1]), texts], ["doc_id", "start", "ids"])

    blocks = spark.read.schema(_BLOCKS).option("recursiveFileLookup", "true").parquet(f"{path}/blocks") if freq.any() else spark.createDataFrame([], _BLOCKS)
    return blocks.drop("shard").mapInArrow(run, "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
