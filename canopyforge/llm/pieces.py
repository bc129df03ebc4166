"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position its output links give all pieces that end there, and each relaxes the
position's best score from the one at the piece's start. A position that no piece of one character reaches gets the unknown
piece at the vocabulary's penalty, written as bytes where the vocabulary has them. The result is the segmentation with the
greatest sum of piece scores, ties to the longer last piece: what the library's unigram model gives for these pieces and scores.

Where two neighbouring characters are together in no piece, no piece can lie over them, so that a text falls into segments
there whose best segmentations are the text's. A space mark after another character is such a place, unless a piece has it.
Segments are cut at those first, what is met for the first time at all others, and frequent ones are solved once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_lists, forget, lasting, read

SPACE = "▁"
#: What an unknown character scores less than the least piece; segments that a task remembers.
PENALTY, MEMORY = 10.0, 200_000
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = number() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """The pieces of a SentencePiece model file, as a unigram vocabulary."""

    def __init__(self, path: str) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix, self.strip = True, True
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.strip = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("only models without a character map are read")
        self.unknown_score = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0) - PENALTY
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER))
        #: Neighbours that some piece has.
        self.together = {p[i : i + 2] for p, _, kind in self.pieces if kind in (NORMAL, USER) for i in range(len(p) - 1)}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]

    @cached_property
    def automaton(self):
        """Made by whoever encodes; decoding has no use for it."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER):
                out.add_word(piece, (len(piece), score, i))
        out.make_automaton()
        return out

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalized text."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        single = [False] * (n + 1)
        found, nxt = self.automaton.iter(text), None
        nxt = next(found, None)
        for end in range(1, n + 1):
            top = None
            while nxt is not None and nxt[0] == end - 1:  # longest first: ties stay with it
                length, score, piece = nxt[1]
                s = best[end - length] + score
                if top is None or s > top:
                    top, back[end] = s, (length, piece)
                if length == 1:
                    single[end] = True
                nxt = next(found, None)
            if not single[end]:
                s = best[end - 1] + self.unknown_score
                if top is None or s > top:
                    top, back[end] = s, (1, -1)
            best[end] = top
        out: list[int] = []
        at = n
        while at:
            length, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            at -= length
        return out[::-1]

    def normalized(self, text: str) -> str:
        if self.strip:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Segments(dict):
    """Ids, as bytes, of segments; frequent ones are remembered."""

    def __init__(self, path: str) -> None:
        self.model = model(path)

    def __missing__(self, s: str) -> bytes:
        together = self.model.together
        ends = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in together]
        if ends:
            ids = b"".join([self[s[a:b]] for a, b in zip([0, *ends], [*ends, len(s)], strict=True)])
        else:
            ids = np.array(self.model.viterbi(s), np.uint32).tobytes()
        if len(self) < MEMORY:
            self[s] = ids
        return ids


class Encoder:
    """Encodes texts one after another."""

    def __init__(self, path: str) -> None:
        self.model, self.known = model(path), Segments(path)

    def encode(self, text: str | None) -> np.ndarray:
        text = self.model.normalized(text or "")
        if not self.model.cuts:
            return np.frombuffer(self.known[text] if text else b"", np.uint32)
        if SPACE + SPACE in text or text[:1] != SPACE or text[-1:] == SPACE:
            parts = _SEGMENT.findall(text)
        else:
            parts = [SPACE + p for p in text[1:].split(SPACE)]
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.uint32)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = lasting(("pieces", path), lambda: Encoder(path))
    for ids, texts in column_lists(batches, "doc_id", "text", rows=500):
        made = [own.encode(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
        flat = np.concatenate([*made, np.zeros(0, np.uint32)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids: array<int>) of each row of documents (doc_id, text) by the model file at path.

    Null and empty texts have no ids. Repeated rows each get their row; texts are read whole and other columns not at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, path)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


_DECODED = "ids array<int>, text string, n_pieces long, ids_crc32 long"


def _decoded(ids: pa.Array, lists: pa.ListArray, path: str) -> pa.RecordBatch:
    """A batch of (doc_id, ids) with what decode() adds."""
    piece, first = model(path).bytes_of.__getitem__, model(path).prefix
    flat, ends = _flat(lists)
    raw, texts, crcs = flat.astype("<u4").tobytes(), [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text = b"".join(map(piece, flat[a:b].tolist())).decode("utf-8", "replace")
        texts.append(text[1:] if first and text[:1] == " " else text)
        crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(texts, pa.string()), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "ids", "text", "n_pieces", "ids_crc32"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text, n_pieces, ids_crc32) of each row of (doc_id, ids): the text, and the crc of the ids as little-endian
    32-bit numbers. Null ids give an empty text. A space mark in a text comes back as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield _decoded(part.column(0), part.column(1), path)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id long, {_DECODED}")


def encode_and_decode(documents: DataFrame, path: str) -> DataFrame:
    """decode(encode(documents)) by one Python worker a task, where two would each hold memory and pass the ids on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _encoded(batches, path):
            yield _decoded(part.column(0), part.column(1), path)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {_DECODED}")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list's end is among them (null lists are empty)."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().fill_null(0).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def digest(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text_sha256) of what decode() gives; with keep_ids also ids."""
    return decoded.select("doc_id", *["ids"] * keep_ids, "n_pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return digest(encode_and_decode(read(spark, sf_dir, "documents"), path))
