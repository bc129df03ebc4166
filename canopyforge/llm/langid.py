"""Language identification with language-bitmask n-gram filters.

Training counts, for each language, in how many sampled documents an n-gram of letters occurs. Each language has a Bloom filter
of all n-grams that occur in its documents, and further ones of those in at least a share of them (`LEVELS`). All filters
are bit-sliced: slot i holds one bit for each filter, so that the AND of an n-gram's slots is the mask of all
languages that (may) contain it, and at which levels. A text is scored by the popcounts of each language's bits over its n-grams; the
share of false positives that a filter's fill implies is taken off, and the largest corrected count decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_lists, crc_of_id, cut, forget, read

#: Orders of the n-grams, whose words get a blank at each end.
ORDERS = (3, 4)
#: Bound of the sample the filters are fitted on: documents of each language, in expectation.
SAMPLE_DOCS = 1500
#: Shares of a language's documents that have the n-grams of each of its filters; the first holds all n-grams.
LEVELS = (0.0, 0.01, 0.1)
#: Slots for each n-gram of the language that has most, least slots, probes, filters in one word of a slot.
PER_GRAM, LEAST_SLOTS, PROBES = 32, 1 << 16, 2
PER_WORD = 64 // len(LEVELS)
UNKNOWN = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' words, and the index of the text that each is from."""
    low = [t.lower() for t in texts]
    # a blank between the texts, so that no n-gram spans two of them
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner, letter = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low]), _letters()[codes]
    wide = np.where(letter, codes, 32).astype(np.uint64)
    out, whose = [], []
    for n in ORDERS:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        h, ok = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            h = (h ^ wide[j : j + m]) * _MIX[j]
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1:
                ok &= letter[j : j + m]  # blanks only at the ends
        ok &= (letter[:m] | letter[n - 1 :]) if n > 2 else True
        at = np.nonzero(ok)[0]
        out.append(h[at])
        whose.append(owner[np.minimum(at, len(owner) - 1)])
    return (np.concatenate(out), np.concatenate(whose)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _slots(hashes: np.ndarray, probe: int, slots: int) -> np.ndarray:
    return ((hashes * _MIX[probe] >> np.uint64(20)) & np.uint64(slots - 1)).astype(np.int64)


class Filters:
    """Bit-sliced filters of any number of languages. Fitted from grams: {language: (hashes, share of its documents with each)}.

    A slot has a word for each `PER_WORD` languages; a language's bits in it are its levels, the first of which is containment.
    """

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], prior: str) -> None:
        self.languages, self.prior = sorted(grams), prior
        self.slots = LEAST_SLOTS
        while self.slots < PER_GRAM * max((len(h) for h, _ in grams.values()), default=0):
            self.slots *= 2
        self.table = np.zeros((-(-len(self.languages) // PER_WORD), self.slots), np.uint64)
        self.weight, self.base = [], []
        for i, name in enumerate(self.languages):
            hashes, shares = grams[name]
            word, shift, false = self.table[i // PER_WORD], len(LEVELS) * (i % PER_WORD), []
            for level, least in enumerate(LEVELS):
                for p in range(PROBES):
                    word[_slots(hashes[shares >= least], p, self.slots)] |= np.uint64(1 << (shift + level))
                false.append((np.count_nonzero(word & np.uint64(1 << (shift + level))) / self.slots) ** PROBES)
            # a filter with the false positive rate f and c hits among n n-grams holds (c - n f) / (1 - f) of them
            self.weight.append(np.array([sum(1 / (1 - f) for level, f in enumerate(false) if k >> level & 1) for k in range(1 << len(LEVELS))]))
            self.base.append(sum(f / (1 - f) for f in false))

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """One row a word: of each n-gram, the bits of all languages and levels that (may) contain it."""
        out = self.table[:, _slots(hashes, 0, self.slots)]
        for p in range(1, PROBES):
            out &= self.table[:, _slots(hashes, p, self.slots)]
        return out

    def containing(self, gram: int) -> list[str]:
        """All languages that (may) contain an n-gram, by its hash."""
        masks = self.masks(np.array([gram], np.uint64))[:, 0].tolist()
        return [name for i, name in enumerate(self.languages) if masks[i // PER_WORD] >> (len(LEVELS) * (i % PER_WORD)) & 1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        given = [t or "" for t in texts]
        hashes, owner = gram_hashes(given)
        n = np.bincount(owner, minlength=len(given))
        masks, true = self.masks(hashes), np.zeros((len(given), len(self.languages)))
        for i in range(len(self.languages)):
            own = (masks[i // PER_WORD] >> np.uint64(len(LEVELS) * (i % PER_WORD))) & np.uint64((1 << len(LEVELS)) - 1)
            true[:, i] = np.bincount(owner, self.weight[i][own.astype(np.int64)], len(given)) - n * self.base[i]
        true = np.maximum(true, 0.0)
        best, total = (true.argmax(1) if self.languages else n), true.sum(1)
        langs, scores = [], []
        for i, t in enumerate(given):
            if not any(map(str.isalpha, t)) or not self.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
            elif total[i] <= 0:
                langs.append(self.prior)
                scores.append(1.0 / len(self.languages))
            else:
                langs.append(self.languages[best[i]])
                scores.append(float(true[i, best[i]] / total[i]))
        return langs, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, documents) of one task."""
    counts: dict[str, Counter] = {}
    docs: Counter = Counter()
    for langs, texts in column_lists(batches, "lang", "text"):
        for lang, text in zip(langs, texts, strict=True):
            counts.setdefault(lang, Counter()).update(np.unique(gram_hashes([text])[0]).view(np.int64).tolist())
            docs[lang] += 1
    for lang, found in counts.items():
        found = list(found.items())
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "gram": [g for g, _ in part], "docs": [n for _, n in part]})
        yield pa.RecordBatch.from_pydict({"lang": [lang], "gram": pa.array([None], pa.int64()), "docs": [docs[lang]]})


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from labelled (doc_id, text, lang): a sample of about sample_docs documents of each language, dealt by a hash of
    the id and of the text. All counts are made where the rows are; the filters hold every n-gram of the sample, whose bound is the
    only one. Rows with a null text or lang are left out; without any, every prediction is `und`."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Filters({}, UNKNOWN)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))])[F.col("lang")]
    dealt = F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = usable.where(dealt < share).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    kept = cut(counts, "language-grams")
    totals = {r.lang: r.docs for r in kept.where("gram is null").collect()}
    grams = {}
    for lang, n in sorted(totals.items()):  # one language's at a time, as plain arrays
        own = kept.where((F.col("lang") == lang) & F.col("gram").isNotNull()).select("gram", "docs").toArrow()
        grams[lang] = own.column("gram").to_numpy().view(np.uint64), own.column("docs").to_numpy() / n
    return Filters(grams, max(sizes, key=lambda k: (sizes[k], k)))


def identify(documents: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score in 0..1) for each row of documents (doc_id, text); nothing but the text is looked at.

    Null and empty texts and texts without letters are `und` with score 0. A text whose n-grams no filter knows gets the
    language that was most frequent in training, with an even share as score. Ties go to the language first in order of names.
    """
    model = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for ids, texts in column_lists(batches, "doc_id", "text", rows=200):
            langs, scores = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0
    filters = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
