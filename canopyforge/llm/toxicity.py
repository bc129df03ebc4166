"""Toxic spans and document scores by a linear-chain conditional random field over words.

Only documents are labelled, so tokens are labelled from them: a word or word beginning that is much commoner in
toxic documents than in others, over enough different ones, marks the tokens of toxic documents that have it. A
two-state CRF is fitted to those tokens by maximum likelihood; forward-backward gives each token's marginal. Marginals
add up to a document's features, on which a logistic regression gives its score, and tokens with a marginal of half or more,
joined where they adjoin, are the offending spans.

Forward and backward run over all texts of a batch as one chain, which starts anew at each text, by blocks: products of 2x2
matrices within blocks, then across them. So one very long text costs what its length in short ones does.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, crc_of_id, cut, read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PREFIXES = range(4, 9)
#: Bound of the sample that the model is fitted on: labelled documents of each class, in expectation.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
#: A feature marks tokens if it is so many times as common in toxic documents and occurs in so many and such a share of them.
LEAST_RATIO, LEAST_SUPPORT, SUPPORT_SHARE = 8.0, 4, 0.03
#: Words of a training sequence, sequences that a step of the fit takes, least steps and rate, weight of its penalty, words that a task remembers.
CHUNK, AT_ONCE, STEPS, RATE, PENALTY, MEMORY = 48, 4_000, 120, 0.25, 1e-4, 150_000
THRESHOLD = 0.7


def features(word: str) -> list[str]:
    """Of a lower-cased word: itself, and its beginnings that are shorter."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if k < len(word))]


def marginals(emissions: np.ndarray, starts: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(state 1) of each token of chains that lie one after another.

    emissions: log weight of state 1 against 0 by token; starts: True at each chain's first token; transitions: 2x2 log
    weights from row to column; first: log weights of a chain's first state.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    step = np.where(starts[:, None, None], np.exp(first)[None, None, :], np.exp(transitions)[None])
    e = np.clip(emissions, -50, 50)
    step[:, :, 1] *= np.exp(e)[:, None]
    step /= step.max(axis=(1, 2), keepdims=True)
    step = np.concatenate([step, np.tile(np.eye(2), (blocks * length - n, 1, 1))]).reshape(blocks, length, 2, 2)
    ahead, back = np.empty_like(step), np.empty_like(step)
    at = step[:, 0]
    ahead[:, 0] = at
    for i in range(1, length):
        at = at @ step[:, i]
        at = at / at.sum(axis=(1, 2), keepdims=True)
        ahead[:, i] = at
    at = np.tile(np.eye(2), (blocks, 1, 1))
    back[:, length - 1] = at
    for i in range(length - 2, -1, -1):
        at = step[:, i + 1] @ at
        at = at / at.sum(axis=(1, 2), keepdims=True)
        back[:, i] = at
    into, out = np.empty((blocks, 2)), np.empty((blocks, 2))
    v = np.array([0.5, 0.5])
    for b in range(blocks):
        into[b] = v
        v = v @ ahead[b, -1]
        v = v / v.sum()
    v = np.ones(2)
    for b in range(blocks - 1, -1, -1):
        out[b] = v
        v = step[b, 0] @ (back[b, 0] @ v)
        v = v / v.sum()
    both = np.einsum("bi,blij->blj", into, ahead) * np.einsum("blij,bj->bli", back, out)
    return (both[..., 1] / both.sum(-1)).reshape(-1)[:n]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0, 0, 0, 0]))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word.lower()))

    def tag(self, texts: list[str | None], remembered: dict[str, float], raw: bool = False):
        """Scores and spans (start, end, marginal) of the texts, or with raw their features; remembered keeps words' emissions."""
        words = [WORD.findall(t) if t else [] for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if len(remembered) > MEMORY:
            remembered.clear()
        for w in {w for ws in words for w in ws}.difference(remembered):
            remembered[w] = self.emission(w)
        e = np.fromiter(map(remembered.__getitem__, chain.from_iterable(words)), np.float64, int(lengths.sum()))
        starts = np.zeros(len(e), bool)
        begin = np.cumsum(lengths) - lengths
        starts[begin[lengths > 0]] = True
        p = marginals(e, starts, self.transitions, self.first)
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        distinct, evidence = np.zeros(len(texts)), np.zeros(len(texts))
        marked = np.nonzero(p >= 0.5)[0]
        owner = np.searchsorted(begin + lengths, marked, side="right")
        for i in np.unique(owner).tolist():
            at = marked[owner == i] - begin[i]
            best: dict[str, float] = {}
            for k in at.tolist():
                w = words[i][k].lower()
                best[w] = max(best.get(w, 0.0), float(p[begin[i] + k]))
            distinct[i], evidence[i] = len(best), -sum(np.log(1 - q + 1e-4) for q in best.values())
            places = [m.span() for m in WORD.finditer(texts[i])]
            for k in at.tolist():
                q = float(p[begin[i] + k])
                if spans[i] and k and spans[i][-1][1] == places[k - 1][1]:
                    start, _, before = spans[i][-1]
                    spans[i][-1] = (start, places[k][1], max(before, q))
                else:
                    spans[i].append((*places[k], q))
        x = _document_features(p, lengths, distinct, evidence)
        if raw:
            return x
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -40, 40))), spans


def _document_features(p: np.ndarray, lengths: np.ndarray, distinct: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """By document: 1, log odds of the greatest marginal, log of the share that marked words have, log of the number of distinct
    ones, and how unlikely it is that none of these is toxic."""
    ends = np.cumsum(lengths)
    total = np.diff(np.concatenate([[0.0], np.concatenate([[0.0], np.cumsum(np.where(p >= 0.5, p, 0.0))])[ends]]))
    greatest = np.zeros(len(lengths))
    full = np.nonzero(lengths)[0]
    if len(full):
        greatest[full] = np.maximum.reduceat(p, (ends - lengths)[full])
    share = np.maximum(total, 0) / np.maximum(lengths, 1)
    odds = np.clip(np.log((greatest + 1e-6) / (1 - greatest + 1e-6)), -6, 8)
    return np.stack([np.ones(len(lengths)), odds, np.log(share + 1e-3) + np.log(1e3), np.log1p(distinct), np.minimum(evidence, 30.0)], 1)


def _different(texts: list[list[str]]) -> list[bool]:
    """False for texts of which over half of the 5-word shingles are in earlier ones: copies are one witness, not many."""
    seen: set[int] = set()
    out = []
    for ws in texts:
        own = {hash(tuple(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))}
        out.append(len(own & seen) <= len(own) / 2)
        if out[-1]:
            seen |= own
    return out


def _lexicon(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Features that mark the tokens of toxic documents."""
    counts, support = (Counter(), Counter()), Counter()
    totals = [1, 1]
    for ws, y in zip(texts, toxic.tolist(), strict=True):
        own = Counter(f for w in ws for f in features(w))
        counts[y].update(own)
        totals[y] += len(ws)
        if y:
            support.update(own.keys())
    rate, least = totals[0] / totals[1], max(LEAST_SUPPORT, SUPPORT_SHARE * int(toxic.sum()))
    return {f for f, n in support.items() if n >= least and (counts[1][f] + 0.5) / (counts[0][f] + 0.5) * rate >= LEAST_RATIO}


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """A model from texts and their labels 0/1; the texts are the bounded sample, so that this runs on the driver."""
    model = Model()
    same: dict[str, str] = {}  # equal words are one object, so that the sample is small in memory
    words = [[same.setdefault(w, w) for w in map(str.lower, WORD.findall(t or ""))] for t in texts]
    keep = _different(words)
    words = [w for w, k in zip(words, keep, strict=True) if k]
    toxic = np.array([int(y == 1) for y, k in zip(labels, keep, strict=True) if k], np.int64)
    if not toxic.any() or toxic.all():
        if len(toxic):
            model.document[0] = 3.0 if toxic.all() else -3.0
        return model
    marks = _lexicon(words, toxic)
    chunks = []
    for ws, y in zip(words, toxic.tolist(), strict=True):
        tags = [int(bool(y) and not marks.isdisjoint(features(w))) for w in ws]
        chunks += [(ws[i : i + CHUNK], tags[i : i + CHUNK]) for i in range(0, len(ws), CHUNK)]
    kinds = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in chunks for w in ws))}
    often = Counter(f for w in kinds for f in features(w)) + Counter("=" + w for ws, _ in chunks for w in ws)
    names = {f: i for i, f in enumerate(f for f, n in often.items() if n >= 3)}
    pairs = np.array([(i, names[f]) for w, i in kinds.items() for f in features(w) if f in names], np.int64).reshape(-1, 2)
    n = len(chunks)
    all_ids, all_tags, all_there = np.zeros((n, CHUNK), np.int32), np.zeros((n, CHUNK), np.int8), np.zeros((n, CHUNK), bool)
    for i, (ws, ts) in enumerate(chunks):
        all_ids[i, : len(ws)], all_tags[i, : len(ts)], all_there[i, : len(ws)] = [kinds[w] for w in ws], ts, True
    del chunks
    # every step takes the next sequences of a random order, so that all are used, in their own proportions, at bounded memory
    rng, parts = np.random.default_rng(seed), -(-n // AT_ONCE)
    steps = max(STEPS, 2 * parts)
    taken = (part for _ in range(-(-steps // parts)) for part in np.array_split(rng.permutation(n), parts))
    w, bias, trans, first = np.zeros(len(names)), model.bias, np.zeros((2, 2)), np.zeros(2)
    moments: dict[str, list] = defaultdict(lambda: [0.0, 0.0])
    for step in range(1, steps + 1):
        part = next(taken)
        ids, tags, there = all_ids[part], all_tags[part], all_there[part]
        first_there, token, size = there.copy(), ids[there], float(there.sum())
        first_there[:, 1:] = False
        pair_there = there[:, 1:] & there[:, :-1]
        empirical = np.array([[(pair_there & (tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        kind_scores = bias + np.bincount(pairs[:, 0], w[pairs[:, 1]], minlength=len(kinds))
        e = np.where(there, kind_scores[ids], 0.0)
        t, f0 = np.exp(trans), np.exp(first)
        emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -50, 50))], 2)
        alpha = np.empty((len(part), CHUNK, 2))
        beta = np.ones((len(part), CHUNK, 2))
        at = f0 * emit[:, 0]
        alpha[:, 0] = at = at / at.sum(1, keepdims=True)
        for k in range(1, CHUNK):
            nxt = (at @ t) * emit[:, k]
            at = np.where(there[:, k, None], nxt / nxt.sum(1, keepdims=True), at)
            alpha[:, k] = at
        for k in range(CHUNK - 2, -1, -1):
            nxt = (beta[:, k + 1] * emit[:, k + 1]) @ t.T
            beta[:, k] = np.where(there[:, k + 1, None], nxt / nxt.sum(1, keepdims=True), 1.0)
        p = alpha * beta
        p = p[..., 1] / p.sum(-1)
        joint = alpha[:, :-1, :, None] * t[None, None] * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint = (joint / joint.sum((2, 3), keepdims=True))[pair_there].sum(0)
        miss = (tags - p)[there]
        by_kind = np.bincount(token, miss, minlength=len(kinds))
        gradients = {
            "w": np.bincount(pairs[:, 1], by_kind[pairs[:, 0]], minlength=len(names)) / size - PENALTY * w / len(names),
            "bias": miss.sum() / size,
            "trans": (empirical - joint) / size,
            "first": np.array([-1.0, 1.0]) * (tags - p)[first_there].sum() / size,
        }
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))

        def adam(name: str, g):
            m = moments[name]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            return rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)

        w, bias, trans, first = w + adam("w", gradients["w"]), bias + adam("bias", gradients["bias"]), trans + adam("trans", gradients["trans"]), first + adam("first", gradients["first"])
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 0.05}
    model.bias, model.transitions, model.first = float(bias), trans, first
    x = []
    remembered: dict[str, float] = {}
    for at in range(0, len(words), 500):
        joined = [" ".join(ws) for ws in words[at : at + 500]]
        x.append(model.tag(joined, remembered, raw=True))
    x = np.concatenate(x)
    beta_ = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta_, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta_ = beta_ + np.linalg.solve(hessian, x.T @ (toxic - p) - 0.05 * beta_)
    model.document = beta_
    return model


def fit_sample(documents: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """A model from a bounded sample of the labelled documents, dealt by a hash of doc_id, and then of the text too.

    labels: (doc_id, toxic). Rows with a null in either column are left out; a document with two labels has the greater.
    A repeated document counts once; one doc_id with many texts is dealt again by text, so that the bound holds for rows, too.
    No labelled documents give a model that calls nothing toxic.
    """
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = documents.select("doc_id", "text")

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_toxic / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample_clean / max(1, sizes.get(0, 0)))))
        return rows.where(F.pmod(F.xxhash64(*by), F.lit(1_000_003)) / F.lit(1_000_003) < share)

    # at most some thousands of rows are broadcast, by the sample's bound
    digest = F.xxhash64("text")
    texts = docs.join(F.broadcast(dealt(own, "doc_id")), "doc_id").select("doc_id", "toxic", digest.alias("digest")).distinct()
    sample = dealt(cut(texts, "labelled"), "digest", "doc_id")
    rows = docs.join(F.broadcast(sample), "doc_id").where(digest == F.col("digest")).dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "toxic").toArrow().to_pydict()
    order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i], rows["text"][i] or ""))
    return fit([rows["text"][i] for i in order], [rows["toxic"][i] for i in order])


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score in 0..1, spans), and after doc_id the columns named in keep, for each row of documents (doc_id, text);
    nothing but the text is looked at.

    spans: array of (start, end, marginal), code points of the text, end exclusive. Null and empty texts and texts without words
    have no spans and the score of a text without toxic words. Repeated rows each get their row.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    remembered: dict[str, float] = {}

    def make(texts: list[str | None]) -> list[pa.Array]:
        scores, spans = held.value.tag(texts, remembered)
        return [pa.array(scores), pa.array([[{"start": a, "end": b, "marginal": p} for a, b, p in x] for x in spans], kind)]

    rows = documents.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_text"))
    return annotate(rows, ["_text"], {"score": "double", "spans": "array<struct<start:int,end:int,marginal:double>>"}, make, rows=400).drop("_text")


def held_out(doc_id):
    return F.pmod(crc_of_id(doc_id), F.lit(3)) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_sample(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
