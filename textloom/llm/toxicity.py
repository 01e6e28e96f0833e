"""Toxicity (3): a linear-chain conditional random field over words, trained on documents' labels.

Learning. A sample of at most MOST_DOCS labelled documents of each class and about MOST_CHARS characters (one document
at least) goes to the driver; near copies in it count once. Words and word beginnings that toxic documents hold far more often than clean
ones mark their places in toxic documents as toxic tokens; all others are clean. On sentences with such tokens, and
others for contrast, the field (two states, word features, transitions) is fitted by gradient steps on its likelihood.

Scoring. Every whole text is cut into words and sentences; forward and backward passes give each word's marginal
probability. They run over all sentences of a slice at once, position by position. Marginals of at least LEAST_MASS are
summed and the largest is taken; a logistic function of both, fitted on the sample, is the document's score. Words with
a marginal of 0.5 or more are its offending spans; neighbours join.

Labels reach a score only through the fitted model, and only from documents whose crc32(doc_id) modulo 5 is not 0.
lang, source and doc_id are never inputs.

Defined cases: null and empty texts have no words and get the score of a document without a sign of toxicity; null
doc_ids are not learnt from and not held out; a document with several labels is toxic if one says so; null labels are
skipped; without labels of both classes every score is 0; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCoder, chunks_of, slices
from .common import Workspace, returns_memory, ship, text_or_empty

#: The sample that the model is fitted on: documents of each class, and characters of each.
MOST_DOCS, MOST_CHARS = 2_000, 3_000_000
FOLDS = 5
#: Weights of hashed word features; lengths of the word beginnings that are features.
WEIGHTS, PREFIXES = 1 << 18, (4, 5, 6)
#: A sign of toxicity: distinct toxic documents that hold it, how many times likelier it is in them, and how surprising
#: that is (documents times the logarithm of the toxic share among them against that of the sample).
LEAST_DOCS, LEAST_ODDS, LEAST_SURPRISE = 3, 12.0, 8.0
LEAST_MASS = 0.2
STEPS, RATE, DECAY = 60, 0.3, 1e-4
#: Bytes of text scored together, and chunks that a worker remembers.
SLICE_BYTES, CACHE_CHUNKS = 3_000_000, 200_000
RESULT = "doc_id long, held_out boolean, score double, predicted int, span_starts array<int>, span_ends array<int>"

_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
#: White space besides spaces and line feeds parts words as well; it is as long as a space.
_OTHER_SPACE = r"[\x09\x0B-\x0D]"


def word_of(chunk: str) -> str:
    """The word of a chunk: lower case, without punctuation around it."""
    return _EDGE.sub("", chunk.lower())


def features_of(word: str) -> list[int]:
    data = word.encode()
    return [zlib.crc32(b"w" + data) % WEIGHTS, *(zlib.crc32(b"p" + word[:n].encode()) % WEIGHTS for n in PREFIXES if len(word) >= n)] if word else []


def chains(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of chains; ends marks their last tokens."""
    last = np.flatnonzero(ends)
    starts = np.append(0, last[:-1] + 1) if len(last) else np.zeros(0, np.int64)
    return starts, last - starts + 1


def marginals(emission: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the probability of being toxic, and of a toxic one being followed by a toxic one (pairs by the first).

    emission: the log-odds of a token's word; trans: weights [from][to] as factors. Both passes run on the ratio of the
    two states, for all chains together from their longest to their shortest.
    """
    n = len(emission)
    starts, lengths = chains(ends)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    odds = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.empty(n), np.ones(n)
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    (oo, ot), (to, tt) = trans
    r = None
    for t, k in enumerate(active):
        at = starts[:k] + t
        r = odds[at] if r is None else odds[at] * (ot + tt * r[:k]) / (oo + to * r[:k])
        forward[at] = r
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        x = odds[at + 1] * backward[at + 1]
        backward[at] = (to + tt * x) / (oo + ot * x)
    both = forward * backward
    p = both / (1 + both)
    # Pairs: weight of (toxic, toxic) among the four of a token and its successor.
    pair = np.zeros(n)
    inner = np.flatnonzero(~ends)
    f, x = forward[inner], odds[inner + 1] * backward[inner + 1]
    pair[inner] = f * tt * x / (oo + ot * x + f * to + f * tt * x)
    return p, pair


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    scale: np.ndarray  # of 1, log(1 + mass) and the largest marginal

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features_of(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((f for x in found for f in x), np.int64, int(sizes.sum()))
        return self.bias + np.bincount(np.repeat(np.arange(len(found)), sizes), self.weights[flat], len(found))

    def score(self, mass: np.ndarray, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] + self.scale[1] * np.log1p(mass) + self.scale[2] * top)))


class Scorer:
    """Marginals and document sums of texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # A chunk's "ids" are its emission, whether it is a word and whether it ends a sentence.
        self.chunks = ChunkCoder(self._of, CACHE_CHUNKS)

    def _of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [word_of(c) for c in chunks]
        rows = np.stack([self.model.emissions(words), [bool(w) for w in words], [c[-1:] in (".", "!", "?") for c in chunks]], 1)
        return np.full(len(chunks), 3), rows.ravel()

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text mass and largest marginal; of all chunks offsets, numbers of the distinct ones, marginals."""
        offsets, coded, distinct = chunks_of(pc.replace_substring_regex(texts, _OTHER_SPACE, " "))
        if not len(coded):
            return np.zeros(len(texts)), np.zeros(len(texts)), offsets, coded, np.zeros(0)
        at = self.chunks.numbers(distinct)[coded]
        rows = self.chunks.ids.reshape(-1, 3)
        is_word = rows[at, 1] > 0
        ends = rows[at, 2] > 0
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
        # The end of a sentence moves to its last word.
        word = np.flatnonzero(is_word)
        sentence = np.append(0, np.cumsum(ends))[word]
        last = np.append(sentence[1:] != sentence[:-1], True)[: len(word)]
        p = np.zeros(len(coded))
        if len(word):
            p[word] = marginals(rows[at[word], 0], last, self.model.trans)[0]
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        high = p >= LEAST_MASS
        mass = np.bincount(owner[high], p[high], len(texts))
        top = np.zeros(len(texts))
        some = np.diff(offsets) > 0
        top[some] = np.maximum.reduceat(p, offsets[:-1][some])
        return mass, top, offsets, coded, p

    def spans(self, texts: pa.Array, offsets: np.ndarray, p: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """Character offsets of the words with a marginal of 0.5 or more; neighbours join."""
        starts: list[list[int]] = [[] for _ in range(len(texts))]
        stops: list[list[int]] = [[] for _ in range(len(texts))]
        hit = np.flatnonzero(p >= 0.5)
        owner = np.searchsorted(offsets, hit, "right") - 1
        for i in np.unique(owner).tolist():
            parts = regex.split(r"[\x20\x09-\x0D]", texts[i].as_py())
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            begins = np.cumsum(sizes) - sizes
            before = -2
            for k in (hit[owner == i] - offsets[i]).tolist():
                # The word itself, without the punctuation around it.
                word = _EDGE.sub("", parts[k])
                a = int(begins[k]) + parts[k].index(word)
                b = a + len(word)
                if k == before + 1:
                    stops[i][-1] = b
                else:
                    starts[i].append(a)
                    stops[i].append(b)
                before = k
        return starts, stops


def distinct_documents(words: list[list[str]]) -> list[int]:
    """One document of each group of near copies in a sample: those that share a pair of minima of 3-word shingles."""
    rng = np.random.default_rng(5)
    mults = rng.integers(1, 1 << 62, 16, dtype=np.uint64) | np.uint64(1)
    parent = list(range(len(words)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    for i, doc in enumerate(words):
        codes = np.fromiter((zlib.crc32(w.encode()) for w in doc), np.uint64, len(doc))
        if len(codes) >= 3:
            codes = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1]) * np.uint64(0xD6E8FEB86659FD93) ^ codes[2:]
        if not len(codes):
            continue
        low = ((codes[None, :] * mults[:, None]) ^ (codes[None, :] >> np.uint64(17))).min(1)
        for band in range(8):
            key = (band, int(low[2 * band]), int(low[2 * band + 1]))
            j = seen.setdefault(key, i)
            parent[root(i)] = root(j)
    return [i for i in range(len(words)) if root(i) == i]


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """The model of a sample of whole texts and their labels; None if a class is missing."""
    same: dict[str, str] = {}  # one copy of each chunk
    chunked = [[same.setdefault(c, c) for c in regex.split(r"[\x20\x09-\x0D]", t)] for t in texts]
    memo: dict[str, str] = {}
    for doc in chunked:
        for c in doc:
            if c not in memo:
                memo[c] = word_of(c)
    kept = distinct_documents([[w for c in doc if (w := memo[c])] for doc in chunked])
    texts, chunked, toxic = [texts[i] for i in kept], [chunked[i] for i in kept], toxic[kept]
    n_toxic, n_clean = int(toxic.sum()), int((toxic == 0).sum())
    if not n_toxic or not n_clean:
        return None
    feature: dict[str, list[int]] = {w: features_of(w) for w in set(memo.values())}
    held = [np.zeros(WEIGHTS), np.zeros(WEIGHTS)]
    for doc, label in zip(chunked, toxic, strict=True):
        own = {f for c in doc for f in feature[memo[c]]}
        held[int(label)][np.fromiter(own, np.int64, len(own))] += 1
    odds = ((held[1] + 0.1) / (n_toxic + 0.2)) / ((held[0] + 0.1) / (n_clean + 0.2))
    share = held[1] / np.maximum(held[0] + held[1], 1) * (n_toxic + n_clean) / n_toxic
    sign = (held[1] >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (held[1] * np.log(np.maximum(share, 1)) >= LEAST_SURPRISE)

    # Sentences of the sample: all with a sign, and as many others thrice, evenly over the sample.
    with_sign: list[tuple[list[str], list[int]]] = []
    without: list[tuple[list[str], list[int]]] = []
    for doc, label in zip(chunked, toxic, strict=True):
        words: list[str] = []
        for k, c in enumerate(doc):
            if memo[c]:
                words.append(memo[c])
            if words and (c[-1:] in (".", "!", "?") or k == len(doc) - 1):
                signs = [int(sign[feature[w]].any()) for w in words]
                tags = signs if label else [0] * len(words)
                (with_sign if any(signs) else without).append((words, tags))
                words = []
    step = max(1, len(without) // max(1, 3 * len(with_sign), 3000))
    rows = with_sign + without[::step]
    number: dict[str, int] = defaultdict(lambda: len(number))
    token = np.array([number[w] for words, _ in rows for w in words], np.int64)
    y = np.array([t for _, tags in rows for t in tags], float)
    ends = np.zeros(len(token), bool)
    ends[np.cumsum([len(words) for words, _ in rows]) - 1] = True
    used = [feature[w] for w in number]
    sizes = np.array([len(x) for x in used])
    flat, owner = np.array([f for x in used for f in x], np.int64), np.repeat(np.arange(len(used)), sizes)

    del feature, memo, held, odds, share, sign, chunked, with_sign, without, rows, number, used
    model = Model(np.zeros(WEIGHTS), -3.0, np.ones((2, 2)), np.zeros(3))
    log_trans, inner = np.zeros((2, 2)), np.flatnonzero(~ends)
    seen_pairs = _pairs(y[inner], y[inner + 1], y[inner] * y[inner + 1])
    past_w, past_b, past_t = np.full(WEIGHTS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(STEPS if len(token) else 0):
        emission = (model.bias + np.bincount(owner, model.weights[flat], len(sizes)))[token]
        p, pair = marginals(emission, ends, np.exp(log_trans))
        error = np.bincount(token, y - p, len(sizes))
        g_w = np.bincount(flat, error[owner], WEIGHTS) - DECAY * len(token) * model.weights
        g_t = seen_pairs - _pairs(p[inner], p[inner + 1], pair[inner])
        g_b = float(error.sum())
        past_w, past_b, past_t = past_w + g_w**2, past_b + g_b**2, past_t + g_t**2
        model.weights = model.weights + RATE * g_w / np.sqrt(past_w)
        model.bias += RATE * g_b / np.sqrt(past_b)
        log_trans = log_trans + RATE * g_t / np.sqrt(past_t)
    model.trans = np.exp(log_trans)

    scorer = Scorer(model)
    mass, top = np.zeros(len(texts)), np.zeros(len(texts))
    for a in range(0, len(texts), 500):
        mass[a : a + 500], top[a : a + 500] = scorer.run(pa.array(texts[a : a + 500]))[:2]
    x = np.stack([np.ones(len(texts)), np.log1p(mass), top], 1)
    model.scale = _logistic(x, toxic.astype(float))
    model.weights = model.weights.astype(np.float32)
    return model


def _pairs(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Sums over pairs of neighbours: [from][to]."""
    tt, t_, _t = both.sum(), a.sum(), b.sum()
    return np.array([[len(a) - t_ - _t + tt, _t - tt], [t_ - tt, tt]])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.5 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the documents that may be learnt from; see the module for the bounds of the sample."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0))
    known = known.groupBy(F.col("doc_id").alias("_tl_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.pmod(F.xxhash64(F.lit(7), "_tl_id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("toxic") == c, F.lit(min(1.0, MOST_DOCS / n) * (1 << 30))) for c, n in counts.items()], F.lit(0.0))
    sample = F.broadcast(known.where(order < share))  # at most about 2 * MOST_DOCS rows
    work = Workspace(spark, "toxic")
    rows = docs.join(sample, F.col("doc_id") == F.col("_tl_id")).select("doc_id", "text", "toxic").where(F.col("text").isNotNull())
    rows = work.save(rows, "sample")
    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id", "text"), F.lit(1 << 30))
    chars = {r["toxic"]: (r["n"], r["least"]) for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n"), F.min(draw).alias("least")).collect()}
    # However long its documents are, a class has one at least.
    limit = F.coalesce(*[F.when(F.col("toxic") == c, F.lit(max(least + 1.0, min(1.0, MOST_CHARS / max(1, n)) * (1 << 30)))) for c, (n, least) in chars.items()], F.lit(0.0))
    pdf = rows.where(draw < limit).orderBy("doc_id", "text").toPandas()
    texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy(np.int64)
    del pdf
    return fit(texts, toxic) if len(texts) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """RESULT of each document."""
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text")
            if scorer:
                mass, top, offsets, _, p = scorer.run(texts)
                value = scorer.model.score(mass, top)
                starts, stops = scorer.spans(texts, offsets, p)
            else:
                value, starts, stops = np.zeros(len(texts)), [[]] * len(texts), [[]] * len(texts)
            spans = [pa.array(x, pa.list_(pa.int32())) for x in (starts, stops)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), *spans], ["doc_id", "held_out", "score", "predicted", "span_starts", "span_ends"])

    return rows.mapInArrow(returns_memory(run), RESULT)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose score is below 0.5, with their own columns."""
    if model is None:
        return docs
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "_tl_text", SLICE_BYTES):
            mass, top = scorer.run(batch.column("_tl_text"))[:2]
            clean = batch.filter(pa.array(scorer.model.score(mass, top) < 0.5))
            yield pa.RecordBatch.from_arrays([clean.column(i) for i in range(len(names))], names)

    return docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty().alias("_tl_text")).mapInArrow(returns_memory(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
