"""Toxicity: bags of subword embeddings, averaged and scored by a linear softmax.

A document's bag holds the subwords of its most toxic words, chosen by the same softmax; its
score is the softmax of the averaged bag, with temperature and bias set on rows held back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.llm.text import (
    RangeHash,
    TextSlice,
    bounded_sample,
    held_out,
    learning_row,
    runs,
    text_slices,
    word_ranges,
)

GRAMS = (3, 4, 5, 6, 7, 8)  # bytes
BITS = 18
TOP_WORDS = 4
RUN_BYTES = 512
_BEGIN, _END = np.uint64(0x1F3D5B79), np.uint64(0x2468ACE135)


def pieces_of(s: TextSlice) -> tuple[np.ndarray, ...]:
    """Words, those over RUN_BYTES in pieces of whole characters: start, end, word start, word end,
    and the first piece of each row."""
    begin, stop, _ = word_ranges(s)
    start, end, word = runs(begin, stop, s.data, RUN_BYTES)
    return start, end, begin[word], stop[word], np.searchsorted(start, s.offsets)


def piece_keys(hashes: RangeHash, start, end, begin, stop) -> np.ndarray:
    """Equal for pieces of equal subwords; for a whole word, the hash of its bytes."""
    key = hashes.of(start, np.minimum(end + GRAMS[-1] - 1, stop))
    key ^= np.where(start > begin, _BEGIN, np.uint64(0))
    return key ^ np.where(end < stop, _END * (end - start).astype(np.uint64), np.uint64(0))


def subwords(
    hashes: RangeHash, start: np.ndarray, end: np.ndarray, begin: np.ndarray, stop: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start in a piece and of the piece itself, by piece.

    An n-gram at either end of a word is another one than inside. N-grams reach over the cuts
    of a long word, so each of its n-grams counts once.
    """
    first, last = [start], [end]
    word = [np.arange(len(start))]
    for n in GRAMS:
        count = np.maximum(np.minimum(end - start, stop - start - n + 1), 0)
        owner = np.repeat(np.arange(len(start)), count)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first.append(at)
        last.append(at + n)
        word.append(owner)
    a, b, w = (np.concatenate(x) for x in (first, last, word))
    key = hashes.of(a, b)
    key ^= np.where(a == begin[w], _BEGIN, np.uint64(0))
    key ^= np.where(b == stop[w], _END, np.uint64(0))
    key *= np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(w, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(start)))])
    return (key >> np.uint64(64 - BITS)).astype(np.int64)[order], bounds


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def segment_means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return segment_sums(values, bounds) / np.maximum(np.diff(bounds), 1)


def top_words(value: np.ndarray, first: np.ndarray, most: int = TOP_WORDS):
    """Indexes of the ``most`` words of highest value of each row, and their bounds."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    order = np.argsort(rows * 1e4 - np.clip(value, -1e3, 1e3), kind="stable")
    rank = np.arange(len(order)) - np.repeat(first[:-1], n)
    return order[rank < most], np.concatenate([[0], np.cumsum(np.minimum(n, most))])


def bag_logit(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of the averaged bag of each row's most toxic words, without the bias."""
    at, bounds = top_words(value, first)
    return segment_means(value[at], bounds)


@dataclass
class ToxicityModel:
    bucket: np.ndarray  # contribution of each subword bucket to the log odds
    slope: float  # inverse temperature of the softmax
    bias: float  # of the softmax, for the share of toxic rows
    base: float  # score of a text without words


class _Adam:
    def __init__(self, *shapes, rate: float):
        self.m = [np.zeros(s) for s in shapes]
        self.v = [np.zeros(s) for s in shapes]
        self.rate, self.t = rate, 0

    def step(self, params, grads):
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(
    texts: pa.Array,
    labels: np.ndarray,
    weights: np.ndarray,
    dim: int = 8,
    whole_rounds: int = 20,
    top_rounds: int = 60,
    least_docs: int = 4,
    seed: int = 5,
) -> ToxicityModel:
    """Embeddings and softmax learned together by gradient descent.

    First a document is the average of all its words; then it is that of its TOP_WORDS most
    toxic words, for a toxic document may be clean in most places. A fifth of the sample sets
    the softmax's temperature and bias; ``weights`` say how many rows each sampled one stands for.
    """
    keys, buckets, bounds, tokens, firsts, at = [], [], [np.zeros(1, np.int64)], [], [], 0
    for s in text_slices(texts):
        *parts, first = pieces_of(s)
        hashes = RangeHash(s.data)
        h = piece_keys(hashes, *parts)
        own, where = np.unique(h, return_index=True)
        b, bd = subwords(hashes, *(x[where] for x in parts))
        keys.append(own)
        buckets.append(b.astype(np.int32))
        bounds.append(bd[1:] + bounds[-1][-1])
        tokens.append(h)
        firsts.append(first[:-1] + at)
        at += len(h)
    first = np.concatenate([*firsts, [at]])
    every, pick = np.unique(np.concatenate(keys), return_index=True)
    flat, bd = np.concatenate(buckets), np.concatenate(bounds)
    size = np.diff(bd)[pick]
    new = np.concatenate([[0], np.cumsum(size)])
    flat = flat[np.repeat(bd[:-1][pick] - new[:-1], size) + np.arange(new[-1])]
    token = np.searchsorted(every, np.concatenate(tokens))
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.unique(rows * len(every) + token)
    docs_with = np.bincount(pair % len(every), minlength=len(every))
    seen = np.bincount(flat, np.repeat(docs_with, size), 1 << BITS)
    live = (seen >= least_docs).astype(float)
    del buckets, tokens, keys, pair
    kept = live[flat] > 0  # rare subwords stay at zero, so they need no place
    some = segment_sums(kept, new).astype(np.int64)
    flat, new = flat[kept], np.concatenate([[0], np.cumsum(some)])
    del kept

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, dim))
    out = rng.normal(0, 0.1, (dim, 2))
    bias = np.zeros(2)
    learns = rng.random(len(labels)) >= 0.2
    n = np.diff(first)
    balance = np.where(labels == 1, 1 / max(labels.sum(), 1), 1 / max((1 - labels).sum(), 1))
    balance *= learns

    def word_means(bucket):
        return segment_sums(bucket[flat], new) / size

    def word_values():
        return word_means(live * (emb @ (out[:, 1] - out[:, 0])))[token]

    for step in range(whole_rounds + top_rounds):
        if step in (0, whole_rounds):
            adam = _Adam(emb.shape, out.shape, bias.shape, rate=0.05)
        value = word_values()
        grad = np.zeros(len(token))
        if step < whole_rounds:
            full = np.flatnonzero(n)
            score = segment_means(value, first)[full] + bias[1] - bias[0]
            g = (_sigmoid(score) - labels[full]) * balance[full]
            grad = np.repeat(g / n[full], n[full])
        else:
            full = np.flatnonzero(n)
            at, cut = top_words(value, first)
            width = np.diff(cut)[full]
            score = segment_means(value[at], cut)[full] + bias[1] - bias[0]
            g = (_sigmoid(score) - labels[full]) * balance[full]
            grad[at] = np.repeat(g / width, width)
        by_word = np.bincount(token, grad, len(every))
        by_bucket = np.bincount(flat, (by_word / size).repeat(some), 1 << BITS)
        u = out[:, 1] - out[:, 0]
        d_out = emb.T @ by_bucket
        adam.step(
            (emb, out, bias),
            (
                by_bucket[:, None] * u + 1e-7 * emb,
                np.stack([-d_out, d_out], 1),
                np.array([-g.sum(), g.sum()]),
            ),
        )
    bucket = live * (emb @ (out[:, 1] - out[:, 0]))
    logit = bag_logit(word_means(bucket)[token], first)
    check = ~learns & (n > 0)
    if not (labels[check] == 1).any():
        check = n > 0
    slope, shift = calibrate(logit[check], labels[check], weights[check])
    base = float((labels * weights).sum() / weights.sum())
    return ToxicityModel(bucket, slope, shift, base)


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Inverse temperature and bias by a logistic fit of labels on log odds, with soft targets."""
    if not len(x):
        return 1.0, 0.0
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = w * len(w) / w.sum()
    hits = (w * y).sum()
    target = np.where(y == 1, (hits + 1) / (hits + 2), 1 / (len(w) - hits + 2))
    p, ridge = np.zeros(2), np.diag([0.5, 1e-6])
    for _ in range(100):
        q = _sigmoid(z @ p)
        g = z.T @ (w * (q - target)) + ridge @ p
        hess = (z * (w * q * (1 - q))[:, None]).T @ z + ridge
        move = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        p -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-9:
            break
    return float(p[0] / spread), float(p[1] - p[0] * mean / spread)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    toxic_docs: int = 800,
    clean_docs: int = 1600,
    total_chars: int = 5_000_000,
) -> ToxicityModel | None:
    """Fit on about so many labelled rows, or fewer if they hold over ``total_chars``.

    Labels are read for rows that ``learning_row`` allows only. None if either class lacks.
    """
    marked = (
        labels.where(learning_row(F.col("doc_id")) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return None
    most = {0: clean_docs, 1: toxic_docs}
    chosen = bounded_sample(marked.where("toxic = 0"), most[0], counts[0]).unionByName(
        bounded_sample(marked.where("toxic = 1"), most[1], counts[1])
    )
    texts = docs.where(learning_row(F.col("doc_id"))).select("doc_id", F.lower("text").alias("text"))
    sample = texts.join(chosen, "doc_id")
    # an id may have many rows, and a row a very long text
    size = sample.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    share = min(
        2 * (clean_docs + toxic_docs) / max(size.rows, 1), total_chars / max(size.chars or 0, 1)
    )
    if share < 1:
        drawn = F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
        sample = sample.where(drawn < share)
    sample = sample.orderBy("doc_id", "text").toArrow().combine_chunks()
    y = sample["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    stands_for = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    return train(sample["text"].combine_chunks(), y, stands_for)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; only the text is used.

    Null and empty texts get the share of toxic labels. If there was nothing to learn from,
    every score is 0.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, model.base if model else 0.0)
            for s in text_slices(batch.column("text")) if model else ():
                *parts, first = pieces_of(s)
                hashes = RangeHash(s.data)
                key = piece_keys(hashes, *parts)
                _, at, back = np.unique(key, return_index=True, return_inverse=True)
                bucket, bounds = subwords(hashes, *(x[at] for x in parts))
                value = segment_means(model.bucket[bucket], bounds)[back]
                p = _sigmoid(bag_logit(value, first) * model.slope + model.bias)
                out[s.first : s.first + s.rows] = np.where(np.diff(first) > 0, p, model.base)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(out),
                    pa.array((out >= least).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lower("text").alias("text")
    )
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def detect_toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Learn from the labelled rows that may be learned from, and score all rows.

    Columns used: doc_id, text; doc_id, toxic of ``labels``. A document that is labelled
    more than once is toxic if one label says so; labels other than 0 and 1, and null ones,
    are not read. Repeated rows have equal results. An empty table gives an empty result.
    """
    return score_toxicity(docs, learn(docs, labels, **bounds))
