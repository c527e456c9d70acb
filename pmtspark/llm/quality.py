"""Quality classifier: a label model over heuristic labellers, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.llm.text import TextSlice, mix64, text_slices, words

BAD, GOOD, SILENT = 0, 1, 2
BITS = 14
FIT_SLICE_BYTES = 1 << 18  # training arrays are built and read by such slices

_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.int8)
_CLASS[128:] = _LOWER  # letters outside ASCII; capitals among them are rare
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = _STOP
_CLASS[np.frombuffer(b"#*$%&|<>=_~^{}[]\\/@+`", np.uint8)] = _MARK


@dataclass(frozen=True)
class Labeller:
    """Votes bad from ``bad`` on and good up to ``good``, on one measure of the text."""

    measure: str
    good: float
    bad: float


LABELLERS = (
    Labeller("marks", 0.03, 0.10),  # share of bytes that are marks
    Labeller("capitals", 0.20, 0.50),  # share of ASCII letters in upper case
    Labeller("doubled_ends", 0.02, 0.20),  # words that end in a repeated stop or mark
    Labeller("marked_words", 0.05, 0.20),  # words that start or end in a mark
    Labeller("same_as_last", 0.05, 0.20),  # words equal to the word before
    Labeller("same_as_second", 0.10, 0.25),  # to the second word before
    Labeller("same_as_third", 0.10, 0.25),  # to the third
    Labeller("seen_words", 0.80, 0.95),  # words that occurred before in the text
    Labeller("lone_marks", 0.02, 0.15),  # words that are one mark
)


@dataclass
class Shapes:
    """Measures of each row of a slice, and its hashed features (row, bucket)."""

    measures: dict[str, np.ndarray]
    n: np.ndarray
    row: np.ndarray
    bucket: np.ndarray


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def shapes(s: TextSlice) -> Shapes:
    w = words(s)
    n, row = np.diff(w.first), w.rows()
    kind = _CLASS[s.data]
    inside = lambda k: np.diff(
        np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])[s.offsets]
    )
    first, last = (kind[x].astype(np.int64) for x in (w.start, w.end - 1))
    before = np.maximum(w.end - 2, w.start)
    sign = (last == _STOP) | (last == _MARK)
    doubled = sign & (s.data[before] == s.data[w.end - 1]) & (w.end - w.start > 1)
    lone = (w.end - w.start == 1) & (last == _MARK)

    def same_as(back: int) -> np.ndarray:
        out = np.zeros(len(row), bool)
        out[back:] = (w.hash[back:] == w.hash[:-back]) & (row[back:] == row[:-back])
        return out

    again = same_as(1)
    order = np.lexsort((np.arange(len(row)), w.hash, row))
    seen = np.zeros(len(row), bool)
    same = (w.hash[order][1:] == w.hash[order][:-1]) & (row[order][1:] == row[order][:-1])
    seen[order[1:]] = same
    per_row = lambda x: np.bincount(row, x, s.rows)
    upper = inside(_UPPER)
    measures = {
        "marks": _ratio(inside(_MARK), np.diff(s.offsets)),
        "capitals": _ratio(upper, upper + inside(_LOWER)),
        "doubled_ends": _ratio(per_row(doubled), n),
        "marked_words": _ratio(per_row((first == _MARK) | (last == _MARK)), n),
        "same_as_last": _ratio(per_row(again), n),
        "same_as_second": _ratio(per_row(same_as(2)), n),
        "same_as_third": _ratio(per_row(same_as(3)), n),
        "seen_words": _ratio(per_row(seen), n),
        "lone_marks": _ratio(per_row(lone), n),
    }
    second = kind[np.minimum(w.start + 1, w.end - 1)].astype(np.int64)
    length = np.minimum(np.log2(w.end - w.start).astype(np.int64), 5)
    shape = ((first * 6 + second) * 6 + last) * 6 + length
    shape = (shape * 2 + doubled) * 2 + again
    pair = np.zeros(len(row), np.int64)
    pair[1:] = np.where(row[1:] == row[:-1], shape[:-1] + 1, 0)
    code = np.concatenate([shape, (pair << 20) | shape | (1 << 40)]).astype(np.uint64)
    bucket = (mix64(code) >> np.uint64(64 - BITS)).astype(np.int64)
    return Shapes(measures, n, np.concatenate([row, row]), bucket)


def votes(shape: Shapes, labellers: tuple[Labeller, ...] = LABELLERS) -> np.ndarray:
    """Votes of each row as one number in base 3; a row without words has none."""
    out = np.zeros(len(shape.n), np.int64)
    for k, x in enumerate(labellers):
        v = shape.measures[x.measure]
        vote = np.where(v >= x.bad, BAD, np.where(v <= x.good, GOOD, SILENT))
        out += 3**k * np.where(shape.n > 0, vote, SILENT)
    return out


@dataclass
class LabelModel:
    """Share of good texts, and what each labeller votes on bad and on good ones."""

    good: float
    rates: np.ndarray  # labeller, class, vote

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good, given votes; silence says nothing."""
        odds = np.full(len(pattern), np.log(self.good / (1 - self.good)))
        for k, rate in enumerate(self.rates):
            vote = pattern // 3**k % 3
            odds += np.where(vote == SILENT, 0, np.log(rate[GOOD, vote] / rate[BAD, vote]))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_labels(pattern: np.ndarray, count: np.ndarray, labellers: int, rounds: int = 200):
    """Expectation-maximisation over counts of vote patterns (at most 3 ** labellers)."""
    rates = np.tile(np.array([[0.3, 0.6, 0.1], [0.02, 0.93, 0.05]]), (labellers, 1, 1))
    model = LabelModel(0.8, rates)
    prior = rates * 0.01 * max(count.sum(), 1)  # starting beliefs count as a hundredth of the rows
    for _ in range(rounds):
        p = model.posterior(pattern)
        weight = np.stack([1 - p, p]) * count
        new = prior.copy()
        for k in range(labellers):
            for c in (BAD, GOOD):
                new[k, c] += np.bincount(pattern // 3**k % 3, weight[c], 3)
        rates = new / new.sum(axis=2, keepdims=True)
        good = (weight[GOOD].sum() + 0.8) / (weight.sum() + 1)
        moved = abs(good - model.good) + np.abs(rates - model.rates).max()
        model = LabelModel(float(np.clip(good, 1e-6, 1 - 1e-6)), rates)
        if moved < 1e-9:
            break
    return model


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, shape: Shapes) -> np.ndarray:
        total = np.bincount(shape.row, self.weight[shape.bucket], len(shape.n))
        odds = total / np.maximum(shape.n, 1) + self.bias
        return np.where(shape.n > 0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))), 0.0)


def fit_scorer(texts: pa.Array, label: LabelModel, rounds: int = 200) -> Scorer:
    """Logistic regression of posterior labels on hashed word shapes, by gradient descent."""
    blocks, total = [], 0  # of each slice: row, bucket and value of its features; its goals
    for s in text_slices(texts, FIT_SLICE_BYTES):
        shape = shapes(s)
        pair, count = np.unique(shape.row * (1 << BITS) + shape.bucket, return_counts=True)
        row, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
        value = (count / np.maximum(shape.n, 1)[row]).astype(np.float32)
        full = shape.n > 0
        goal = np.where(full, label.posterior(votes(shape)), 0)
        blocks.append((row.astype(np.int32), bucket.astype(np.int16), value, goal, full))
        total += full.sum()
    weight, bias = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for t in range(1, (rounds if total else 0) + 1):
        grad, lean = 1e-6 * weight, 0.0
        for row, bucket, value, goal, full in blocks:
            odds = np.bincount(row, weight[bucket] * value, len(goal)) + bias
            g = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - goal) * full / total
            grad += np.bincount(bucket, g[row] * value, 1 << BITS)
            lean += g.sum()
        m, mb = m + 0.1 * (grad - m), mb + 0.1 * (lean - mb)
        v, vb = v + 0.01 * (grad**2 - v), vb + 0.01 * (lean**2 - vb)
        scale = 0.2 / (1 - 0.9**t), np.sqrt(1 - 0.99**t)
        weight = weight - scale[0] * m * scale[1] / (np.sqrt(v) + 1e-8)
        bias = bias - scale[0] * mb * scale[1] / (np.sqrt(vb) + 1e-8)
    return Scorer(weight, float(bias))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def count_votes(docs: DataFrame) -> DataFrame:
    """Rows of each pattern of votes and the bytes of their texts, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = list(text_slices(batch.column(0)))
            found = np.concatenate([votes(shapes(s)) for s in slices])
            size = np.concatenate([np.diff(s.offsets) for s in slices])
            pattern, place, n = np.unique(found, return_inverse=True, return_counts=True)
            total = np.bincount(place, size, len(pattern)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pattern), pa.array(n), pa.array(total)], ["pattern", "n", "bytes"]
            )

    found = docs.select("text").mapInArrow(count, "pattern long, n long, bytes long")
    return found.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def learn(
    docs: DataFrame, docs_to_fit: int = 6000, total_bytes: int = 30_000_000
) -> QualityModel:
    """Label model from the votes on all documents; scorer from about ``docs_to_fit`` of them.

    They are fewer if they would hold over ``total_bytes``. Nothing marked by hand is read.
    """
    table = count_votes(docs).toPandas()  # at most 3 ** labellers rows
    label = fit_labels(table["pattern"].to_numpy(), table["n"].to_numpy(float), len(LABELLERS))
    total = int(table["n"].sum())
    share = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1_000_000)) / 1_000_000
    most = min(docs_to_fit / max(total, 1), total_bytes / max(int(table["bytes"].sum()), 1))
    chosen = docs.where(share < most) if most < 1 else docs
    sample = chosen.dropDuplicates(["text"]).select("text").orderBy("text").toArrow()
    return QualityModel(label, fit_scorer(sample["text"].combine_chunks(), label))


def score_quality(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """doc_id, label (posterior of the votes), score of the scorer, and kept, of every text.

    Null texts and texts without words have score 0 and are not kept.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shapes(s) for s in text_slices(batch.column("text"))]
            label = np.concatenate([model.labels.posterior(votes(x)) for x in found])
            value = np.concatenate([model.scorer.score(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (label, value, value >= least))],
                ["doc_id", "label", "score", "kept"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, label double, score double, kept boolean"
    )


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows whose text the scorer accepts, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scorer.score(shapes(s)) for s in text_slices(batch.column("text"))]
            yield batch.filter(pa.array(reduce(lambda a, b: np.append(a, b), found) >= least))

    return docs.mapInArrow(keep, docs.schema)


def classify_quality(docs: DataFrame, **bounds: int) -> DataFrame:
    """Learn from the documents' own votes and score all of them, one row per row.

    Columns used: doc_id, text. Repeated rows have equal results. An empty table gives an
    empty result.
    """
    return score_quality(docs, learn(docs, **bounds))
