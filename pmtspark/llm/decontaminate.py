"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Distances are counted in words. The CGK embedding turns edit distance into Hamming
distance: a walk over the words writes the current word and moves on by a random bit that
depends on step and word, so two texts walk together again soon after a difference.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.llm.text import HashIndex, TextSlice, Words, mix64, script_words, text_slices

RATE = 0.2  # edits per word of the item
RECALL = 0.999
SAMPLED = 2  # positions of an embedding that make one key
HAMMING = 0.5  # share of positions that may differ within RATE, for the number of keys
WALKS = 4
BLOCK_ITEMS = 5000

_PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 0x20
_PLAIN[65:91] += 32


def plain(s: TextSlice) -> TextSlice:
    """ASCII letters and capitals of Latin-1 in lower case, sharp s as ss, marks as spaces.

    Marks are those of ASCII, U+3000 to U+303F and the full-width ones before and after digits.
    """
    data = _PLAIN[s.data]
    wide = np.flatnonzero(s.data[:-2] >= 0xE3) if len(s.data) > 2 else np.zeros(0, np.int64)
    a, b, c = s.data[wide], s.data[wide + 1], s.data[wide + 2]
    mark = (a == 0xE3) & (b == 0x80)
    mark |= (a == 0xEF) & (b == 0xBC) & ((c <= 0x8F) | ((c >= 0x9A) & (c <= 0xA0)))
    for k in range(3):
        data[wide[mark] + k] = 0x20
    after = np.flatnonzero(s.data[:-1] == 0xC3) + 1
    capital = after[(s.data[after] >= 0x80) & (s.data[after] <= 0x9E) & (s.data[after] != 0x97)]
    data[capital] += 0x20
    sharp = after[s.data[after] == 0x9F]  # its capital is SS, of as many bytes
    data[sharp - 1] = data[sharp] = ord("s")
    return TextSlice(s.first, s.rows, data, s.offsets)


def keys_needed(recall: float = RECALL, hamming: float = HAMMING, sampled: int = SAMPLED) -> int:
    """Keys so that one at least is shared with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - hamming) ** sampled))


def edits_allowed(n: int, rate: float) -> int:
    return int(n * rate + 1e-9)


def seed_words(n: int, rate: float) -> int:
    """With so many edits at most, some run of so many words is left as it was."""
    return n // (edits_allowed(n, rate) + 1)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, where there are so many."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix64(out)


def embed(h: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK embedding of word ranges: the words met in ``steps`` steps, 0 after the end."""
    out = np.zeros((len(start), steps), np.uint64)
    at = start.copy()
    for j in range(steps):
        inside = at < end
        if not inside.any():
            break
        word = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        out[:, j] = word
        move = mix64(word ^ np.uint64((walk + 1) * 0x1000003 + j * 0x9E3779B1)) >> np.uint64(63)
        at = at + move.astype(np.int64)
    return out


def sample_keys(embedded: np.ndarray, n: int, walk: int, tables: int) -> np.ndarray:
    """Keys of embeddings of ``n`` words: each a hash of SAMPLED of the first 3 n positions."""
    spots = np.random.default_rng([n, walk]).integers(0, 3 * n, (tables, SAMPLED))
    key = np.broadcast_to(
        np.arange(tables, dtype=np.uint64) + np.uint64((n * 64 + walk) * 4096),
        (len(embedded), tables),
    ).copy()
    for k in range(SAMPLED):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ embedded[:, spots[:, k]])
    return key


def edit_distance_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits that make the item from some part of the region, and where it ends."""
    j = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for word in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min()), int(row.argmin())


@dataclass
class Benchmark:
    """Items as words, the index of their unchanged runs, and that of their LSH keys."""

    ids: list
    items: list[np.ndarray]
    rate: float
    id_type: pa.DataType

    def __post_init__(self):
        self.tables = -(-keys_needed() // WALKS)
        runs: dict[int, dict[int, set[tuple[int, int]]]] = {}
        keys: dict[int, list[int]] = {}
        for i, h in enumerate(self.items):
            n, s = len(h), seed_words(len(h), self.rate)
            for q, key in enumerate(run_hashes(h, s).tolist()):
                runs.setdefault(s, {}).setdefault(key, set()).add((n, q))
            one = np.zeros(1, np.int64)
            for walk in range(WALKS):
                e = embed(h, one, one + n, 3 * n, walk)
                for key in sample_keys(e, n, walk, self.tables)[0].tolist():
                    keys.setdefault(key, []).append(i)
        self.runs = {}
        for s, found in runs.items():
            ordered = sorted(found)
            places = [sorted(found[k]) for k in ordered]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in places])])
            flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 2)
            self.runs[s] = HashIndex(np.array(ordered, np.uint64)), bounds, flat
        ordered = sorted(keys)
        self.key_index = HashIndex(np.array(ordered, np.uint64))
        self.key_items = [keys[k] for k in ordered]

    def windows(self, w: Words) -> np.ndarray:
        """Item-sized windows around runs that some item has: (row, start, end, n), each once."""
        rows, found = w.rows(), []
        for s, (index, bounds, places) in self.runs.items():
            at, seed = index.hits(run_hashes(w.hash, s))
            inside = rows[at] == rows[at + s - 1] if len(at) else np.zeros(0, bool)
            at, seed = at[inside], seed[inside]
            count = bounds[seed + 1] - bounds[seed]
            spot = np.repeat(bounds[seed] - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(at, count)
            n, q = places[spot, 0], places[spot, 1]
            row = rows[at] if len(at) else at
            start = np.maximum(at - q, w.first[row])
            found.append(np.stack([row, start, np.minimum(start + n, w.first[row + 1]), n], 1))
        both = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        return np.unique(both, axis=0)

    def matches(self, s: TextSlice) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, first word) of the best match of each item within its limit."""
        w = script_words(plain(s))
        windows = self.windows(w)
        if not len(windows):
            return []
        candidates = set()
        steps = 3 * int(windows[:, 3].max())
        for walk in range(WALKS):
            e = embed(w.hash, windows[:, 1], windows[:, 2], steps, walk)
            for n in np.unique(windows[:, 3]).tolist():
                own = np.flatnonzero(windows[:, 3] == n)
                key = sample_keys(e[own], n, walk, self.tables)
                at, hit = self.key_index.hits(key.ravel())
                for window, k in zip(own[at // self.tables].tolist(), hit.tolist(), strict=True):
                    candidates.update((window, i) for i in self.key_items[k])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for window, i in sorted(candidates):
            row, start, _, n = windows[window].tolist()
            most = edits_allowed(n, self.rate)
            if best.get((row, i), (most + 1,))[0] == 0:
                continue
            a = max(start - most, w.first[row])
            b = min(start + n + most, w.first[row + 1])
            edits, end = edit_distance_within(self.items[i], w.hash[a:b])
            if edits <= most and edits < best.get((row, i), (most + 1,))[0]:
                best[row, i] = edits, int(max(a + end - n, w.first[row]) - w.first[row])
        return [(row, i, *found) for (row, i), found in sorted(best.items())]


def benchmark_blocks(
    benchmark: DataFrame, rate: float, block: int = BLOCK_ITEMS
) -> Iterator[Benchmark]:
    """The items in blocks of about ``block``; a block is what a task holds at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    blocks = -(-items.count() // block)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        table = own.distinct().orderBy("item_id", "text").toArrow().combine_chunks()
        ids, hashes = [], []
        names = table["item_id"].to_pylist()
        for s in text_slices(table["text"].combine_chunks()) if len(table) else ():
            w = script_words(plain(s))
            for r in range(s.rows):
                own_words = w.hash[w.first[r] : w.first[r + 1]]
                if len(own_words):
                    ids.append(names[s.first + r])
                    hashes.append(own_words)
        if ids:
            yield Benchmark(ids, hashes, rate, table["item_id"].type)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, edits, item_words, first_word.

    A row for each document row and item such that some part of the text, in words without
    case and ASCII marks, differs from the item by at most ``rate`` edits a word; the part
    with fewest edits is given, the first of several. Columns used: doc_id, text; item_id,
    text.

    With so few edits some run of words is left unchanged, so windows of the item's size
    are laid only around runs that an item has; their CGK embeddings are looked up among
    those of the items, and what is found is compared exactly. Null and empty texts have no
    match, nor has an item without words. Items too short for an edit (under five words) are
    found where they stand word by word. In scripts without spaces a character is a word.
    Very long texts are searched whole, and memory follows the longest. Repeated documents are searched one by one; equal items count once for each id. Tasks
    hold one block of items, and every block reads all documents.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, item_words int, first_word long"

    def search(block: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    (s.first + row, i, edits, at)
                    for s in text_slices(batch.column("text"))
                    for row, i, edits, at in block.matches(s)
                ]
                rows = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        pa.array([block.ids[x[1]] for x in found], block.id_type),
                        pa.array([x[2] for x in found], pa.int32()),
                        pa.array([len(block.items[x[1]]) for x in found], pa.int32()),
                        pa.array([x[3] for x in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "item_words", "first_word"],
                )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark, rate):
        out = out.unionByName(search(block))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Documents in which ``find_leaks`` finds no item, with all their columns."""

    def clean(block: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for s in text_slices(batch.column("text")):
                    keep[[s.first + m[0] for m in block.matches(s)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in benchmark_blocks(benchmark, rate):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs
