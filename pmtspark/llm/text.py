"""Words of Arrow text columns as numpy arrays, and small helpers of the operators.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, ``[^\\x20\\x09-\\x0D]+``. Texts are worked on in slices of whole
documents, so memory follows the slice, or the longest document where that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 21

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUE = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class TextSlice:
    """Rows ``first`` to ``first + rows`` of a column, as one run of UTF-8 bytes."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8")


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Slices of about ``limit`` bytes of whole texts; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        start = offsets[first]
        own = offsets[first : last + 1] - start
        yield TextSlice(first, last - first, data[start : start + own[-1]], own)
        first = last


@dataclass
class Words:
    """Byte range and hash of each word; words of row i are ``first[i]`` to ``first[i+1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.concatenate(
                [np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))]
            )
    return _powers["up"], _powers["down"]


class RangeHash:
    """Hash of any byte range of a slice in constant time."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start])


def hash_strings(texts: list[str]) -> np.ndarray:
    """Hashes equal to those of ``RangeHash`` over the same bytes."""
    parts = [t.encode("utf-8") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return RangeHash(data).of(ends - np.array([len(p) for p in parts], np.int64), ends)


def word_ranges(s: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first word of each row."""
    space = _IS_SPACE[s.data]
    before = np.ones(len(space), bool)
    before[1:] = space[:-1]
    after = np.ones(len(space), bool)
    after[:-1] = space[1:]
    full = s.offsets[:-1][np.diff(s.offsets) > 0]
    before[full] = True
    after[full[1:] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(start, s.offsets)


def runs(start: np.ndarray, end: np.ndarray, data: np.ndarray, most: int):
    """Byte ranges cut to ``most`` bytes, on character bounds; and the range each comes from."""
    pieces = np.maximum(-(-(end - start) // most), 1)
    if not len(pieces) or pieces.max() == 1:
        return start, end, np.arange(len(start))
    owner = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = start[owner] + nth * most
    for _ in range(3):
        cut = np.where((nth > 0) & (data[cut] & 0xC0 == 0x80), cut - 1, cut)
    last = np.append(owner[1:] != owner[:-1], True)
    return cut, np.where(last, end[owner], np.append(cut[1:], 0)), owner


#: First bytes of characters of scripts that are written without spaces, as ranges of the first
#: three bytes in UTF-8: Thai and Lao, Myanmar, Khmer, kana and Han, Han compatibility, half-width
#: kana. Characters of four bytes from F0 A0 to F0 AF are Han too.
UNSPACED = (
    (0xE0B880, 0xE0BBBF), (0xE18080, 0xE1829F), (0xE19E80, 0xE19FBF), (0xE2BA80, 0xE9BFBF),
    (0xEFA480, 0xEFABBF), (0xEFBDA6, 0xEFBE9D),
)


def unspaced(data: np.ndarray) -> np.ndarray:
    """Bytes at which a character of an unspaced script begins."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xE0)
    if len(at):
        three = np.minimum(at + 2, len(data) - 1)
        two = np.minimum(at + 1, len(data) - 1)
        code = (data[at].astype(np.int64) << 16) | (data[two].astype(np.int64) << 8) | data[three]
        found = (data[at] == 0xF0) & (data[two] >= 0xA0) & (data[two] <= 0xAF)
        for low, high in UNSPACED:
            found |= (code >= low) & (code <= high)
        out[at[found]] = True
    return out


def script_words(s: TextSlice) -> Words:
    """Words, and every character of a script that is written without spaces as one."""
    lead = unspaced(s.data)
    if not lead.any():
        return words(s)
    start, end, _ = word_ranges(s)
    after = np.flatnonzero(lead)
    after = after + np.where(s.data[after] >= 0xF0, 4, 3)
    cuts = np.unique(np.concatenate([np.flatnonzero(lead), after]))
    word = np.searchsorted(start, cuts, "right") - 1
    cuts = cuts[(word >= 0) & (cuts > start[word]) & (cuts < end[word])]
    start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return Words(start, end, np.searchsorted(start, s.offsets), RangeHash(s.data).of(start, end))


def words(s: TextSlice) -> Words:
    start, end, first = word_ranges(s)
    return Words(start, end, first, RangeHash(s.data).of(start, end))


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in a row, with the bounds of each row.

    A row of one to n - 1 words has one shingle of all its words; one without words has none.
    """
    size = np.diff(w.first)
    counts = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(w.first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    left = np.repeat(w.first[1:], counts) - at
    out = np.full(bounds[-1], 0x5851F42D4C957F2D, np.uint64)
    last = len(w.hash) - 1
    for k in range(n):
        here = w.hash[np.minimum(at + k, last)] if last >= 0 else out
        out = np.where(k < left, (out ^ here) * np.uint64(0x9E3779B97F4A7C15 + 2 * k), out)
        out ^= out >> np.uint64(29)
    return mix64(out), bounds


def split_words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def learning_row(doc_id: Column) -> Column:
    """Rows that classifiers may learn from: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, most: int, count: int, seed: int = 11) -> DataFrame:
    """About ``most`` of ``count`` rows, chosen by the hash of the id; all if there are fewer."""
    if count <= most:
        return rows
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1_000_000
    return rows.where(share < most / count)


class PrefixMatrix:
    """Hashes, equal to those of ``RangeHash``, of like ranges of many words at once.

    Words are given longest first and stand in columns, so a range of them all is read
    from two rows.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        longest = int(length[0])
        up, self._down = _power_tables(longest + 1)
        self._sums = np.zeros((longest + 1, len(start)), np.uint64)
        for i in range(longest):
            n = int(np.searchsorted(-length, -i, "left"))
            self._sums[i + 1, :n] = self._sums[i, :n] + _BYTE_VALUE[data[start[:n] + i]] * up[i]

    def of(self, begin: int, end: int, words: int) -> np.ndarray:
        return mix64((self._sums[end, :words] - self._sums[begin, :words]) * self._down[begin])


class HashIndex:
    """Position of 64-bit keys in an array, by open addressing; -1 where a key is unknown."""

    def __init__(self, keys: np.ndarray):
        self._bits = max(4, int(len(keys) * 4).bit_length())
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._at = np.full(1 << self._bits, -1, np.int64)
        self._steps = 1
        mask = (1 << self._bits) - 1
        self._maybe = np.zeros(1 << 18, bool)  # small enough to stay in a core's cache
        self._maybe[keys >> np.uint64(46)] = True
        for i, (k, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            step = 1
            while self._at[slot] >= 0 and int(self._keys[slot]) != k:
                slot, step = (slot + 1) & mask, step + 1
            if self._at[slot] < 0:
                self._keys[slot], self._at[slot] = k, i
            self._steps = max(self._steps, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self._bits)).astype(np.int64)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and their positions."""
        at = np.flatnonzero(self._maybe[keys >> np.uint64(46)])
        found = self.find(keys[at])
        good = found >= 0
        return at[good], found[good]

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self._slot(keys), len(self._at) - 1
        out = np.where(self._keys[slot] == keys, self._at[slot], -1)
        todo = np.flatnonzero((out < 0) & (self._at[slot] >= 0))
        for _ in range(self._steps - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & mask
            here, wanted = slot[todo], keys[todo]
            found = self._keys[here] == wanted
            out[todo[found]] = self._at[here[found]]
            todo = todo[~found & (self._at[here] >= 0)]
        return out
