"""Terms of Arrow text columns, counted per text.

A term is a maximal run of bytes that a fold table keeps. Tables keep all bytes over 0x7F, so
a term is whole characters, and fold only A-Z to a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pmtspark.llm.text import TextSlice


def fold_table(digits: bool) -> np.ndarray:
    """Folded byte of each byte of a term, 0 for those that part terms."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    lower = np.arange(ord("a"), ord("z") + 1)
    table[lower] = lower
    table[lower - 32] = lower
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


@dataclass
class TermCounts:
    """Distinct terms of a slice, and per (row, term) that occurs its count."""

    terms: pa.Array
    row: np.ndarray
    code: np.ndarray
    count: np.ndarray
    total: np.ndarray  # terms of each row, with repeats


def count_terms(s: TextSlice, fold: np.ndarray) -> TermCounts:
    folded = fold[s.data]
    keep = folded != 0
    open_ = keep.copy()  # where a term begins
    open_[1:] &= ~keep[:-1]
    first = s.offsets[:-1][np.diff(s.offsets) > 0]
    open_[first] = keep[first]
    start = np.flatnonzero(open_)
    # kept bytes stand in a row, and a term reaches to where the next begins
    place = np.cumsum(keep, dtype=np.int32)[start] - 1
    data = folded[keep]
    bounds = np.append(place, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    ).dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.searchsorted(s.offsets, start, "right") - 1
    width = max(1, len(found.dictionary))
    pair, count = np.unique(row * width + code, return_counts=True)
    return TermCounts(
        found.dictionary.cast(pa.large_string()).cast(pa.string()),
        pair // width,
        pair % width,
        count,
        np.bincount(row, minlength=s.rows),
    )


def gathered(batches: Iterator[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` at least."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
