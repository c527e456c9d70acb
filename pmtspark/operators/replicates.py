"""Many random halves of one table at once, as packed bits on its rows.

Rows are never multiplied by replicates. A task holds a chunk of rows as a matrix with a
column per replicate and yields sums of a size that depends on the replicates and bins alone;
Spark adds them up. What comes back to the driver is a few numbers per replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pmtspark.functions import safe_ratio
from pmtspark.operators.hashing import block_hashes
from pmtspark.operators.resample import PICK_ROWS
from pmtspark.sources import materialise

#: Cells, rows x replicates, that a task holds at once, and that a task is dealt.
CHUNK_CELLS = 1 << 18
TASK_CELLS = 1 << 25
#: Cells of a chunk of cross-products, which are multiplied fold by fold.
GRAM_CELLS = 1 << 22
DIGIT_BITS = 10
VALUE_BITS = 9
#: Deviations on either side of a boundary that its window, or bounds from a pilot, reach over.
WINDOW = 6.0
#: Rows of the pilot whose quantiles bound those of the table.
PILOT_ROWS = 16_384


def sum_arrays(
    parts: DataFrame, by: Sequence[str], columns: Sequence[str], how: dict[str, np.ufunc] | None = None
) -> DataFrame:
    """Add up arrays of doubles of equal length by group, a batch at a time.

    ``how`` names columns that another operation than the sum brings together.
    """
    by, how = list(by), how or {}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, key = [None] * len(columns), None
        for batch in batches:
            if key is None:
                key = [batch.column(c).slice(0, 1) for c in by]
            for i, c in enumerate(columns):
                flat = batch.column(c).flatten().to_numpy(zero_copy_only=False)
                merge = how.get(c, np.add)
                own = merge.reduce(flat.reshape(batch.num_rows, -1), axis=0)
                sums[i] = own if sums[i] is None else merge(sums[i], own)
        lists = [pa.array([s], pa.list_(pa.float64())) for s in sums]
        yield pa.RecordBatch.from_arrays([*key, *lists], [*by, *columns])

    schema = T.StructType([parts.schema[c] for c in (*by, *columns)])
    return parts.select(*by, *columns).groupBy(*by).applyInArrow(add, schema)


# --- membership -------------------------------------------------------------


def _slices(
    batches: Iterator[pa.RecordBatch], width: int, cells: int | None = None
) -> Iterator[pa.RecordBatch]:
    step = max(1, (cells or CHUNK_CELLS) // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _packed_bits(flags: np.ndarray, words: int) -> np.ndarray:
    packed = np.zeros((len(flags), words * 8), np.uint8)
    bits = np.packbits(flags, axis=1, bitorder="little")
    packed[:, : bits.shape[1]] = bits
    return packed.view("<u8")


def _word_lists(words: np.ndarray) -> pa.Array:
    bounds = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1])
    return pa.ListArray.from_arrays(bounds, pa.array(words.reshape(-1).view("<i8")))


def _hash_window(n: int, k: int, margin: float) -> tuple[int, int]:
    """Hashes between which the k-th smallest of n lies, ``margin`` deviations around its place."""
    share = k / n
    half = margin * (share * (1 - share) / n) ** 0.5 + margin / n
    return max(0, int((share - half) * 2**32)), min(2**32, int((share + half) * 2**32) + 1)


def _drawn_but_for_edge(
    df: DataFrame, id_col: str, replicates: int, seed: int, out: str, low: int, high: int, tasks: int
) -> DataFrame:
    """Rows with the bits of hashes under ``low``, and their hashes from there to ``high``.

    ``_open`` holds the latter, with the replicate, from 0, above the 32 bits of the hash.
    """
    names, words = df.columns, -(-replicates // 64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, replicates):
            h = block_hashes(batch.column("_s"), seed, -(-replicates // 4))[:, :replicates]
            inside = h < np.uint32(min(low, 2**32 - 1))
            row, r = np.nonzero(~inside & (h <= np.uint32(high - 1)))
            cells = (r.astype(np.int64) << 32) | h[row, r]
            bounds = np.searchsorted(row, np.arange(len(h) + 1)).astype(np.int32)
            undecided = pa.ListArray.from_arrays(pa.array(bounds), pa.array(cells, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], _word_lists(_packed_bits(inside, words)), undecided],
                [*names, out, "_open"],
            )

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*df.schema.fields]).add(out, longs).add("_open", longs)
    texts = df.repartition(tasks, id_col).withColumn("_s", F.col(id_col).cast("string"))
    return texts.mapInArrow(draw, schema)


def _edges(
    halves: DataFrame, id_col: str, replicates: int, k: int, out: str, window: tuple[int, int]
) -> list[tuple[int, object]] | None:
    """Per replicate, the k-th smallest (hash, id); None if a window does not hold it.

    Every pass counts the open hashes by equal parts of the range that holds the wanted one,
    until at most ``PICK_ROWS`` rows of each replicate are left, which are sorted.
    """
    bins = 1 << DIGIT_BITS
    low, high = (np.full(replicates, x, np.int64) for x in window)
    rank, left = None, None

    def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cells = batch.column("_open").flatten().to_numpy(zero_copy_only=False)
        return cells >> 32, cells & 0xFFFFFFFF

    def counter(low: np.ndarray, high: np.ndarray):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((replicates, 1 + bins))
            for batch in _slices(batches, replicates):
                if out in batch.schema.names:
                    sums[:, 0] += unpacked_bits(batch.column(out), replicates).sum(0)
                r, h = cells_of(batch)
                inside = (h >= low[r]) & (h < high[r])
                r, h = r[inside], h[inside]
                place = r * (1 + bins) + 1 + (h - low[r]) * bins // (high - low)[r]
                np.add.at(sums.reshape(-1), place, np.ones(len(place)))
            yield pa.RecordBatch.from_pydict(
                {"replicate": pa.array(np.arange(replicates), pa.int32()), "part": pa.array(list(sums))}
            )

        return count

    while rank is None or (left.max(initial=0) > PICK_ROWS and (high - low > 1).any()):
        read = halves.select("_open", *([out] if rank is None else []))
        parts = read.mapInArrow(counter(low, high), "replicate int, part array<double>")
        counts = np.zeros((replicates, 1 + bins), np.int64)
        for row in sum_arrays(parts, ["replicate"], ["part"]).collect():
            counts[row.replicate] = row.part
        if rank is None:
            rank = k - counts[:, 0]
        upto = counts[:, 1:].cumsum(1)
        if ((rank < 1) | (rank > upto[:, -1])).any():
            return None
        place = (upto < rank[:, None]).sum(1)
        at = np.arange(replicates)
        left = counts[at, 1 + place]
        rank = rank - (upto[at, place] - left)
        width = high - low
        low, high = low - (-place * width // bins), low - (-(place + 1) * width // bins)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, h = cells_of(batch)
            row = np.repeat(np.arange(batch.num_rows), batch.column("_open").value_lengths().to_numpy())
            inside = (h >= low[r]) & (h < high[r])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r[inside], pa.int32()),
                    pa.array(h[inside]),
                    batch.column("_id").take(pa.array(row[inside])),
                ],
                ["replicate", "h", "id"],
            )

    ids = halves.select(F.col(id_col).alias("_id"), "_open")
    schema = T.StructType().add("replicate", "integer").add("h", "long").add("id", ids.schema["_id"].dataType)
    order = Window.partitionBy("replicate").orderBy("h", "id")
    wanted = F.get(F.expr(f"array({', '.join(map(str, rank.tolist()))})"), F.col("replicate"))
    last = (
        ids.mapInArrow(near, schema)
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == wanted)
    )
    return [(r.h, r.id) for r in last.orderBy("replicate").select("h", "id").collect()]


def replicate_bits(
    df: DataFrame, id_col: str, replicates: int, seed: int, share: float = 0.5, out: str = "test_bits"
) -> DataFrame:
    """Add ``replicates`` exact random halves to the rows as bits of an array of longs.

    ``id_col`` must be unique and known. Bit r of a row, from 0, is set if replicate r + 1
    draws it. A half has ``round(n * share)`` rows, half to even: those of the smallest hashes,
    ties by id.

    Rows are hashed once. Hashes are spread evenly, so the boundary lies near its place with near
    certainty: hashes under a window there are drawn, and those inside it, 6 / sqrt(n) of them,
    are written beside the bits until the boundary is found among them. A window that
    turns out not to hold it is widened. Rows are dealt to tasks by their number, as the
    work is in the rows x replicates and not in the bytes.
    """
    n = df.count()
    k = round(n * share)  # half to even
    if k == 0:
        words = F.array(*[F.lit(0).cast("long")] * -(-replicates // 64))
        return df.withColumn(out, words)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * replicates // TASK_CELLS))
    margin, edges = WINDOW, None
    while edges is None:
        low, high = _hash_window(n, k, margin)
        halves = materialise(
            _drawn_but_for_edge(df, id_col, replicates, seed, out, low, high, tasks), "halves"
        )
        edges = _edges(halves, id_col, replicates, k, out, (low, high))
        margin *= 8
    names = df.columns
    edge = np.array([h for h, _ in edges], np.int64)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("_open").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column("_open").value_lengths().to_numpy())
            r, h = cells >> 32, cells & 0xFFFFFFFF
            inside = h < edge[r]
            for i in np.flatnonzero(h == edge[r]):
                inside[i] = batch.column(id_col)[int(row[i])].as_py() <= edges[r[i]][1]
            words = batch.column(out).flatten().to_numpy(zero_copy_only=False).view("<u8")
            words = words.reshape(batch.num_rows, -1).copy()
            row, r = row[inside], r[inside]
            np.bitwise_or.at(words, (row, r >> 6), np.uint64(1) << (r & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], _word_lists(words)], [*names, out]
            )

    schema = T.StructType([*df.schema.fields]).add(out, T.ArrayType(T.LongType()))
    return halves.mapInArrow(settle, schema)


def drawn(bits: str, replicate: Column) -> Column:
    """Whether ``replicate``, from 0, draws the row."""
    return F.getbit(F.get(bits, F.floor(replicate / 64).cast("int")), replicate % 64) == 1


def with_replicates(df: DataFrame, replicates: int, bits: str = "test_bits", flag: str = "test") -> DataFrame:
    """One row per (row, replicate), for models that are fitted one replicate at a time."""
    every = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    long = df.select("*", every).withColumn(flag, drawn(bits, F.col("replicate") - 1))
    return long.drop(bits)


def unpacked_bits(column: pa.Array, replicates: int) -> np.ndarray:
    words = -(-replicates // 64)
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, words)
    bits = np.ascontiguousarray(flat).view(np.uint8)
    return np.unpackbits(bits, axis=1, bitorder="little")[:, :replicates].view(bool)


def replicate_totals(
    df: DataFrame, replicates: int, columns: Sequence[str], bits: str = "test_bits"
) -> DataFrame:
    """Rows and sums of ``columns`` on both sides of every split: replicate, test, n, columns.

    Whole-number columns are summed in whole numbers.
    """
    columns = list(columns)
    whole = [isinstance(df.schema[c].dataType, T.IntegralType) for c in columns]
    kinds = ["long" if w else "double" for w in whole]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, replicates), np.int64)
        sums = [np.zeros((2, replicates), np.int64 if w else np.float64) for w in whole]
        for batch in _slices(batches, replicates):
            test = unpacked_bits(batch.column(bits), replicates)
            n[1] += test.sum(0)
            n[0] += len(test) - test.sum(0)
            for s, c, w in zip(sums, columns, whole, strict=True):
                v = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                v = v.astype(np.int64 if w else np.float64)
                drawn_sum = v @ test
                s[1] += drawn_sum
                s[0] += v.sum() - drawn_sum
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(1, replicates + 1), 2), pa.int32()),
                pa.array(np.repeat([False, True], replicates)),
                *[pa.array(x.reshape(-1)) for x in (n, *sums)],
            ],
            ["replicate", "test", "n", *columns],
        )

    parts = df.select(*columns, bits).mapInArrow(
        add, "replicate int, test boolean, n long" + (f", {schema}" if schema else "")
    )
    return parts.groupBy("replicate", "test").agg(*[F.sum(c).alias(c) for c in ("n", *columns)])


# --- fits and measures --------------------------------------------------------


@dataclass
class Chunk:
    """Rows as arrays: outcome, weight, design columns, fold, and a flag per replicate."""

    y: np.ndarray
    w: np.ndarray
    x: np.ndarray
    fold: np.ndarray
    test: np.ndarray
    ids: pa.Array

    def take(self, rows: np.ndarray) -> Chunk:
        arrays = (a[rows] for a in (self.y, self.w, self.x, self.fold, self.test))
        return Chunk(*arrays, self.ids.take(pa.array(rows)))


def packed_rows(
    df: DataFrame,
    id_col: str,
    y: Column,
    w: Column,
    x: Sequence[Column],
    bits: str = "test_bits",
    fold: Column | None = None,
) -> DataFrame:
    """The columns that tasks take as arrays; rows without outcome or weight are left out."""
    return df.select(
        F.col(id_col).alias("id"),
        y.cast("double").alias("y"),
        w.cast("double").alias("w"),
        F.array(*x).cast("array<double>").alias("x"),
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        F.col(bits).alias("bits"),
    ).filter(F.col("y").isNotNull() & F.col("w").isNotNull())


def chunks(
    batches: Iterator[pa.RecordBatch], replicates: int, width: int = 0, cells: int | None = None
) -> Iterator[Chunk]:
    """Rows in chunks that bound rows x replicates, or rows x ``width`` where that is wider."""
    for batch in _slices(batches, max(replicates, width), cells):
        if batch.num_rows:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            yield Chunk(
                *[batch.column(c).to_numpy(zero_copy_only=False) for c in "yw"],
                flat.reshape(batch.num_rows, -1),
                batch.column("fold").to_numpy(zero_copy_only=False),
                unpacked_bits(batch.column("bits"), replicates),
                batch.column("id"),
            )


def replicate_grams(
    packed: DataFrame, replicates: int, columns: int, folds: int = 1, cells: int = 1 << 23
) -> DataFrame:
    """Weighted cross-products of (x, y) over the training rows: replicate, fold, n, gram.

    ``gram`` is the upper triangle by rows, for ``columns`` columns x. A row's products are
    formed once and added to all replicates by one matrix product; replicates beyond ``cells``
    sums in a task's memory take another scan.
    """
    width = columns + 1
    pairs = width * (width + 1) // 2
    some = max(1, cells // (pairs * folds))
    i, j = np.triu_indices(width)

    def scan(start: int) -> DataFrame:
        size = min(some, replicates - start)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size, folds, pairs + 1))
            for c in chunks(batches, replicates, pairs, GRAM_CELLS if folds > 1 else None):
                z = np.column_stack([c.x, c.y])
                products = np.column_stack([z[:, i] * z[:, j] * c.w[:, None], np.ones(len(z))])
                train = (~c.test[:, start : start + size]).astype(np.float64)
                for f in range(folds):
                    own = c.fold == f if folds > 1 else slice(None)
                    sums[:, f] += train[own].T @ products[own]
            yield pa.RecordBatch.from_pydict(
                {
                    "replicate": pa.array(np.repeat(np.arange(size) + start + 1, folds), pa.int32()),
                    "fold": pa.array(np.tile(np.arange(folds), size), pa.int32()),
                    "part": pa.array(list(sums.reshape(-1, pairs + 1))),
                }
            )

        return packed.mapInArrow(add, "replicate int, fold int, part array<double>")

    parts = scan(0)
    for start in range(some, replicates, some):
        parts = parts.unionByName(scan(start))
    return sum_arrays(parts, ["replicate", "fold"], ["part"]).select(
        "replicate",
        "fold",
        F.get("part", F.lit(pairs)).cast("long").alias("n"),
        F.slice("part", 1, pairs).alias("gram"),
    )


def _order_key(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    b = (v + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


#: A value a row, or a row and replicate. ``bounds``, if it has them, yields a range of each
#: row's values without them; ``by_row`` tells that a row's values are the same in any chunk.
Values = Callable[[Chunk], np.ndarray]


def _ranges(values: Values, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a range that holds a row's values in all replicates; NaN where none is known."""
    if hasattr(values, "bounds"):
        return values.bounds(c)
    v = values(c).reshape(len(c.y), -1)
    return v.min(1), v.max(1)


def _side_sums(columns: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sums of ``columns`` over the rows of each replicate's side: replicates x columns."""
    return side.T.astype(np.float64) @ columns


def _constant(table: np.ndarray) -> Column:
    """Array of arrays of doubles, NaN as NULL."""

    def row(values) -> str:
        return "array(" + ", ".join("CAST(NULL AS DOUBLE)" if np.isnan(v) else f"{float(v)!r}D" for v in values) + ")"

    return F.expr(f"array({', '.join(map(row, table))})")


@dataclass
class _Bins:
    """Mass of every replicate and quantile by parts of its range of values.

    ``lowest`` and ``highest`` are the values that occur in a part; ``below`` is the mass under
    the range. ``total`` and ``n`` are mass and rows of a replicate, and no weight is over ``heaviest``.
    """

    total: np.ndarray
    n: np.ndarray
    heaviest: np.ndarray
    below: np.ndarray
    mass: np.ndarray
    lowest: np.ndarray
    highest: np.ndarray


def _members(c: Chunk, values: Values, test: bool) -> tuple[np.ndarray, np.ndarray]:
    v = np.broadcast_to(np.atleast_2d(values(c).T).T, c.test.shape) + 0.0
    return v, (c.test if test else ~c.test) & ~np.isnan(v)


def _part(c: Chunk, values: Values, rows: np.ndarray) -> tuple[Chunk, Values]:
    """Some rows of a chunk, and their values."""
    part = c.take(rows)
    if getattr(values, "by_row", False):
        return part, values
    own = values(c)[rows]
    return part, lambda _: own


def _outside(
    values: Values, c: Chunk, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of known values, and rows x qs that are outside, and under, the range in all replicates.

    Such a row counts alike in all replicates that hold it, so its cells are not looked at.
    """
    first, last = _ranges(values, c)
    known = np.isfinite(first) & np.isfinite(last)
    under = known[:, None] & (last[:, None] < low.min(0))
    return known, under | (known[:, None] & (first[:, None] > high.max(0))), under


def _bins(
    packed: DataFrame, replicates: int, values: Values, test: bool, low: np.ndarray, high: np.ndarray
) -> _Bins:
    """One pass over the rows; a range without values (``low`` over ``high``) takes no part."""
    many, bins = low.shape[1], 1 << VALUE_BITS
    low_key, high_key = _order_key(low), _order_key(high)
    span = (high_key - low_key).view(np.uint64).reshape(-1).tolist()
    bits = np.array([int(x).bit_length() for x in span]).reshape(low.shape)
    shift = np.maximum(bits - VALUE_BITS, 0).astype(np.uint64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, total, n = np.zeros((replicates, many)), np.zeros(replicates), np.zeros(replicates)
        heaviest = np.zeros(replicates)
        mass = np.zeros((many, replicates * bins))
        lowest, highest = np.full_like(mass, np.inf), np.full_like(mass, -np.inf)
        for whole in chunks(batches, replicates):
            heaviest = np.maximum(heaviest, whole.w.max())
            known, outside, beneath = _outside(values, whole, low, high)
            counted = known & (whole.w > 0)
            w = np.where(counted, whole.w, 0.0)
            sums = _side_sums(
                np.column_stack([w, counted, w[:, None] * beneath]), whole.test if test else ~whole.test
            )
            total += sums[:, 0]
            n += sums[:, 1]
            below += sums[:, 2:]
            rows = np.flatnonzero(~outside.all(1))
            if not len(rows):
                continue
            c, own = _part(whole, values, rows)
            v, member = _members(c, own, test)
            member &= (c.w > 0)[:, None]
            if not known[rows].all():
                unknown = member & ~known[rows, None]
                total += c.w @ unknown
                n += unknown.sum(0)
            for q in range(many):
                near = np.flatnonzero(~outside[rows, q])
                x, mine, w = v[near], member[near], c.w[near]
                under = x < low[:, q]
                below[:, q] += w @ (under & mine)
                at = np.flatnonzero(mine & ~under & (x <= high[:, q]))
                row, r = np.divmod(at, replicates)
                x = x.reshape(-1)[at]
                place = ((_order_key(x) - low_key[r, q]).view(np.uint64) >> shift[r, q]).view(np.int64)
                place += r * bins
                np.add.at(mass[q], place, w[row])
                np.minimum.at(lowest[q], place, x)
                np.maximum.at(highest[q], place, x)
        every = np.arange(replicates)
        for q in range(many):
            first = np.column_stack([total, n, below[:, q]])
            yield pa.RecordBatch.from_pydict(
                {
                    "r": pa.array(every, pa.int32()),
                    "q": pa.array(np.full(replicates, q), pa.int32()),
                    "sums": pa.array(list(np.hstack([first, mass[q].reshape(-1, bins)]))),
                    "least": pa.array(list(lowest[q].reshape(-1, bins))),
                    "most": pa.array(list(np.hstack([heaviest[:, None], highest[q].reshape(-1, bins)]))),
                }
            )

    doubles = ", ".join(f"{c} array<double>" for c in ("sums", "least", "most"))
    parts = packed.mapInArrow(add, f"r int, q int, {doubles}")
    sums = np.zeros((*low.shape, 3 + bins))
    least = np.full((*low.shape, bins), np.inf)
    most = np.full((*low.shape, 1 + bins), -np.inf)
    how = {"least": np.minimum, "most": np.maximum}
    for row in sum_arrays(parts, ["r", "q"], ["sums", "least", "most"], how).toLocalIterator():
        sums[row.r, row.q], least[row.r, row.q], most[row.r, row.q] = row.sums, row.least, row.most
    return _Bins(
        sums[:, 0, 0], sums[:, 0, 1], most[:, 0, 0], sums[..., 2], sums[..., 3:], least, most[..., 1:]
    )


def _pilot(
    packed: DataFrame, replicates: int, values: Values, test: bool, qs: Sequence[float]
) -> tuple[np.ndarray, np.ndarray]:
    """Likely bounds of the quantiles, from a bounded sample of the rows. Any bounds will do."""
    low, high = (np.full((replicates, len(qs)), x) for x in (-np.inf, np.inf))
    n = packed.count()
    some = packed.sample(min(1.0, PILOT_ROWS / n), seed=1) if n else packed
    found = list(chunks(iter(some.toArrow().to_batches()), replicates))
    if not found:
        return low, high
    sides = [_members(c, values, test) for c in found]
    v, member = (np.concatenate(x) for x in zip(*sides, strict=True))
    w = np.concatenate([c.w for c in found])
    for r in range(replicates):
        at = np.flatnonzero(member[:, r] & (w > 0))
        if not len(at):
            continue
        at = at[np.argsort(v[at, r])]
        upto = w[at].cumsum()
        rows = upto[-1] ** 2 / (w[at] ** 2).sum()
        for i, q in enumerate(qs):
            off = WINDOW * ((q * (1 - q) / rows) ** 0.5 + 1 / rows)
            if q > off:
                low[r, i] = v[at[np.searchsorted(upto, (q - off) * upto[-1])], r]
            if q + off < 1:
                high[r, i] = v[at[np.searchsorted(upto, (q + off) * upto[-1])], r]
    return low, high


def _below(packed: DataFrame, replicates: int, values: Values, test: bool, low: np.ndarray) -> np.ndarray:
    """Largest value with weight under each bound, or else the smallest value of any weight."""
    many = low.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, under = np.full(replicates, np.inf), np.full((replicates, many), -np.inf)
        for c in chunks(batches, replicates):
            v, member = _members(c, values, test)
            least = np.minimum(least, np.where(member, v, np.inf).min(0))
            member &= (c.w > 0)[:, None]
            for q in range(many):
                under[:, q] = np.maximum(under[:, q], np.where(member & (v < low[:, q]), v, -np.inf).max(0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(replicates), many), pa.int32()),
                pa.array(np.tile(np.arange(many), replicates), pa.int32()),
                pa.array(np.repeat(least, many)),
                pa.array(under.reshape(-1)),
            ],
            ["r", "q", "least", "under"],
        )

    parts = packed.mapInArrow(add, "r int, q int, least double, under double")
    out = np.full(low.shape, np.nan)
    for row in parts.groupBy("r", "q").agg(F.min("least").alias("least"), F.max("under").alias("under")).collect():
        out[row.r, row.q] = row.least if row.under == -np.inf else row.under
    return out


def replicate_quantiles(
    packed: DataFrame, replicates: int, values: Values, test: bool, qs: Sequence[float]
) -> np.ndarray:
    """Weighted quantiles of ``values`` on one side of every split: replicates x qs.

    As ``weighted_quantile``: equal values stand in order of ids, the line between the points
    of the distribution is followed. A pass adds up the rows between the bounds known so far by
    the leading bits of their distance from the lower bound, for all replicates and quantiles;
    the bounds become the values that occur in the part hit, until at most ``PICK_ROWS``
    rows, or one value, are left between them. The first bounds come from a pilot; where they turn
    out not to hold the quantile, the search begins anew with all rows. NaN where a replicate
    has no rows.
    """
    shape = (replicates, len(qs))
    out, previous, before, goal = (np.full(shape, np.nan) for _ in range(4))
    low, high = _pilot(packed, replicates, values, test, qs)
    nested = np.zeros(shape, bool)  # bounds known to hold the quantile
    todo, near = np.ones(shape, bool), np.zeros(shape, bool)
    while todo.any():
        b = _bins(
            packed, replicates, values, test, np.where(todo, low, np.inf), np.where(todo, high, -np.inf)
        )
        todo &= b.total[:, None] > 0
        goal = np.maximum(np.minimum(np.array(qs, float), 1.0)[None, :] * b.total[:, None], 1e-300)
        upto = b.below[..., None] + b.mass.cumsum(-1)
        for r, q in np.argwhere(todo):
            at = (r, q)
            filled = np.flatnonzero(b.mass[at] > 0)
            reached = filled[upto[at][filled] >= goal[at]]
            held = len(filled) > 0
            if held:
                hit = reached[0] if len(reached) else filled[-1]
                from_below = np.isneginf(low[at]) or b.below[at] < goal[at]
                held = nested[at] or (from_below and (len(reached) > 0 or np.isposinf(high[at])))
            if not held:
                low[at], high[at] = -np.inf, np.inf
                continue
            earlier = filled[filled < hit]
            if len(earlier):
                previous[at] = b.highest[at][earlier[-1]]
            before[at] = upto[at][hit] - b.mass[at][hit]
            low[at], high[at] = b.lowest[at][hit], b.highest[at][hit]
            nested[at] = True
            rows = b.mass[at][hit] / b.total[r] * b.n[r]
            if low[at] == high[at] and goal[at] - before[at] >= b.heaviest[r]:
                out[at] = low[at]
                todo[at] = False
            elif rows <= PICK_ROWS or low[at] == high[at]:
                todo[at], near[at] = False, True
    if near.any():
        low, high = np.where(near, low, np.inf), np.where(near, high, -np.inf)
        if np.isnan(previous[near]).any():
            under = _below(packed, replicates, values, test, low)
            previous = np.where(np.isnan(previous), under, previous)
        out = np.where(near, _pick(packed, replicates, values, test, low, high, goal - before, previous), out)
    return out


def _pick(packed, replicates, values, test, low, high, goal, previous) -> np.ndarray:
    """Read the quantiles off the rows between the last bounds, equal values as one."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in chunks(batches, replicates):
            _, outside, _ = _outside(values, whole, low, high)
            if outside.all():
                continue
            c, own = _part(whole, values, np.flatnonzero(~outside.all(1)))
            v, member = _members(c, own, test)
            member &= (c.w > 0)[:, None]
            order = None
            for q in range(low.shape[1]):
                row, r = np.nonzero(member & (v >= low[:, q]) & (v <= high[:, q]))
                if not len(row):
                    continue
                if order is None:
                    order = np.empty(len(c.ids), np.int64)
                    order[pc.sort_indices(c.ids).to_numpy()] = np.arange(len(c.ids))
                by = np.lexsort((order[row], v[row, r], r))
                row, r = row[by], r[by]
                x, w = v[row, r], c.w[row]
                new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r[new], pa.int32()),
                        pa.array(np.full(len(new), q), pa.int32()),
                        pa.array(x[new]),
                        pa.array(np.add.reduceat(w, new)),
                        c.ids.take(pa.array(row[new])),
                        pa.array(w[new]),
                    ],
                    ["r", "q", "x", "mass", "id", "w"],
                )

    schema = T.StructType().add("r", "integer").add("q", "integer").add("x", "double").add("mass", "double")
    rows = packed.mapInArrow(near, schema.add("id", packed.schema["id"].dataType).add("w", "double"))
    points = rows.groupBy("r", "q", "x").agg(F.sum("mass").alias("mass"), F.min_by("w", "id").alias("w"))
    ordered = Window.partitionBy("r", "q").orderBy("x")
    known = (
        points.withColumn("below", F.lag("x").over(ordered))
        .withColumn("upto", F.sum("mass").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last", F.lead("x").over(ordered).isNull())
        .withColumn("goal", F.get(F.get(_constant(goal), F.col("r")), F.col("q")))
    )
    reached = (F.col("upto") >= F.col("goal")) | F.col("last")
    first = F.col("below").isNull()
    hit = known.filter((first | (F.col("upto") - F.col("mass") < F.col("goal"))) & reached)
    out = np.full(low.shape, np.nan)
    for row in hit.orderBy(F.desc("x")).collect():
        below = previous[row.r, row.q] if row.below is None else row.below
        part = (row.goal - row.upto + row.mass) / row.w
        # a goal that meets a point but for rounding takes the point's own value
        out[row.r, row.q] = row.x if part >= 1 - 1e-9 else below + (row.x - below) * part
    return out


def _span(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest line of all replicates; all values where a replicate has none."""
    none = np.isnan(lines).any(0)
    return np.where(none, -np.inf, lines.min(0)), np.where(none, np.inf, lines.max(0))


def replicate_targeting(
    packed: DataFrame,
    replicates: int,
    values: Values,
    z: np.ndarray,
    zhat: np.ndarray,
    qs: Sequence[float],
) -> DataFrame:
    """Targeting measures on the drawn rows: replicate, z, line, rate_line, H, IER, EER, TER.

    Lines of the replicates lie close together. A row that all of them leave on one side counts
    in the same sums of every replicate that draws it; the others are looked at cell by cell.
    """
    z_first, z_last = _span(z)
    rate_first, rate_last = _span(zhat)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((replicates, 1 + 5 * len(qs)))
        for whole in chunks(batches, replicates):
            first, last = (x[:, None] for x in _ranges(values, whole))
            y = whole.y[:, None]
            poor, chosen, above = y <= z_first, last <= z_first, first > rate_last
            sided = (poor | (y > z_last)) & (chosen | (first > z_last)) & (above | (last <= rate_first))
            sided = sided.all(1) & np.isfinite(first[:, 0]) & np.isfinite(last[:, 0])
            cells = [poor, chosen, chosen & ~poor, poor & ~chosen, poor & above]
            columns = np.stack(cells, 2).reshape(len(y), -1)
            w = np.where(sided, whole.w, 0.0)[:, None]
            sums += _side_sums(np.column_stack([w, w * columns]), whole.test)
            if sided.all():
                continue
            c, own = _part(whole, values, np.flatnonzero(~sided))
            v, member = _members(c, own, True)
            sums[:, 0] += c.w @ member
            y = c.y[:, None]
            for q in range(len(qs)):
                poor, chosen = (y <= z[:, q]) & member, (v <= z[:, q]) & member
                missed = poor & (v > zhat[:, q])
                for k, cell in enumerate((poor, chosen, chosen & ~poor, poor & ~chosen, missed)):
                    sums[:, 1 + 5 * q + k] += c.w @ cell
        yield pa.RecordBatch.from_pydict(
            {
                "replicate": pa.array(np.arange(1, replicates + 1), pa.int32()),
                "part": pa.array(list(sums)),
            }
        )

    parts = packed.mapInArrow(add, "replicate int, part array<double>")
    summed = sum_arrays(parts, ["replicate"], ["part"])
    lines = {name: _constant(of) for name, of in (("line", z), ("rate_line", zhat))}
    rows = []
    for q, share in enumerate(qs):
        total, poor, chosen, leaked, left, missed = (
            F.get("part", F.lit(0 if k is None else 1 + 5 * q + k)) for k in (None, *range(5))
        )
        rows.append(
            F.struct(
                F.lit(float(share)).alias("z"),
                *[
                    F.get(F.get(of, F.col("replicate") - 1), F.lit(q)).alias(name)
                    for name, of in lines.items()
                ],
                safe_ratio(chosen, total).alias("H"),
                safe_ratio(leaked, chosen).alias("IER"),
                safe_ratio(left, poor).alias("EER"),
                safe_ratio(missed, poor).alias("TER"),
            )
        )
    return summed.select("replicate", F.inline(F.array(*rows)))


@dataclass
class _Linear:
    beta: np.ndarray

    @property
    def by_row(self) -> bool:
        return self.beta.shape[1] <= 16

    def __call__(self, c: Chunk) -> np.ndarray:
        if not self.by_row:
            return np.exp(c.x @ self.beta.T)
        # column by column, so that equal rows have equal products wherever they stand
        v, part = np.zeros(c.test.shape), np.empty(c.test.shape)
        for x, b in zip(c.x.T, self.beta.T, strict=True):
            v += np.multiply(x[:, None], b, out=part)
        return np.exp(v, out=v)

    def bounds(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """From the least and the largest coefficient of each column, with room for rounding."""
        least, most = self.beta.min(0), self.beta.max(0)
        ends = np.stack([c.x * least, c.x * most])
        room = 1e-10 * (1 + np.abs(ends).max(0).sum(1))
        with np.errstate(over="ignore"):
            return np.exp(ends.min(0).sum(1) - room), np.exp(ends.max(0).sum(1) + room)


def linear_values(beta: np.ndarray) -> Values:
    """Exponentials of the rows' products with each replicate's coefficients (a row each)."""
    return _Linear(beta)
