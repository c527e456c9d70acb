"""Least squares with factors of any number of levels, and with thousands of columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmtspark.operators.design import Design
from pmtspark.operators.regression import factor, fit_from_factors
from pmtspark.operators.replicates import sum_arrays
from pmtspark.sources import materialise


def _without_means(rows: DataFrame, columns: Sequence[str], weight: str, of: str) -> DataFrame:
    """Take the weighted means of a factor's levels off the columns.

    Sums are combined before the shuffle, and the means, one row a level, come back by a join
    that adaptive execution can split at a hot level. Levels without weight go.
    """
    total = F.sum(weight)
    means = (
        rows.groupBy(F.col(of).alias("_level"))
        .agg(*[(F.sum(F.col(weight) * F.col(c)) / total).alias(f"_mean_{c}") for c in columns], total.alias("_all"))
        .filter("_all > 0")
    )
    joined = rows.join(means, F.col(of).eqNullSafe(F.col("_level")))
    rest = [c for c in rows.columns if c not in columns]
    return joined.select(*rest, *[(F.col(c) - F.col(f"_mean_{c}")).alias(c) for c in columns])


def within(
    df: DataFrame,
    columns: Sequence[str],
    weight: str,
    factors: Sequence[str],
    tolerance: float = 1e-10,
    most_rounds: int = 200,
) -> DataFrame:
    """Residuals of ``columns`` on the levels of ``factors``, by alternating projections.

    One factor takes one round. With more, rounds take each factor's means off in turn until no
    mean of the first factor is over ``tolerance`` times the column's spread; each round is
    written, which cuts lineage. Raises if ``most_rounds`` do not settle it. A NULL level is a
    level; rows need a positive total weight in each of theirs.
    """
    first, *others = factors
    rows = _without_means(df, columns, weight, first)
    if not others:
        return rows
    spreads = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    limit = {c: tolerance * (spreads[c] or 1.0) for c in columns}
    for _ in range(most_rounds):
        for other in others:
            rows = _without_means(rows, columns, weight, other)
        rows = materialise(rows, "within")
        left = rows.groupBy(first).agg(
            *[F.abs(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(c) for c in columns]
        ).agg(*[F.max(c).alias(c) for c in columns]).first()
        if all((left[c] or 0.0) <= limit[c] for c in columns):
            return rows
        rows = _without_means(rows, columns, weight, first)
    raise RuntimeError(f"means left after {most_rounds} rounds: {left.asDict()}")


def wls_absorbed(
    df: DataFrame, design: Design, label: Column, weight: Column, factors: Sequence[str]
) -> DataFrame:
    """Weighted least squares with an own constant for every level of ``factors``: n, beta.

    ``design`` holds the other terms, without an intercept, for the levels take it up. The
    levels never become columns, so there may be as many of them as rows; slopes are those of
    the fit with a dummy for each.
    """
    if design.intercept:
        raise ValueError("the levels of the factors take up the intercept")
    columns = design.columns()
    names = [f"_x{i}" for i in range(len(columns))]
    rows = design.complete(df).select(
        *[F.col(c).alias(f"_f{i}") for i, c in enumerate(factors)],
        *[c.cast("double").alias(n) for n, (_, c) in zip(names, columns, strict=True)],
        label.cast("double").alias("_y"),
        weight.cast("double").alias("_w"),
    ).filter("_y IS NOT NULL AND _w IS NOT NULL")
    rows = materialise(rows, "absorb")
    free = within(rows, [*names, "_y"], "_w", [f"_f{i}" for i in range(len(factors))])
    found = factor(free, [F.col(c) for c in (*names, "_y")], F.col("_w"))
    return fit_from_factors(found, len(names))


def tiled_gram(
    df: DataFrame,
    design: Design,
    label: Column,
    weight: Column,
    tile: int = 256,
    cells: int = 1 << 23,
    chunk: int = 512,
) -> DataFrame:
    """Weighted cross-products of a design of thousands of columns: left, right, n, part.

    The columns, in the order of the design and then the label, are cut into tiles, and a row
    holds the products of two tiles, ``left`` <= ``right``, by rows. Only main effects reach the
    tasks, which form interactions chunk by chunk; a scan sums as many tiles as ``cells``
    allows and further ones take another scan, so no array grows with the square of the
    columns, and the tiles are added up apart.
    """
    main = design.with_options(pairwise=False, intercept=False)
    effects = main.columns()
    terms = [t for t, _, _ in main._parts()]
    pairs = [
        (i, j)
        for i in range(len(terms))
        for j in range(i + 1, len(terms))
        if design.pairwise and terms[i] != terms[j]
    ]
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    start = 1 if design.intercept else 0
    width = start + len(terms) + len(pairs) + 1
    tiles = [(at, min(at + tile, width)) for at in range(0, width, tile)]
    narrow = materialise(
        design.complete(df)
        .select(
            F.array(*[c for _, c in effects]).cast("array<double>").alias("x"),
            label.cast("double").alias("y"),
            weight.cast("double").alias("w"),
        )
        .filter("y IS NOT NULL AND w IS NOT NULL"),
        "effects",
    )
    jobs = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles))]
    some = max(1, cells // (tile * tile))

    def scan(own: list[tuple[int, int]]) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((tiles[i][1] - tiles[i][0], tiles[j][1] - tiles[j][0])) for i, j in own]
            n = 0
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False)
                    x = x.reshape(part.num_rows, -1)
                    y, w = (part.column(c).to_numpy(zero_copy_only=False) for c in "yw")
                    z = np.column_stack([np.ones((len(x), start)), x, x[:, a] * x[:, b], y])
                    weighted = z * w[:, None]
                    n += len(z)
                    for s, (i, j) in zip(sums, own, strict=True):
                        s += weighted[:, slice(*tiles[i])].T @ z[:, slice(*tiles[j])]
            for s, (i, j) in zip(sums, own, strict=True):
                yield pa.RecordBatch.from_pydict(
                    {
                        "left": pa.array([i], pa.int32()),
                        "right": pa.array([j], pa.int32()),
                        "n": pa.array([[float(n)]]),
                        "part": pa.array([s.reshape(-1)]),
                    }
                )

        return narrow.mapInArrow(add, "left int, right int, n array<double>, part array<double>")

    parts = scan(jobs[:some])
    for at in range(some, len(jobs), some):
        parts = parts.unionByName(scan(jobs[at : at + some]))
    return sum_arrays(parts, ["left", "right"], ["n", "part"]).withColumn(
        "n", F.get("n", F.lit(0)).cast("long")
    )
