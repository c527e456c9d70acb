"""Weighted least squares from triangular factors.

One pass over the rows gives the triangular factor of the weighted regressors and label:
tasks factor a chunk of rows together with the factor so far, and factors are merged by
factoring them stacked, in any order. Cross-products are never formed, so a regressor whose
spread is small next to its mean keeps its digits. Everything after works on k x k numbers.
Coefficients stay in the plan as an array column, so fitting, scoring and measuring form one
job, and many fits (groups) share one scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pmtspark.operators.design import Design
from pmtspark.operators.weights import attach_row

CHUNK_ROWS = 4096
#: Cells of the factors of groups that a task holds before it passes them on.
TASK_CELLS = 2**22
#: A column is explained by earlier ones if less than this share of its length is left.
TOLERANCE = 1e-8
GRAM_TOLERANCE = 1e-9  # of its squared length


def unpack(packed: Sequence[float], m: int) -> np.ndarray:
    """Symmetric m x m matrix from its upper triangle by rows."""
    out = np.zeros((m, m))
    upper = np.triu_indices(m)
    out[upper] = packed
    out.T[upper] = packed
    return out


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangular R with R'R = rows'rows."""
    m = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == m else np.vstack([r, np.zeros((m - len(r), m))])


def factor(
    df: DataFrame, z: Sequence[Column], w: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Triangular factor of the weighted columns ``z``: ``by``, ``n``, ``factor``.

    ``factor`` is the upper triangle of R by rows, where R'R = Z'WZ. Rows with a NULL weight or a
    NULL in ``z`` count nowhere; weights are not negative. No rows, no row.
    """
    m, by = len(z), list(by)
    upper = np.triu_indices(m)
    w = F.lit(1.0) if w is None else w
    keyed = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_k0")]
    narrow = _known(df, z, w).select(
        *keyed, F.array(*z).cast("array<double>").alias("_z"), F.sqrt(w.cast("double")).alias("_w")
    )
    keys = [f"_k{i}" for i in range(len(keyed))]
    fits = max(1, TASK_CELLS // (m * m))

    def batch_of(held: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(kinds)]
        n = pa.array([x[0] for x in held.values()], pa.int64())
        r = pa.array([x[1][upper] for x in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, n, r], [*keys, "n", "factor"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        kinds = None
        for whole in batches:
            kinds = [whole.schema.field(k).type for k in keys]
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                own = batch.select(keys)
                group = own.to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                _, first = np.unique(group, return_index=True)
                names = [tuple(r.values()) for r in own.take(pa.array(first)).to_pylist()]
                zs = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                zs = zs * batch.column("_w").to_numpy(zero_copy_only=False)[:, None]
                for g, name in enumerate(names):
                    rows = zs[group == g] if len(names) > 1 else zs
                    n, r = held.get(name, (0, np.zeros((0, m))))
                    held[name] = n + len(rows), _triangle(np.vstack([r, rows]))
                if len(held) > fits:
                    yield batch_of(held, kinds)
                    held = {}
        if held:
            yield batch_of(held, kinds)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r, name, kinds = 0, np.zeros((0, m)), None, None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            name = name or tuple(batch.column(k)[0].as_py() for k in keys)
            for more, flat in zip(
                batch.column("n").to_pylist(), batch.column("factor").to_pylist(), strict=True
            ):
                part = np.zeros((m, m))
                part[upper] = flat
                n, r = n + more, _triangle(np.vstack([r, part]))
        yield batch_of({name: (n, r)}, kinds)

    kind = T.StructType([narrow.schema[k] for k in keys])
    kind = kind.add("n", "long").add("factor", T.ArrayType(T.DoubleType()))
    merged = narrow.mapInArrow(partial, kind).groupBy(*keys).applyInArrow(merge, kind)
    return merged.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], "n", "factor"
    )


def _known(df: DataFrame, z: Sequence[Column], w: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in z], w.isNotNull()))


def solve_factor(packed: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse of X'WX; a column explained by earlier ones is NaN."""
    full = np.zeros((k + 1, k + 1))
    full[np.triu_indices(k + 1)] = packed
    keep: list[int] = []
    basis = np.zeros((0, k + 1))
    for j in range(k):
        rest = full[:, j].copy()
        for _ in range(2):  # twice, for the digits that the first time loses
            rest -= basis.T @ (basis @ rest)
        if np.linalg.norm(rest) > TOLERANCE * np.linalg.norm(full[:, j]):
            keep.append(j)
            basis = np.vstack([basis, rest / np.linalg.norm(rest)])
    beta, inverse = np.full(k, np.nan), np.full((k, k), np.nan)
    triangle = basis @ full[:, keep]
    beta[keep] = np.linalg.solve(triangle, basis @ full[:, k])
    half = np.linalg.inv(triangle)
    inverse[np.ix_(keep, keep)] = half @ half.T
    return beta, inverse


def solve_packed(packed: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``solve_factor``, from the upper triangle of the cross-products themselves."""
    full = unpack(packed, k + 1)
    a, b = full[:k, :k], full[:k, k]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    left = a / np.outer(scale, scale)
    keep: list[int] = []
    for j in range(k):
        rest = left[j, j]
        if keep:
            cross = left[keep, j]
            rest -= cross @ np.linalg.solve(left[np.ix_(keep, keep)], cross)
        if rest > GRAM_TOLERANCE:
            keep.append(j)
    beta, inverse = np.full(k, np.nan), np.full((k, k), np.nan)
    grid = np.ix_(keep, keep)
    inner = np.linalg.inv(left[grid])
    beta[keep] = inner @ (b[keep] / scale[keep]) / scale[keep]
    inverse[grid] = inner / np.outer(scale[keep], scale[keep])
    return beta, inverse


def _beta_udf(k: int, solver):
    @F.pandas_udf("array<double>")
    def solve(packed: pd.Series) -> pd.Series:
        def one(g):
            beta = solver(g, k)[0]
            if np.isnan(beta).all():
                return None
            return [None if math.isnan(v) else float(v) for v in beta]

        return packed.map(one)

    return solve


def fit_from_grams(grams: DataFrame, k: int) -> DataFrame:
    """Replace ``gram`` by ``beta``: NULL in it for an aliased column, all NULL without a fit."""
    rest = [c for c in grams.columns if c != "gram"]
    return grams.select(*rest, _beta_udf(k, solve_packed)(F.col("gram")).alias("beta"))


def fit_from_factors(factors: DataFrame, k: int) -> DataFrame:
    """The same from ``factor``."""
    rest = [c for c in factors.columns if c != "factor"]
    return factors.select(*rest, _beta_udf(k, solve_factor)(F.col("factor")).alias("beta"))


def wls(
    df: DataFrame,
    design: Design,
    label: Column,
    weight: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted least squares; one row per group: ``by``, ``n``, ``beta``."""
    columns = [c for _, c in design.columns()]
    rows = design.complete(df).filter(label.isNotNull())
    found = fit_from_factors(factor(rows, [*columns, label], weight, by), len(columns))
    if by:
        return found
    # without rows, a row that says so
    return rows.sparkSession.range(1).select().join(found, F.lit(True), "left").fillna({"n": 0})


def score(df: DataFrame, fit: DataFrame, design: Design, out: str = "log_yhat") -> DataFrame:
    """Predictions of a one-row fit on the rows where every term is known."""
    rows = attach_row(design.complete(df), fit.select("beta"))
    return rows.withColumn(out, design.dot("beta")).drop("beta")


def fitted_table(
    df: DataFrame, fit: DataFrame, design: Design, log_label: Column, weight: str
) -> DataFrame:
    """Scored rows: log_yhat, yhat, log_y, y, w (summing to one), resid."""
    rows = score(df, fit, design).withColumn("log_y", log_label)
    total = rows.agg(F.sum(weight)).scalar()
    return (
        rows.withColumn("yhat", F.exp("log_yhat"))
        .withColumn("y", F.exp("log_y"))
        .withColumn("w", F.col(weight) / total)
        .withColumn("resid", F.col("log_y") - F.col("log_yhat"))
    )


def cluster_covariance(
    df: DataFrame,
    design: Design,
    label: Column,
    weight: Column,
    cluster: str,
    fit: DataFrame | None = None,
) -> DataFrame:
    """CR1 sandwich with the factor G/(G-1) * (N-1)/(N-k).

    Returns one row: ``beta``, ``se``, ``n``, ``clusters``. Each cluster's score
    is a sum combined before the shuffle, and the clusters' outer products are
    added like any other cross-products, so many clusters (PSUs) are fine too.
    """
    columns = design.columns()
    k = len(columns)
    rows = design.complete(df).filter(label.isNotNull() & weight.isNotNull())
    rows = rows.withColumn("_y", label).withColumn("_w", weight)
    factors = factor(rows, [*[c for _, c in columns], F.col("_y")], F.col("_w"))
    fit = fit or fit_from_factors(factors, k)
    scored = attach_row(rows, fit.select("beta"))
    error = F.col("_y") - design.dot("beta")
    scored = scored.select(
        F.col(cluster).alias("_g"),
        (F.col("_w") * error).alias("_we"),
        *[c.alias(f"_x{i}") for i, (_, c) in enumerate(columns)],
    )
    scores = scored.groupBy("_g").agg(
        *[F.sum(F.col("_we") * F.col(f"_x{i}")).alias(f"_s{i}") for i in range(k)]
    )
    meat = factor(scores, [F.col(f"_s{i}") for i in range(k)])

    @F.pandas_udf("array<double>")
    def sandwich(bread: pd.Series, middle: pd.Series, n: pd.Series, g: pd.Series) -> pd.Series:
        def one(b, m, n_, g_):
            beta, inverse = solve_factor(b, k)
            keep = np.flatnonzero(~np.isnan(beta))
            half = np.zeros((k, k))
            half[np.triu_indices(k)] = m
            side = half[:, keep] @ inverse[np.ix_(keep, keep)]
            v = side.T @ side
            if g_ < 2 or n_ <= len(keep):
                return [None] * k
            v = v * (g_ / (g_ - 1)) * ((n_ - 1) / (n_ - len(keep)))
            se: list[float | None] = [None] * k
            for at, value in zip(keep, np.sqrt(np.diag(v))):
                se[at] = float(value)
            return se

        return pd.Series([one(*row) for row in zip(bread, middle, n, g)])

    joined = attach_row(
        attach_row(factors, fit.select("beta")),
        meat.select(F.col("factor").alias("_meat"), F.col("n").alias("clusters")),
    )
    se = sandwich(F.col("factor"), F.col("_meat"), F.col("n"), F.col("clusters"))
    return joined.select("beta", se.alias("se"), "n", "clusters")


def t_tail(t: float, df: int) -> float:
    """Two-sided p value of Student's t for whole degrees of freedom."""
    if df > 400:
        return math.erfc(abs(t) / math.sqrt(2))
    theta = math.atan2(abs(t), math.sqrt(df))
    cos2 = math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for i in range((df - 1) // 2):
            total += term
            term *= cos2 * (2 * i + 2) / (2 * i + 3)
        inside = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        term, total = 1.0, 0.0
        for i in range(df // 2):
            total += term
            term *= cos2 * (2 * i + 1) / (2 * i + 2)
        inside = math.sin(theta) * total
    return min(1.0, max(0.0, 1.0 - inside))


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(a) else t_tail(float(a), int(b)) for a, b in zip(t, df)
    ], dtype="float64")


def coef_table(
    covariance: DataFrame,
    design: Design,
    omit: str | None = None,
    digits: int | None = None,
    strip: str | None = None,
    stars: Sequence[float] = (0.01, 0.05, 0.1),
) -> DataFrame:
    """Estimates by term with standard errors, t, p and significance stars.

    ``omit`` drops terms matching a pattern; ``strip`` removes the first match of
    a pattern from term names. Degrees of freedom are the clusters less one.
    """
    names = F.array(*[F.lit(n) for n in design.names])
    entries = F.arrays_zip(names.alias("term"), F.col("beta"), F.col("se"))
    table = covariance.select("clusters", F.inline(entries)).toDF(
        "clusters", "term", "estimate", "std_error"
    )
    if omit:
        table = table.filter(~F.col("term").rlike(omit))
    if strip:
        quoted = F.regexp_extract("term", f"^(.*?){strip}(.*)$", 1)
        after = F.regexp_extract("term", f"^(.*?){strip}(.*)$", 2)
        table = table.withColumn(
            "term",
            F.when(F.col("term").rlike(strip), F.concat(quoted, after)).otherwise(F.col("term")),
        )
    table = table.withColumn("t", F.try_divide("estimate", "std_error"))
    table = table.withColumn("p", _p_value(F.col("t"), F.col("clusters") - 1))
    marks = F.lit("")
    for i, level in enumerate(sorted(stars, reverse=True)):
        marks = F.when(F.col("p") < level, "*" * (i + 1)).otherwise(marks)
    table = table.withColumn("stars", marks).drop("clusters")
    if digits is None:
        return table
    return table.select(
        "term", *[F.round(c, digits).alias(c) for c in ("estimate", "std_error", "t", "p")], "stars"
    )


def poverty_weight(y: Column, cutoff: Column, weight: Column) -> Column:
    """Weights that keep only rows at or under ``cutoff``."""
    return F.when(y <= cutoff, weight).otherwise(0.0)
