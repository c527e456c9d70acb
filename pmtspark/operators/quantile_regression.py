"""Linear quantile regression by smoothed Newton steps, ended by a duality gap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmtspark.operators.design import Design
from pmtspark.operators.replicates import sum_arrays
from pmtspark.sources import materialise

#: Lengths of a Newton step, and shares of the full cross-products that are added to its matrix:
#: few rows may stand inside a band, and do not determine every coefficient.
STEPS = (1.0, 0.5, 0.2, 0.05)
NARROWER = 5.0
DAMPING = (1e-7, 1e-5, 1e-3, 1e-1, 10.0)
CHUNK_ROWS = 4096


class NotConverged(RuntimeError):
    """The duality gap did not close."""


@dataclass(frozen=True)
class QuantileFit:
    """Coefficients with the proof that they are (nearly) the best.

    ``loss`` is the weighted check loss, and no coefficients have a loss below
    ``loss - gap``. ``imbalance`` holds per term the subgradient over the sum of
    weight * |column|: of the weight, each column's share above and below the fit is in balance.
    """

    beta: list[float]
    n: int
    loss: float
    gap: float
    imbalance: list[float]
    passes: int


@dataclass
class _Sums:
    """Sums over all rows at some coefficients and band width."""

    n: float
    inside: float  # rows with a weight inside the band
    loss: float  # check loss
    smooth: float  # the same with the kink rounded inside the band
    dual: float  # residuals times the dual weights
    scale: np.ndarray  # weight * |column|
    slope: np.ndarray  # columns times the dual weights
    curve: np.ndarray


def _measure(
    rows: DataFrame, betas: list[np.ndarray], tau: float, band: float, k: int
) -> list[_Sums]:
    """One scan for several candidates; a task yields a few k x k sums each."""
    i, j = np.triu_indices(k)
    table = np.array(betas)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(table), 5 + 2 * k + len(i)))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                y, w = (part.column(c).to_numpy(zero_copy_only=False) for c in "yw")
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), k)
                products = x[:, i] * x[:, j]
                for s, beta in zip(sums, table, strict=True):
                    r = y - x @ beta
                    near = np.clip(r / band, -1.0, 1.0)
                    pull = w * (tau - 0.5 + near / 2)
                    inside = np.abs(near) < 1
                    rounded = np.where(inside, r * r / (4 * band) + band / 4, np.abs(r) / 2)
                    s[0] += len(y)
                    s[1] += (inside & (w > 0)).sum()
                    s[2] += (w * ((tau - 0.5) * r + np.abs(r) / 2)).sum()
                    s[3] += (w * ((tau - 0.5) * r + rounded)).sum()
                    s[4] += (pull * r).sum()
                    s[5 : 5 + k] += w @ np.abs(x)
                    s[5 + k : 5 + 2 * k] += pull @ x
                    s[5 + 2 * k :] += (w[inside] / (2 * band)) @ products[inside]
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(range(len(table)), pa.int32()), "part": pa.array(list(sums))}
        )

    parts = rows.mapInArrow(add, "at int, part array<double>")
    out = []
    for row in sum_arrays(parts, ["at"], ["part"]).orderBy("at").collect():
        s = np.array(row.part)
        curve = np.zeros((k, k))
        curve[i, j] = curve[j, i] = s[5 + 2 * k :]
        out.append(_Sums(*s[:5], s[5 : 5 + k], s[5 + k : 5 + 2 * k], curve))
    return out


def _corner(rows: DataFrame, beta: np.ndarray, tau: float, band: float) -> tuple | None:
    """The fit through the rows next to ``beta``, if it is the best one: (beta, sums, slopes).

    A best fit goes through as many rows as it has coefficients. It is the best if the weights
    that balance the slopes of all other rows are ones that the dual problem allows.
    """
    k = len(beta)
    distance = F.abs(
        F.col("y")
        - F.expr(f"aggregate(zip_with(x, array({', '.join(f'{float(b)!r}D' for b in beta)}), "
                 "(a, b) -> a * b), 0D, (s, v) -> s + v)")
    )
    near = rows.filter("w > 0").orderBy(distance).limit(4 * k).collect()
    chosen, basis = [], np.zeros((0, k))
    for row in near:
        x = np.array(row.x)
        rest = x - basis.T @ (basis @ x)
        rest -= basis.T @ (basis @ rest)
        if np.linalg.norm(rest) > 1e-9 * np.linalg.norm(x):
            chosen.append(row)
            basis = np.vstack([basis, rest / np.linalg.norm(rest)])
    x, y, w = (np.array([r[c] for r in chosen]) for c in "xyw")
    beta = np.linalg.lstsq(x, y, rcond=1e-12)[0]
    sums = _measure(rows, [beta], tau, band, k)[0]
    if sums.inside != len(chosen):
        return None
    others = sums.slope - x.T @ (w * (tau - 0.5))
    pull = np.linalg.lstsq(x.T, -others, rcond=1e-12)[0]
    left = others + x.T @ pull
    allowed = (pull >= w * (tau - 1) - 1e-9 * w) & (pull <= w * tau + 1e-9 * w)
    return (beta, sums, left) if allowed.all() else None


def quantile_regression(
    df: DataFrame,
    design: Design,
    label: Column,
    tau: float = 0.5,
    weight: Column | None = None,
    tolerance: float = 1e-6,
    most_passes: int = 200,
) -> QuantileFit:
    """Coefficients of the ``tau`` quantile of ``label``, weighted.

    The check loss is rounded inside a band around the fit, which makes it quadratic there, and
    Newton steps on the rounded loss use a k x k matrix summed over all rows; a step measures
    several lengths in one scan. At the best coefficients for a band, the rounded slopes are
    weights that the dual problem allows, so the loss of the best fit is bounded from below; the
    band is narrowed until that bound is within ``tolerance`` of the loss. Raises
    ``NotConverged`` if it is not after ``most_passes`` scans.

    Where few rows are left inside the band, the fit through the rows next to it is tried.

    The rows' columns are written once, around their means and in units of their spread. Rows
    with an unknown term, label or weight count nowhere. Columns explained by others get the
    least coefficients of all equal fits.
    """
    columns = [c for _, c in design.columns()]
    k = len(columns)
    known = design.complete(df).select(
        label.cast("double").alias("y"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("w"),
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
    )
    known = known.filter("y IS NOT NULL AND w IS NOT NULL")
    start = 1 if design.intercept else 0
    center = known.agg(
        F.count("*").alias("n"),
        F.sum("w").alias("w"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("sd"),
        F.array(*[F.avg(f"x{i}") for i in range(k)]).alias("means"),
        F.array(*[F.stddev_pop(f"x{i}") for i in range(k)]).alias("spreads"),
    ).first()
    if not center.n or not center.w or center.w <= 0:
        raise ValueError("no rows with a weight")
    spread = np.array([s if i >= start and s and s > 0 else 1.0 for i, s in enumerate(center.spreads)])
    mean = np.array([m if start and i >= start and center.spreads[i] else 0.0 for i, m in enumerate(center.means)])
    scaled = [(F.col(f"x{i}") - float(mean[i])) / float(spread[i]) for i in range(k)]
    rows = materialise(known.select("y", "w", F.array(*scaled).alias("x")), "quantile-rows")

    def result(beta: np.ndarray, sums: _Sums, gap: float, slope: np.ndarray) -> QuantileFit:
        raw = beta / spread
        if start:
            raw[0] -= raw @ mean
        imbalance = slope / np.where(sums.scale > 0, sums.scale, 1.0)
        return QuantileFit(raw.tolist(), int(sums.n), sums.loss, gap, imbalance.tolist(), passes)

    beta, passes = np.zeros(k), 1
    unit = center.sd if center.sd else 1.0
    band = unit
    # at the median, so wide a band rounds the loss everywhere: this step is least squares
    wide = 1e6 * (band + abs(center.mean))
    here = _measure(rows, [beta], 0.5, wide, k)[0]
    passes += 1
    beta = beta + np.linalg.lstsq(here.curve, here.slope, rcond=1e-12)[0]
    full = here.curve * 2 * wide

    def moves(here: _Sums, band: float) -> list[np.ndarray]:
        damped = [
            np.linalg.lstsq(here.curve + share * full / (2 * band), here.slope, rcond=1e-12)[0]
            for share in DAMPING
        ]
        return [*(t * damped[0] for t in STEPS), *damped[1:]]

    gap = np.inf
    while band > 1e-12 * unit:
        here = _measure(rows, [beta], tau, band, k)[0]
        passes += 1
        while True:
            if passes >= most_passes:
                raise NotConverged(f"gap {gap} of a loss of {here.loss} after {passes} scans")
            tried = [beta + m for m in moves(here, band)]
            found = _measure(rows, tried, tau, band, k)
            passes += 1
            best = min(range(len(tried)), key=lambda s: found[s].smooth)
            gain = here.smooth - found[best].smooth
            if gain > 0:
                beta, here = tried[best], found[best]
            uneven = np.abs(here.slope / np.where(here.scale > 0, here.scale, 1.0)).max()
            if uneven <= tolerance / 10 or gain <= 1e-3 * tolerance * here.loss:
                break
        gap = abs(here.loss - here.dual) + abs(float(here.slope @ beta))
        if here.loss == 0 or (gap <= tolerance * here.loss and uneven <= tolerance):
            return result(beta, here, gap, here.slope)
        if here.inside <= 4 * k:
            corner = _corner(rows, beta, tau, 1e-7 * unit)
            passes += 2
            if corner is not None:
                beta, here, slope = corner
                return result(beta, here, abs(float(slope @ beta)), slope)
        band /= NARROWER
    raise NotConverged(f"gap {gap} of a loss of {here.loss} after {passes} scans")
