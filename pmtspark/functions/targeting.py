"""Aggregate column builders for poverty classification.

``w`` need not be normalised: every rate is a ratio of weight sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pmtspark.functions.recode import safe_ratio


def weight_where(cond: Column, w: Column) -> Column:
    return F.sum(F.when(cond, w).otherwise(F.lit(0.0)))


def weighted_share(cond: Column, w: Column) -> Column:
    """Share of the weight for which ``cond`` holds, e.g. the headcount y <= z."""
    return safe_ratio(weight_where(cond, w), F.sum(w))


def targeting_exprs(
    y: Column, yhat: Column, z: Column, zhat: Column, w: Column
) -> dict[str, Column]:
    """Targeting measures at a true line ``z`` and a fixed-rate line ``zhat``.

    H: share predicted poor. IER: of the predicted poor, share not poor.
    EER: of the poor, share predicted non-poor. TER: EER under ``zhat``.
    """
    poor, chosen = y <= z, yhat <= z
    n_poor, n_chosen = weight_where(poor, w), weight_where(chosen, w)
    return {
        "H": safe_ratio(n_chosen, F.sum(w)),
        "IER": safe_ratio(weight_where(chosen & ~poor, w), n_chosen),
        "EER": safe_ratio(weight_where(poor & ~chosen, w), n_poor),
        "TER": safe_ratio(weight_where(poor & (yhat > zhat), w), n_poor),
    }


def cell_sums(poor: Column, chosen: Column, w: Column) -> dict[str, Column]:
    """Weight in each cell of the poverty confusion matrix."""
    return {
        "tn": weight_where(~poor & ~chosen, w),
        "fp": weight_where(~poor & chosen, w),
        "fn": weight_where(poor & ~chosen, w),
        "tp": weight_where(poor & chosen, w),
    }


def confusion_exprs(poor: Column, chosen: Column, w: Column) -> dict[str, Column]:
    """Confusion matrix as shares of the total weight."""
    total = F.sum(w)
    return {k: safe_ratio(v, total) for k, v in cell_sums(poor, chosen, w).items()}


def derived_measures() -> dict[str, Column]:
    """Measures of a row holding tn, fp, fn and tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "precision": safe_ratio(tp, tp + fp),
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "one_minus_leakage": 1 - safe_ratio(fp, tp + fp),
        "coverage": safe_ratio(tp, tp + fn),
        "f2": safe_ratio(5 * tp, 5 * tp + 4 * fn + fp),
    }


def chi2_exprs(n: Column | None = None) -> dict[str, Column]:
    """Pearson and likelihood-ratio chi-square of the 2x2 table.

    The cells may be counts, or shares together with the sample size ``n``.
    """
    scale = F.lit(1.0) if n is None else n
    tn, fp, fn, tp = (F.col(c) * scale for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    cells = (
        (tn, tn + fp, tn + fn),
        (fp, tn + fp, fp + tp),
        (fn, fn + tp, tn + fn),
        (tp, fn + tp, fp + tp),
    )
    chi2, lr = F.lit(0.0), F.lit(0.0)
    for seen, row, col in cells:
        expected = safe_ratio(row * col, total)
        chi2 = chi2 + safe_ratio(F.pow(seen - expected, 2), expected)
        lr = lr + F.when(seen > 0, 2 * seen * F.ln(safe_ratio(seen, expected))).otherwise(0.0)
    return {"chi2": chi2, "lr_chi2": lr}
