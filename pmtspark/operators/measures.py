"""Targeting errors, confusion measures and curves over poverty lines.

Lines are few and known before the pass, so every line adds some conditional sums
to one aggregate; rows are never multiplied by lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmtspark.functions import confusion_exprs, derived_measures, safe_ratio, targeting_exprs
from pmtspark.functions.targeting import chi2_exprs, weight_where
from pmtspark.operators.quantile import running_sums
from pmtspark.operators.weights import attach_row


def line_array(quantiles: DataFrame, qs: Sequence[float], out: str, by: Sequence[str] = ()):
    """Quantiles of each group as one array column in the order of ``qs``."""
    slots = [F.max(F.when(F.col("q") == float(q), F.col("value"))) for q in qs]
    return quantiles.groupBy(*by).agg(F.array(*slots).alias(out))


def attach_lines(df: DataFrame, lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add line arrays to the rows, of their group or of all."""
    return df.join(lines, list(by)) if by else attach_row(df, lines)


def targeting_measures(
    df: DataFrame,
    qs: Sequence[float],
    y: str = "y",
    yhat: str = "yhat",
    w: str = "w",
    z: str = "z",
    zhat: str = "zhat",
    by: Sequence[str] = (),
) -> DataFrame:
    """H, IER, EER and TER at each line of the arrays ``z`` and ``zhat``.

    Returns ``by``, ``z`` (the quantile that set the line), ``line``, ``rate_line``
    and the four measures.
    """
    rows = []
    for i, q in enumerate(qs):
        line, rate = F.get(F.col(z), F.lit(i)), F.get(F.col(zhat), F.lit(i))
        exprs = targeting_exprs(F.col(y), F.col(yhat), line, rate, F.col(w))
        rows.append(
            F.struct(
                F.lit(float(q)).alias("z"),
                F.max(line).alias("line"),
                F.max(rate).alias("rate_line"),
                *[e.alias(m) for m, e in exprs.items()],
            )
        )
    return df.groupBy(*by).agg(F.array(*rows).alias("_r")).select(*by, F.inline("_r"))


def headcount(df: DataFrame, y: str, w: str, line: Column) -> Column:
    """Aggregate: share of the weight at or under the line."""
    return safe_ratio(weight_where(F.col(y) <= line, F.col(w)), F.sum(w))


def confusion(
    df: DataFrame, poor: Column, chosen: Column, w: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Weight shares tn, fp, fn, tp and the row count n."""
    cells = confusion_exprs(poor, chosen, w)
    return df.groupBy(*by).agg(
        *[e.alias(c) for c, e in cells.items()], F.count(F.lit(1)).alias("n")
    )


def confusion_measures(matrix: DataFrame) -> DataFrame:
    return matrix.select("*", *[e.alias(m) for m, e in derived_measures().items()])


def confusion_chi2(matrix: DataFrame) -> DataFrame:
    return matrix.select("*", *[e.alias(m) for m, e in chi2_exprs(F.col("n")).items()])


def mean_squared_error(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(y) - F.col(yhat), 2)).alias("mse"))


def coverage_curve(
    df: DataFrame,
    grid: Sequence[float],
    y: str = "y",
    yhats: Sequence[str] = ("yhat",),
    w: str = "w",
    lines: str = "z",
) -> DataFrame:
    """Coverage and leakage of each predictor at every line of the array ``lines``.

    A household is rightly chosen when max(y, yhat) <= line, so each rate is a
    ratio of two points on weighted distribution functions.
    """
    weight = F.col(w)
    cells = []
    for yhat in yhats:
        both = F.greatest(F.col(y), F.col(yhat))
        for i, g in enumerate(grid):
            line = F.get(F.col(lines), F.lit(i))
            poor = weight_where(F.col(y) <= line, weight)
            chosen = weight_where(F.col(yhat) <= line, weight)
            hit = weight_where(both <= line, weight)
            cells.append(
                F.struct(
                    F.lit(yhat).alias("predictor"),
                    F.lit(float(g)).alias("q"),
                    F.max(line).alias("line"),
                    safe_ratio(hit, poor).alias("coverage"),
                    (1 - safe_ratio(hit, chosen)).alias("leakage"),
                )
            )
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def dominance(curve: DataFrame, first: str, second: str) -> DataFrame:
    """Whether one predictor's coverage is nowhere below the other's, and above once."""

    def of(name: str, out: str) -> DataFrame:
        part = curve.filter(F.col("predictor") == name)
        return part.select("q", F.coalesce("coverage", F.lit(0.0)).alias(out))

    diff = F.col("a") - F.col("b")
    return (
        of(first, "a")
        .join(of(second, "b"), "q")
        .agg(F.min(diff).alias("min_diff"), F.max(diff).alias("max_diff"))
        .select(
            F.lit(first).alias("first"),
            F.lit(second).alias("second"),
            "min_diff",
            "max_diff",
            ((F.col("min_diff") >= 0) & (F.col("max_diff") > 0)).alias("first_dominates"),
            ((F.col("max_diff") <= 0) & (F.col("min_diff") < 0)).alias("second_dominates"),
        )
    )


def coverage_steps(df: DataFrame, y: str, yhats: Sequence[str], w: str) -> DataFrame:
    """Every line at which a coverage curve can change, with each predictor's coverage there.

    Columns: ``line``, ``poor`` (weight at or under it) and ``coverage_<yhat>``. A household is
    rightly chosen from max(y, yhat) on and poor from y on, so the curves are step functions
    whose jumps are merged: equal lines are added up first, then all jumps are summed along
    the sorted lines. Lines under which nobody is poor have no coverage and are left out.
    """
    names = ["poor", *[f"_hit{i}" for i in range(len(yhats))]]
    starts = [F.col(y), *[F.greatest(F.col(y), F.col(yhat)) for yhat in yhats]]
    known = [F.col(c).isNotNull() for c in (y, w, *yhats)]
    jumps = F.array(
        *[
            F.struct(
                start.cast("double").alias("line"),
                *[(F.col(w) if i == j else F.lit(0)).cast("double").alias(n) for j, n in enumerate(names)],
            )
            for i, start in enumerate(starts)
        ]
    )
    rows = df
    for k in known:
        rows = rows.filter(k)
    steps = rows.select(F.inline(jumps)).groupBy("line").agg(*[F.sum(n).alias(n) for n in names])
    run = running_sums(steps, names, ["line"])
    return run.filter("poor_upto > 0").select(
        "line",
        F.col("poor_upto").alias("poor"),
        *[
            (F.col(f"_hit{i}_upto") / F.col("poor_upto")).alias(f"coverage_{yhat}")
            for i, yhat in enumerate(yhats)
        ],
    )


def dominance_everywhere(df: DataFrame, y: str, first: str, second: str, w: str) -> DataFrame:
    """As ``dominance``, over all lines at which either curve changes; ``lines`` counts them.

    Differences under 1e-12 count as none, for sums of doubles differ in their last digits.
    """
    steps = coverage_steps(df, y, [first, second], w)
    diff = F.col(f"coverage_{first}") - F.col(f"coverage_{second}")
    diff = F.when(F.abs(diff) < 1e-12, 0.0).otherwise(diff)
    return steps.agg(
        F.count(F.lit(1)).alias("lines"), F.min(diff).alias("min_diff"), F.max(diff).alias("max_diff")
    ).select(
        F.lit(first).alias("first"),
        F.lit(second).alias("second"),
        "lines",
        "min_diff",
        "max_diff",
        ((F.col("min_diff") >= 0) & (F.col("max_diff") > 0)).alias("first_dominates"),
        ((F.col("max_diff") <= 0) & (F.col("min_diff") < 0)).alias("second_dominates"),
    )
