"""Column builders for coded survey answers, with three-valued logic kept."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_set(col: Column, values: Sequence) -> Column:
    """Membership that is FALSE, not NULL, for a missing answer."""
    return F.coalesce(col.isin(*values), F.lit(False))


def any3(cond: Column) -> Column:
    """Aggregate OR: TRUE if any is TRUE, else NULL if any is NULL, else FALSE."""
    return (
        F.when(F.bool_or(cond), F.lit(True))
        .when(F.count_if(cond.isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def max_or_neg_inf(col: Column) -> Column:
    """Aggregate max over the known values; -inf where none is known."""
    return F.coalesce(F.max(col.cast("double")), F.lit(float("-inf")))


def yes_no(col: Column) -> Column:
    """1 is TRUE, 2 is FALSE, anything else missing."""
    return F.when(col == 1, F.lit(True)).when(col == 2, F.lit(False))


def if_known(cond: Column, yes: Column, no: Column) -> Column:
    """``yes`` or ``no``, and NULL where the condition is unknown."""
    return F.when(cond, yes).when(~cond, no)


def bin_right(
    col: Column, breaks: Sequence[float], labels: Sequence[str], include_lowest: bool = True
) -> Column:
    """Intervals (a, b]; the lowest break belongs to the first one."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        low, high = breaks[i], breaks[i + 1]
        above = col >= low if i == 0 and include_lowest else col > low
        out = F.when(above & (col <= high), F.lit(labels[i])).otherwise(out)
    return out


def left_labels(breaks: Sequence[float]) -> list[str]:
    """Interval names such as ``[14,24)`` and ``[9,Inf)``."""

    def text(b: float) -> str:
        return "Inf" if math.isinf(b) else f"{b:g}"

    return [f"[{text(a)},{text(b)})" for a, b in zip(breaks, breaks[1:])]


def bin_left(col: Column, breaks: Sequence[float]) -> Column:
    """Intervals [a, b), named after their bounds."""
    out = F.lit(None).cast("string")
    for label, low, high in zip(left_labels(breaks), breaks, breaks[1:]):
        inside = col >= low if math.isinf(high) else (col >= low) & (col < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def cross_levels(a: Column, b: Column, sep: str = "_") -> Column:
    """Cross two categories; missing if either is."""
    return F.concat(a, F.lit(sep), b)


def collapse_levels(col: Column, groups: Mapping[str, Sequence]) -> Column:
    """Merge codes into named levels; other codes keep their own name."""
    out = col.cast("string")
    for name, codes in groups.items():
        out = F.when(col.isin(*codes), F.lit(name)).otherwise(out)
    return out


def recode(col: Column, names: Mapping[str, str]) -> Column:
    """Rename levels; levels without a new name stay."""
    out = col
    for old, new in names.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and NULL where b is zero."""
    return F.try_divide(a, b)


def thousands(col: Column, digits: int = 0) -> Column:
    """Number as text with thousands marks."""
    return F.format_number(col, digits)
