"""Long to wide, wide to long, and stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmtspark.functions import cross_levels


def pivot_values(
    df: DataFrame, keys: Sequence[str], name_col: str, names: Mapping, agg
) -> DataFrame:
    """One column per code, ``names`` mapping code -> column name.

    ``agg`` reduces the (possibly repeated) cell, e.g. ``lambda c: F.min(c)`` over
    a masked value; written as conditional aggregates, so the cells combine before
    the shuffle and no distinct-values pass is needed.
    """
    cells = [agg(F.col(name_col) == code).alias(out) for code, out in names.items()]
    return df.groupBy(*keys).agg(*cells)


def pivot_any(
    df: DataFrame, keys: Sequence[str], name_col: str, cond: Column, names: Mapping
) -> DataFrame:
    """Tri-state any of ``cond`` per code, FALSE only where the code never occurs.

    A code that occurs with nothing but unknown or FALSE-and-unknown answers stays
    NULL; a combination absent from the data is filled with FALSE.
    """

    def cell(here: Column) -> Column:
        answer = F.when(here, cond)
        return (
            F.when(F.bool_or(answer), F.lit(True))
            .when(F.count_if(here & cond.isNull()) > 0, F.lit(None).cast("boolean"))
            .otherwise(F.lit(False))
        )

    return pivot_values(df, keys, name_col, names, cell)


def pivot_composite(
    df: DataFrame, keys: Sequence[str], parts: Sequence[str], value: str, names: Sequence[str]
) -> DataFrame:
    """Wide table whose column names join several keys, e.g. ``Continuous_OLS``."""
    label = reduce(cross_levels, [F.col(p) for p in parts])
    return (
        df.withColumn("_name", label)
        .groupBy(*keys)
        .pivot("_name", list(names))
        .agg(F.first(value, ignorenulls=True))
    )


def unpivot_measures(
    df: DataFrame, ids: Sequence[str], values: Sequence[str] = ("H", "IER", "EER", "TER")
) -> DataFrame:
    return df.unpivot(list(ids), list(values), "measure", "value")


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
