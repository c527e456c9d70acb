"""Survey weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as scalar subqueries."""
    names = row.columns
    packed = row.select(F.struct(*names)).scalar()
    return df.withColumn("_row", packed).select(
        *df.columns, *[F.col(f"_row.{c}").alias(c) for c in names]
    )


def normalise(
    df: DataFrame, weight: str = "mult", out: str = "w", by: Sequence[str] = ()
) -> DataFrame:
    """Weights summing to one, over the frame or within each group."""
    if not by:
        total = df.agg(F.sum(weight)).scalar()
        return df.withColumn(out, F.try_divide(F.col(weight), total))
    totals = df.groupBy(*by).agg(F.sum(weight).alias("_total"))
    joined = df.join(totals, list(by))
    return joined.withColumn(out, F.try_divide(F.col(weight), F.col("_total"))).drop("_total")


def weighted_means(
    df: DataFrame, columns: Sequence[str], weight: str = "mult", digits: int | None = 3
) -> DataFrame:
    """Weighted mean and linearised standard error of many variables, in one pass.

    Boolean variables count as the share of TRUE. Rows with an unknown value are
    left out of that variable only.
    """
    types = {f.name: f.dataType for f in df.schema}
    w = F.col(weight)

    def number(c: str) -> Column:
        col = F.col(c)
        return (col.cast("int") if isinstance(types[c], T.BooleanType) else col).cast("double")

    sums = []
    for c in columns:
        x = number(c)
        seen = F.when(x.isNotNull(), w)
        sums.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.count(seen).cast("double").alias("n"),
                F.sum(seen).alias("w"),
                F.sum(w * x).alias("wx"),
                F.sum(seen * seen).alias("ww"),
                F.sum(w * w * x).alias("wwx"),
                F.sum(w * w * x * x).alias("wwxx"),
            )
        )
    rows = df.agg(F.array(*sums).alias("s")).select(F.inline("s"))
    mean = F.try_divide(F.col("wx"), F.col("w"))
    spread = F.col("wwxx") - 2 * mean * F.col("wwx") + mean * mean * F.col("ww")
    variance = F.try_divide(F.col("n"), F.col("n") - 1) * F.greatest(spread, F.lit(0.0))
    out = rows.select(
        "variable", mean.alias("mean"), F.try_divide(F.sqrt(variance), F.col("w")).alias("se")
    )
    if digits is None:
        return out
    return out.select("variable", *[F.round(c, digits).alias(c) for c in ("mean", "se")])
