"""Tables behind the published charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.functions import recode, thousands

# Display names.
MEASURE_NAMES = {
    "EER": "Exclusion Error Rate",
    "IER": "Inclusion Error Rate",
    "TER": "Targeting Error Rate",
}


def error_report(results: DataFrame, z: float) -> DataFrame:
    """Error rates at one line with display names."""
    return (
        results.filter((F.col("z") == float(z)) & (F.col("measure") != "H"))
        .withColumn("covariates", F.concat(F.col("covariates"), F.lit(" \n Covariates")))
        .withColumn("measure", recode(F.col("measure"), MEASURE_NAMES))
    )


def headcount_report(results: DataFrame, covariates: str = "Basic", mean: str = "mean") -> DataFrame:
    """Poverty rate reached against the rate aimed at."""
    gap = F.col(mean) - F.col("z")
    return (
        results.filter((F.col("measure") == "H") & (F.col("covariates") == covariates))
        .withColumn("gap", gap)
        .withColumn("flag", F.when(gap < 0, "red").when(gap >= 0, "green"))
    )


def line_label(line: str, q: float):
    """Text such as ``F(14,925) = 0.2``."""
    return F.concat(F.lit("F("), thousands(F.col(line)), F.lit(f") = {q:g}"))
