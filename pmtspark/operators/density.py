"""Weighted kernel density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pmtspark.operators.measures import line_array
from pmtspark.operators.quantile import quantile
from pmtspark.operators.weights import attach_row

#: Bandwidths beyond which a kernel's share of the whole is under 1e-14.
TAIL = 8.0


def bandwidth_nrd0(df: DataFrame, x: str) -> DataFrame:
    """One row: bandwidth ``bw`` = 0.9 * min(sd, IQR / 1.34) * n^-0.2, ``lo`` and ``hi``.

    Weights play no part. Where the spread so measured is zero, sd, then |x|, then
    one stand in for it.
    """
    quartiles = line_array(quantile(df, x, [0.25, 0.75]), [0.25, 0.75], "_q")
    stats = df.agg(
        F.stddev_samp(x).alias("_sd"), F.count(x).alias("_n"), F.min(x).alias("lo"),
        F.max(x).alias("hi"),
    )
    both = attach_row(stats, quartiles)
    iqr = (F.get(F.col("_q"), F.lit(1)) - F.get(F.col("_q"), F.lit(0))) / 1.34
    spread = F.coalesce(
        *[
            F.when(s != 0, s)
            for s in (F.least("_sd", iqr), F.col("_sd"), F.abs(F.col("lo")))
        ],
        F.lit(1.0),
    )
    return both.select(
        (F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("bw"),
        "lo",
        "hi",
    )


def weighted_density(
    df: DataFrame, x: str, w: str, points: int = 512, fineness: int = 256, reach: float = 3.0
) -> DataFrame:
    """Gaussian density of x under weights summing to one: ``grid_x``, ``density``.

    The grid runs ``reach`` bandwidths past the data. Rows are first shared out to knots
    1 / ``fineness`` of a bandwidth apart, each to its two neighbours by distance, which
    changes no density by more than 0.05 / (bandwidth * fineness^2); only the knots' weights
    leave the tasks. A knot then adds to the grid points within TAIL bandwidths.
    """
    frame = bandwidth_nrd0(df, x)
    edges = frame.select(
        "bw",
        (F.col("lo") - reach * F.col("bw")).alias("_from"),
        (F.col("hi") + reach * F.col("bw")).alias("_to"),
        (F.col("bw") / fineness).alias("_step"),
    )
    rows = df.filter(F.col(x).isNotNull()).select(
        F.col(x).cast("double").alias("_x"), F.col(w).cast("double").alias("_w")
    )
    rows = attach_row(rows, edges.select("_from", "_step"))
    place = (F.col("_x") - F.col("_from")) / F.col("_step")
    rows = rows.withColumn("_k", F.floor(place)).withColumn("_part", place - F.col("_k"))
    here = F.struct(F.col("_k").alias("k"), (F.col("_w") * (1 - F.col("_part"))).alias("m"))
    next_ = F.struct((F.col("_k") + 1).alias("k"), (F.col("_w") * F.col("_part")).alias("m"))
    knots = rows.select(F.inline(F.array(here, next_))).groupBy("k").agg(F.sum("m").alias("m"))
    spaced = attach_row(
        knots, edges.withColumn("_gap", (F.col("_to") - F.col("_from")) / (points - 1))
    )
    center, tail = F.col("k") * F.col("_step"), TAIL * F.col("bw")
    least = F.greatest(F.ceil((center - tail) / F.col("_gap")), F.lit(0))
    most = F.least(F.floor((center + tail) / F.col("_gap")), F.lit(points - 1))
    near = spaced.filter(least <= most).withColumn("g", F.explode(F.sequence(least, most)))
    u = (F.col("g") * F.col("_gap") - center) / F.col("bw")
    kernel = F.exp(-0.5 * u * u) / (F.col("bw") * (2 * 3.141592653589793) ** 0.5)
    sums = near.groupBy("g").agg(F.sum(F.col("m") * kernel).alias("density"))
    grid = edges.filter("_from IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("g"), "_from", "_to"
    )
    at = F.col("_from") + F.col("g") * (F.col("_to") - F.col("_from")) / (points - 1)
    return grid.join(sums, "g", "left").select(
        at.alias("grid_x"), F.coalesce("density", F.lit(0.0)).alias("density")
    )


def below_line(density: DataFrame, line: DataFrame) -> DataFrame:
    """The part of the curve left of a line (one-row frame with column ``line``)."""
    return attach_row(density, line).filter(F.col("grid_x") < F.col("line"))


def mass_below(density: DataFrame, line: DataFrame) -> DataFrame:
    """Trapezoid mass under the part of the curve left of the line.

    The window runs over the curve's grid points, whose number is fixed.
    """
    order = Window.orderBy("grid_x")
    width = F.col("grid_x") - F.lag("grid_x").over(order)
    height = (F.col("density") + F.lag("density").over(order)) / 2
    pieces = below_line(density, line).withColumn("_a", width * height)
    return pieces.agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("_a"), F.lit(0.0)).alias("mass")
    )
