"""Random halves, repeated splits and their summaries.

Randomness is the order of hash keys made of the id and the seed, so a split
depends on the ids alone and not on partitioning. The half of exact size is found by radix
selection: hashes are counted by their next digits below the digits that hold the boundary,
until a bounded number of rows is left; the boundary key then flags every row without sorting
or shuffling the table. ``replicates`` does the same for many halves at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS, HASH_DIGITS = 3, 32
#: Rows that are left to be sorted for the boundary of a half.
PICK_ROWS = 4096


def hash_key(id_col: str, seed: int, block: Column | None = None) -> Column:
    parts = [F.col(id_col).cast("string"), F.lit(str(seed))]
    if block is not None:
        parts.append(block.cast("string"))
    return F.md5(F.concat_ws(":", *parts))


def half_edge(
    df: DataFrame, id_col: str, seed: int, share: float = 0.5, rows: int = PICK_ROWS
) -> tuple[str, object] | None:
    """The last (hash, id) inside ``round(n * share)`` rows, half to even; None if that is 0.

    Every pass counts the hashes below the chosen digits by their next ``DIGITS`` digits, and
    ends when at most ``rows`` rows, which are then sorted, or no digits are left.
    """
    keyed = df.select(hash_key(id_col, seed).alias("_h"), F.col(id_col).alias("_id"))
    prefix, rank = "", None
    while True:
        at = len(prefix) + DIGITS
        digits = F.substring("_h", 1, at).alias("_p")
        counts = keyed.filter(F.col("_h").startswith(prefix)).groupBy(digits).count().collect()
        if rank is None:
            rank = round(sum(r["count"] for r in counts) * share)
            if rank == 0:
                return None
        for prefix, n in sorted((r["_p"], r["count"]) for r in counts):
            if rank <= n:
                break
            rank -= n
        if n <= rows or at >= HASH_DIGITS:
            break
    near = keyed.filter(F.col("_h").startswith(prefix)).orderBy("_h", "_id")
    edge = near.offset(rank - 1).first()
    return edge["_h"], edge["_id"]


def split_half(
    df: DataFrame, id_col: str, seed: int, share: float = 0.5, flag: str = "test"
) -> DataFrame:
    """Flag ``round(n * share)`` rows, drawn without replacement.

    ``id_col`` must be unique. The caller decides which side is the test half.
    """
    edge = half_edge(df, id_col, seed, share)
    if edge is None:
        return df.withColumn(flag, F.lit(False))
    h = hash_key(id_col, seed)
    inside = (h < edge[0]) | ((h == edge[0]) & (F.col(id_col) <= F.lit(edge[1])))
    return df.withColumn(flag, F.coalesce(inside, F.lit(False)))


def train_part(df: DataFrame, flag: str = "test") -> DataFrame:
    return df.filter(~F.col(flag))


def test_part(df: DataFrame, flag: str = "test") -> DataFrame:
    return df.filter(flag)


def complement(df: DataFrame, part: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``part``."""
    return df.join(part.select(id_col), id_col, "left_anti")


def bootstrap_ci(
    replicated: DataFrame,
    by: Sequence[str] = ("z", "covariates", "model", "measure"),
    value: str = "value",
    low: float = 0.05,
    high: float = 0.95,
) -> DataFrame:
    """Mean and percentile interval over replicates (one value per replicate)."""
    return replicated.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(low)).alias("ci_low"),
        F.percentile(value, F.lit(high)).alias("ci_high"),
    )
