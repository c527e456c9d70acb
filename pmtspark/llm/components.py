"""Connected components of large graphs, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.sources import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node around each node.

    The large step moves larger neighbours, the small one smaller neighbours and the node
    itself. Only minima are grouped, so a node with very many edges is no large group.
    """
    if large:
        ways = edges.select("u", "v").unionByName(
            edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        )
    else:
        ways = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = ways.join(least.hint("merge"), "u")
    moved = joined.where("v > u" if large else "v <= u").select(F.col("v").alias("a"), "m")
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), "m"))
    return (
        moved.where("a <> m")
        .select(F.greatest("a", "m").alias("u"), F.least("a", "m").alias("v"))
        .distinct()
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the least node joined to it.

    ``edges`` has two columns of long node ids; loops are dropped. Each round is written to
    the shared folder, which cuts lineage. Fails if ``most_rounds`` rounds do not end it.
    """
    a, b = edges.columns
    now = materialise(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    # of ids of any size: sums of the ids themselves would pass 64 bits
    both = F.xxhash64("u", "v")
    mark = F.struct(F.count("*"), F.sum(both % 1_000_003), F.bit_xor(both))
    last = now.select(mark.alias("x")).first().x
    for _ in range(most_rounds):
        now = materialise(_star(_star(now, True), False), "edges")
        mine = now.select(mark.alias("x")).first().x
        if mine == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        last = mine
    raise RuntimeError("components did not settle")
