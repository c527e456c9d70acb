"""Mixing sources to target weights: blocks, drawn counts per shard, permuted block indexes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmtspark.llm.text import WORD
from pmtspark.sources import materialise

NUMPY_MOST = 10**9  # numpy draws from fewer slots only
_SQUEEZE = (2 * (2 / math.e) ** 0.5, 3 - 2 * (3 / math.e) ** 0.5)  # of the rejection region


@dataclass(frozen=True)
class Source:
    """One source: documents, words, target, blocks and slots; ``key`` numbers the sources."""

    name: str | None
    key: int
    docs: int
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size.

    What is cut off is shared again by weight among the others, so all sources below
    their limit end at one common multiple of their weight.
    """
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = total, float(sum(weights))
    for i in order:
        out[i] = min(most * sizes[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def plan_sources(
    sized: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    block: int = 128,
    most: float = 3.0,
    max_sources: int = 100_000,
) -> list[Source]:
    """Counts, targets, blocks and slots of every source.

    One row per source comes to the driver; more than ``max_sources`` is an error.
    """
    per_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    rows = per_source.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    wanted = targets([r["size"] for r in rows], w, most)
    out = []
    for key, (r, target) in enumerate(zip(rows, wanted, strict=True)):
        blocks = -(-r["size"] // block)
        slots = round(target / r["size"] * blocks) if r["size"] else 0
        out.append(Source(r.source, key, r.n, r["size"], target, blocks, slots))
    return out


def log_factorial_step(n: int, d: int) -> float:
    """log (n + d)! - log n!, to rounding of the difference where both are large."""
    if n < 1000 or n + d < 1000:
        return math.lgamma(n + d + 1) - math.lgamma(n + 1)
    a, b = n + 1, n + d + 1  # Stirling's series, difference term by term
    series = (1 / b - 1 / a) / 12 - (1 / b**3 - 1 / a**3) / 360
    return d * math.log(a) + (b - 0.5) * math.log1p(d / a) - d + series


def draw_without_return(own: int, other: int, left: int, rng: np.random.Generator) -> int:
    """How many of ``left`` slots drawn without return are of ``own``, the rest of ``other``.

    A ratio-of-uniforms rejection: exact at any size, for probabilities are compared with the
    mode's by differences of log factorials and never by their large values.
    """
    total = own + other
    low, high = max(0, left - other), min(own, left)
    if low == high:
        return low
    mode = min(max((left + 1) * (own + 1) // (total + 2), low), high)
    share = own / total
    spread = left * share * (1 - share) * ((total - left) / max(total - 1, 1))
    width = _SQUEEZE[0] * (spread + 0.5) ** 0.5 + _SQUEEZE[1]
    offset = (left * own - mode * total) / total  # of the mean from the mode
    while True:
        x, y = 1 - rng.random(), rng.random()
        d = math.floor(offset + 0.5 + width * (y - 0.5) / x)
        if not low <= mode + d <= high:
            continue
        ratio = -(
            log_factorial_step(mode, d)
            + log_factorial_step(own - mode, -d)
            + log_factorial_step(left - mode, -d)
            + log_factorial_step(other - left + mode, d)
        )
        if 2 * math.log(x) <= ratio:
            return mode + d


def split_counts(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Draw ``left`` of all slots without return: how many of each source are among them."""
    out = np.zeros_like(counts)
    rest = int(counts.sum())
    for i in np.flatnonzero(counts):
        own = int(counts[i])
        if rest < NUMPY_MOST:
            x = int(rng.hypergeometric(own, rest - own, left)) if left else 0
        else:
            x = draw_without_return(own, rest - own, left, rng)
        out[i] = x
        left, rest = left - x, rest - own
    return out


def shard_counts(
    counts: np.ndarray, shards: int, shard: int, size: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it.

    The counts of all shards are multinomial draws on the condition that they add up to
    ``counts``. Halving the shards again and again lets every task find its own draw.
    """
    lo, hi, before = 0, shards, np.zeros_like(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = split_counts(counts, (mid - lo) * size, rng)
        if shard < mid:
            counts, hi = left, mid
        else:
            before, counts, lo = before + left, counts - left, mid
    return counts, before


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1: a Feistel network that walks back into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, mask = np.uint64(half), np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    out = np.empty(len(index), np.int64)
    rounds = np.random.default_rng([key, size]).integers(1, 2**63, 4, dtype=np.uint64)
    while len(todo):
        a, b = x >> low, x & mask
        for r in rounds:
            f = (b + r) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (f >> np.uint64(33))) & mask
        x = (a << low) | b
        good = x < size
        out[todo[good]] = x[good].astype(np.int64)
        x, todo = x[~good], todo[~good]
    return out


def mix_slots(
    spark: SparkSession, sources: Sequence[Source], shard_slots: int = 4096, seed: int = 7
) -> DataFrame:
    """The mix: rows (shard, slot, source_key, block), ``shard_slots`` slots to a shard.

    Slot k of a source takes block pi(k mod blocks) of its k // blocks-th permutation, so
    a block comes again only when all blocks of its source have come as often.
    """
    counts = np.array([s.slots for s in sources] or [0], np.int64)
    blocks = [s.blocks for s in sources]
    shards = -(-int(counts.sum()) // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                own, before = shard_counts(counts, shards, int(shard), shard_slots, seed)
                keys = np.repeat(np.arange(len(own)), own)
                index = np.empty(len(keys), np.int64)
                at = np.concatenate([[0], np.cumsum(own)])
                for s in np.flatnonzero(own):
                    rank = before[s] + np.arange(own[s])
                    for epoch in range(rank[0] // blocks[s], rank[-1] // blocks[s] + 1):
                        here = np.flatnonzero(rank // blocks[s] == epoch)
                        index[at[s] + here] = permute(
                            rank[here] % blocks[s], blocks[s], (seed << 40) + (int(s) << 8) + epoch
                        )
                order = np.random.default_rng([seed, 1, int(shard)]).permutation(len(keys))
                yield pd.DataFrame(
                    {
                        "shard": shard,
                        "slot": np.arange(len(keys)),
                        "source_key": keys[order],
                        "block": index[order],
                    }
                )

    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInPandas(
        draw, "shard long, slot long, source_key int, block long"
    )


def place_documents(sized: DataFrame, spread: int = 512, seed: int = 7) -> DataFrame:
    """Adds ``offset``, where a document starts in the word stream of its source.

    A stream is in pseudorandom order. Rows of a source are dealt to buckets of about
    ``spread`` documents; totals of the buckets are summed apart, so a hot source is
    ordered by many tasks and only its bucket totals meet in one.
    """
    buckets = F.greatest(F.ceil(F.col("source_docs") / spread), F.lit(1))
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), buckets))
    key = ["source_key", "bucket"]
    totals = dealt.groupBy(*key).agg(F.sum("size").alias("total"))
    before = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*key, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = (
        W.partitionBy(*key)
        .orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, key)
        .withColumn("offset", F.col("start") + F.col("within"))
        .drop("bucket", "start", "within")
    )


def document_blocks(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in, with the number of its words."""
    last = F.col("offset") + F.col("size") - 1
    at = F.sequence(F.floor(F.col("offset") / block), F.floor(last / block))
    start = F.col("block") * block
    return (
        placed.where("size > 0")
        .withColumn("block", F.explode(at))
        .withColumn(
            "words",
            F.least(F.col("offset") + F.col("size"), start + block)
            - F.greatest(F.col("offset"), start),
        )
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    block: int = 128,
    most: float = 3.0,
    shard_slots: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """Words that a mix by source weight takes of every document.

    Sources in code point order, null last, have ``weights`` in turn and share the size of
    the whole table; none gives more than ``most`` times its words. Columns used: doc_id,
    text, source. Returns one row per row of ``docs``: doc_id, size, source, source_size,
    target, taken.

    Null text and empty text have size 0 and are never taken. Null ids are ids like any
    other. Rows that repeat an id are counted one by one; which of two equal rows comes
    first has no effect on the result. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = materialise(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes"
    )
    sources = plan_sources(sized, weights, block, most)
    names = "name string, source_key int, source_docs long, source_size long, target double"
    rows = [(s.name, s.key, s.docs, s.size, s.target) for s in sources]
    table = spark.createDataFrame(rows, names)  # bounded: one row per source
    keyed = sized.join(
        F.broadcast(table), sized["source"].eqNullSafe(table["name"])
    ).drop("name")
    placed = materialise(place_documents(keyed, seed=seed), "placed")
    times = (
        mix_slots(spark, sources, shard_slots, seed)
        .groupBy("source_key", "block")
        .agg(F.count("*").alias("times"))
    )
    document = ["source_key", "offset", "doc_id", "size", "source", "source_size", "target"]
    taken = (
        document_blocks(placed, block)
        .join(times.hint("merge"), ["source_key", "block"], "left")  # both sides grow
        .groupBy(*document)
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    empty = placed.where("size = 0").select(*document, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).select(
        "doc_id", "size", "source", "source_size", "target", "taken"
    )
