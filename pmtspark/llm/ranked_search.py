"""Ranked lexical search: impact-sorted lists read in step, with score intervals (NRA)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pmtspark.llm.terms import count_terms, fold_table, gathered
from pmtspark.llm.text import text_slices
from pmtspark.sources import materialise

TOP = 10
#: Text bytes of a shard; one longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Terms of the items that are searched for together, and so sent to every task.
BLOCK_TERMS = 200_000
FIRST_DEPTH = 64
#: Of a term's impact, (IMPACT * tf) div (1000 * tf + 8 * m), m = FLOOR + (SLOPE * n * N) div L.
IMPACT, SLOPE = 1_000_000_000, 90
FLOOR = 100 - SLOPE

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDY = fold_table(digits=True)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Inverted lists of shards of documents: (shard, term, df, at, tf, ids).

    A row per term of a shard: positions of the documents that hold it, and how often. The
    empty term has the shard's documents: ``ids`` in order, nulls last, and in ``tf`` their
    number of terms. So a lower position is a lower id.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, shard_bytes, "text"):
            all_ids = batch.column("doc_id")
            for s in text_slices(batch.column("text"), shard_bytes):
                c = count_terms(s, _WORDY)
                ids = all_ids.slice(s.first, s.rows)
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                place = np.empty(s.rows, np.int64)
                place[order] = np.arange(s.rows)
                by_term = np.lexsort((place[c.row], c.code))
                df = np.bincount(c.code, minlength=len(c.terms))
                bounds = pa.array(np.concatenate([[0, 0], np.cumsum(df)]), pa.int32())
                lens = c.total[order]
                shift = pa.array(
                    np.concatenate([[0], len(lens) + np.append(0, np.cumsum(df))]), pa.int32()
                )
                tf = np.concatenate([lens, c.count[by_term]])
                own = [ids.take(pa.array(order))] + [None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(1 + len(df), (task << 32) + n)),
                        pa.concat_arrays([pa.array([""]), c.terms]),
                        pa.array(np.append(0, df)),
                        pa.ListArray.from_arrays(
                            bounds, pa.array(place[c.row][by_term], pa.int32())
                        ),
                        pa.ListArray.from_arrays(shift, pa.array(tf, pa.int32())),
                        pa.concat_arrays(
                            [
                                pa.ListArray.from_arrays(pa.array([0, s.rows], pa.int32()), own[0]),
                                pa.nulls(len(df), pa.list_(ids.type)),
                            ]
                        ),
                    ],
                    ["shard", "term", "df", "at", "tf", "ids"],
                )
                n += 1

    return docs.select("doc_id", "text").mapInArrow(
        index,
        f"shard long, term string, df long, at array<int>, tf array<int>, ids array<{kind}>",
    )


def nra(lists: Sequence[tuple[np.ndarray, np.ndarray]], size: int, top: int) -> list[tuple[int, int]]:
    """The ``top`` documents by summed gains, (position, sum), equal sums by position.

    ``lists``: positions and gains above 0, by falling gain; positions are below ``size``. All
    lists are read in step to a depth that doubles. A document's sum is at least the gains
    read, and at most those plus the next gain of each list in which it was not met. Documents
    whose upper bound is below the ``top``-th lower bound are given up and skipped from then
    on; reading goes on until every one that is left, ties included, has equal bounds.
    """
    lower = np.zeros(size, np.int64)
    alive: np.ndarray | None = None
    read, depth = 0, FIRST_DEPTH
    while True:
        ahead = np.zeros(len(lists), np.int64)
        for i, (docs, gains) in enumerate(lists):
            here, gain = docs[read:depth], gains[read:depth]
            if alive is not None:
                mine = alive[here]
                here, gain = here[mine], gain[mine]
            lower[here] += gain
            ahead[i] = gains[depth] if depth < len(gains) else 0
        rest = int(ahead.sum())
        least = 0
        if size > top:
            least = int(np.partition(lower, size - top)[size - top])
        if rest == 0:
            break
        if least > rest:  # no document that was not met can still enter or tie
            met = np.zeros(size, np.int64)
            for i, (docs, _) in enumerate(lists):
                if ahead[i]:
                    met[docs[:depth]] += ahead[i]
            open_ = rest - met
            alive = lower + open_ >= least
            if not open_[alive].any():
                break
        read, depth = depth, depth * 2
    found = np.flatnonzero(lower >= max(least, 1))
    if alive is not None:
        found = found[alive[found]]
    found = found[np.lexsort((found, -lower[found]))][:top]
    return [(int(d), int(lower[d])) for d in found]


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (1000 * tf + 8 * m)


def search_block(
    index: DataFrame,
    queries: dict[int, list[tuple[str, int]]],
    documents: int,
    terms: int,
    kind: str,
    top: int,
) -> DataFrame:
    """(item, doc_id, score): the first ``top`` of every shard, for each of some items.

    ``queries``: terms and weights by item; ``documents`` and ``terms`` count the whole corpus.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, ids, m = {}, None, None
        pending = []
        for batch in batches:
            for i, term in enumerate(batch.column("term").to_pylist()):
                tf = np.asarray(batch.column("tf")[i].values, np.int64)
                if term == "":
                    ids = batch.column("ids")[i].values
                    # in whole numbers of any size: SLOPE * n * N may pass 64 bits
                    m = np.array(
                        [FLOOR + SLOPE * n * documents // max(1, terms) for n in tf.tolist()], np.int64
                    )
                else:
                    pending.append((term, np.asarray(batch.column("at")[i].values), tf))
        for term, at, tf in pending:
            impact = _impacts(tf, m[at])
            order = np.argsort(-impact, kind="stable")
            order = order[: np.count_nonzero(impact)]
            lists[term] = at[order], impact[order]
        items, places, scores = [], [], []
        for item, wanted in queries.items():
            own = [(lists[t][0], lists[t][1] * w) for t, w in wanted if w > 0 and t in lists]
            for place, score in nra(own, len(m), top) if own else ():
                items.append(item)
                places.append(place)
                scores.append(score)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.int64()),
                ids.take(pa.array(places, pa.int64())),
                pa.array(scores, pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    schema = f"item long, doc_id {kind}, score long"
    return index.groupBy("shard").applyInArrow(search, schema)


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    A document's score is the sum, over the item's distinct terms that it holds, of the term's
    weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))) times its impact there; only scores
    above 0 count. Equal scores rank by ascending doc_id, null last. Columns used: doc_id,
    text; item_id, text.

    The inverted lists of all documents are written once, in shards of bounded text. Items are
    taken in blocks of bounded size, which is what tasks are sent; each shard sorts its lists
    by impact and answers every item by NRA, and the shards' best are merged by rank. Null and
    empty texts have no terms: such documents are never found, such items have no rows. Items
    that repeat id and text are one; texts that share an id rank apart under it. Documents that
    repeat an id rank apart. A very long text is a shard of its own, whole. Empty tables give
    an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    index = materialise(build_index(docs, shard_bytes), "inverted-index")
    counted = index.where("term = ''").select(
        F.expr("aggregate(tf, 0L, (a, n) -> a + n)").alias("terms"),
        F.expr("cast(size(filter(tf, n -> n > 0)) as long)").alias("docs"),
    )
    totals = counted.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"),
    ).first()
    own = materialise(
        items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = own.select("item", F.explode(F.array_distinct(found)).alias("term"))
    held = index.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.log((2 * totals.docs + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    weighted = materialise(
        asked.join(held, "term").select("item", "term", weight.alias("weight")), "item-terms"
    )
    blocks = max(1, -(-weighted.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    best = None
    for b in range(blocks):
        queries: dict[int, list[tuple[str, int]]] = {}
        for row in weighted.where(block == b).collect():
            queries.setdefault(row.item, []).append((row.term, row.weight))
        wanted = weighted.where(block == b).select("term").distinct()
        empty = wanted.sparkSession.createDataFrame([("",)], "term string")
        lists = index.join(wanted.unionByName(empty), "term", "left_semi")
        part = search_block(lists, queries, totals.docs, totals.terms, kind, top)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(own.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score"
    )
