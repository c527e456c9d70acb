"""N-gram Jaccard join: MinHash banding, then exact checks on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.llm.components import components
from pmtspark.llm.text import mix64, shingle_hashes, text_slices, words
from pmtspark.sources import materialise

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK_SHINGLES = 1_000_000
OUT_ROWS = 2000


def choose_bands(similarity: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: most rows for which sets of ``similarity`` still share a band.

    They do so with probability 1 - (1 - similarity ** rows) ** bands, at least ``recall``.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        p = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def shingle_sets(batch_text: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted set of the shingle hashes of each text."""
    for s in text_slices(batch_text):
        hashes, bounds = shingle_hashes(words(s), n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets only, but for chance."""
    with np.errstate(over="ignore"):
        a = int(mix64(shingles).sum(dtype=np.uint64))
        b = int(mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))
    return (a ^ len(shingles)).to_bytes(8, "big") + b.to_bytes(8, "big")


def signatures(numbered: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (unique), digest and size of the shingle set, and band hashes."""
    rng = np.random.default_rng(2_718)
    times = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, keys = [], [], []
            for own in shingle_sets(batch.column("text"), n):
                digest.append(set_digest(own))
                size.append(len(own))
                if not len(own):
                    keys.append(np.zeros(0, np.int64))
                    continue
                low = np.empty(bands * rows, np.uint64)
                for k in range(bands * rows):
                    low[k] = (own * times[k] + plus[k]).min()
                low = mix64(low).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
                keys.append(key.view(np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(digest, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ],
                ["doc_id", "row", "digest", "size", "bands"],
            )

    kind = dict(numbered.dtypes)["doc_id"]
    return numbered.select("doc_id", "row", "text").mapInArrow(
        sign, f"doc_id {kind}, row long, digest binary, size long, bands array<bigint>"
    )


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, label): sets joined by chains of shared bands; others are left out.

    A band's members are hung on the least of them, which is found by a partial minimum, so
    a band with very many members is never one group.
    """
    banded = sets.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    shared = least.where("n > 1").select("band", "first")
    stars = banded.join(shared.hint("merge"), "band").where("node <> first")
    return components(stars.select("node", "first").distinct())


def block_places(grouped: DataFrame, block: int) -> DataFrame:
    """Deal the sets of every group to blocks; a large group is split into pairs of parts.

    Adds ``block`` (group, part, part) and ``side``: 0 in both parts' own block, else 1 or 2.
    """
    sums = grouped.groupBy("label").agg(F.sum("size").alias("all"), F.count("*").alias("members"))
    parts = F.greatest(F.ceil(F.col("all") / block), F.lit(1)).cast("int")
    dealt = grouped.join(sums, "label").select(
        "*", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.select("*", other.alias("other")).select(
        "node",
        "copies",
        F.col("label").alias("group"),
        F.least("part", "other").alias("left"),
        F.greatest("part", "other").alias("right"),
        F.when(F.col("part") == F.col("other"), 0)
        .when(F.col("part") < F.col("other"), 1)
        .otherwise(2)
        .alias("side"),
    )


def linked_pairs(
    sets: list[np.ndarray], side: np.ndarray, similarity: float
) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of side 0 or 1, the later ones that are similar to it.

    Shared shingles are counted through lists of the sets that hold each shingle; shingles
    of one set only are left out of the lists.
    """
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    value, held = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    length = np.diff(np.append(start, len(value)))
    run = np.repeat(np.arange(len(start)), length)
    common = length[run] > 1
    run_of = np.empty(len(flat), np.int64)
    run_of[order] = np.where(common, run, -1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets)):
        if side[i] == 2:
            continue
        runs = run_of[first[i] : first[i + 1]]
        runs = runs[runs >= 0]
        if not len(runs):
            continue
        n = length[runs]
        at = np.repeat(start[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(held[at], minlength=len(sets))
        # in whole numbers: shared / (a + b - shared) >= similarity
        enough = shared * 1000 >= round(similarity * 1000) * (sizes[i] + sizes - shared)
        enough &= (np.arange(len(sets)) > i) if side[i] == 0 else side == 2
        found = np.flatnonzero(enough)
        if len(found):
            yield i, found


def verify_blocks(docs: DataFrame, places: DataFrame, n: int, similarity: float) -> DataFrame:
    """Compare the whole sets inside every block: (node, links, joined).

    ``links`` counts documents in similar sets; ``joined`` is another node of the class or
    null. The text of a candidate is shuffled once to find its set, the sets once more to
    their blocks; pairs of sets are never rows.
    """
    schema = "group long, left int, right int, side int, node long, copies long, shingles binary"
    wanted = places.groupBy("node", "copies").agg(
        F.collect_list(F.struct("group", "left", "right", "side")).alias("blocks")
    )

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [own.tobytes() for own in shingle_sets(batch.column("text"), n)]
            rest = batch.select(["node", "copies", "blocks"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(out, pa.binary())],
                ["node", "copies", "blocks", "shingles"],
            )

    # a node is a row of the written table, so repeated ids meet no others
    text = docs.select(F.col("row").alias("node"), "text")
    joined = text.join(wanted.hint("merge"), "node")
    kind = "array<struct<group:bigint,left:int,right:int,side:int>>"
    hashed = joined.select("node", "copies", "blocks", "text").mapInArrow(
        hash_sets, f"node long, copies long, blocks {kind}, shingles binary"
    )
    placed = hashed.select("node", "copies", "shingles", F.inline("blocks")).select(
        *[x.split()[0] for x in schema.split(", ")]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []

        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["node", "links", "joined"]
            )

        def close():
            nodes = np.array(list(held), np.int64)
            side = np.array([x[0] for x in held.values()])
            copies = np.array([x[1] for x in held.values()])
            sets = [np.frombuffer(x[2], np.uint64) for x in held.values()]
            links = np.zeros(len(nodes), np.int64)
            root = np.arange(len(nodes))
            for i, found in linked_pairs(sets, side, similarity) if len(nodes) > 1 else ():
                links[i] += copies[found].sum()
                links[found] += copies[i]
                old = np.unique(np.append(root[found], root[i]))
                if len(old) > 1:
                    root[np.isin(root, old)] = old[0]
            for k in np.flatnonzero(links):
                out.append((int(nodes[k]), int(links[k]), int(nodes[root[k]])))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for group, left, right, side, node, copies, shingles in zip(*columns, strict=True):
                if key != (group, left, right):
                    if held:
                        close()
                    key, held = (group, left, right), {}
                    if len(out) >= OUT_ROWS:
                        yield batch_of(out)
                        out = []
                held[node] = (side, copies, shingles)
        if held:
            close()
        yield batch_of(out)

    by = ["group", "left", "right"]
    return (
        placed.repartition(*by)
        .sortWithinPartitions(*by, "node")
        .mapInArrow(compare, "node long, links long, joined long")
    )


def near_nodes(
    numbered: DataFrame, n: int, similarity: float, recall: float, block: int
) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows (doc_id, row, text), and a node for each set that occurs.

    A node has the least row of its set, the links of each of its documents, and as label
    the least node of its class.
    """
    bands, rows = choose_bands(similarity, recall)
    signed = materialise(signatures(numbered, n, bands, rows), "signatures")
    full = signed.where("size > 0")
    sets = materialise(
        full.groupBy("digest").agg(
            F.min("row").alias("node"),
            F.count("*").alias("copies"),
            F.min("doc_id").alias("doc_id"),
        ),
        "sets",
    )
    banded = full.join(sets.select(F.col("node").alias("row")), "row")
    groups = candidate_groups(banded.select(F.col("row").alias("node"), "bands"))
    sized = full.select(F.col("row").alias("node"), "size")
    grouped = sets.join(groups, "node").join(sized, "node")
    found = materialise(
        verify_blocks(numbered, block_places(grouped, block), n, similarity), "links"
    )
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select("node", "joined"))
    nodes = (
        sets.join(counted, "node", "left")
        .join(classes, "node", "left")
        .select(
            "digest",
            "node",
            "doc_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("label", "node").alias("label"),
        )
    )
    return signed, materialise(nodes, "nodes")


def near_duplicates(
    docs: DataFrame,
    n: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Class and number of links of every document: doc_id, class_id, links, keep.

    Two documents are linked if the Jaccard similarity of their sets of ``n``-word shingles
    is ``similarity`` or more; a class is what links join. ``links`` counts all linked
    documents, copies too. ``class_id`` is the least doc_id of the class and ``keep`` marks
    one row of each. Columns used: doc_id, text.

    Texts of fewer words than ``n`` have one shingle. Null, empty and blank texts have none:
    they are linked to nothing and each is a class of its own. Documents of equal sets are
    one node, so copies cost one comparison. Rows that repeat an id are documents of their
    own; null ids are allowed, and such a class has a null id only if all its ids are null.
    An empty table gives an empty result.
    """
    numbered = materialise(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "rows"
    )
    signed, nodes = near_nodes(numbered, n, similarity, recall, block)
    least = nodes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    labelled = nodes.join(least, "label").select("digest", "label", "class_id", "links")
    alone = signed.where("size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"),
        F.lit(True).alias("keep"),
    )
    return (
        signed.where("size > 0")
        .select("doc_id", "row", "digest")
        .join(labelled.hint("merge"), "digest")
        .select("doc_id", "class_id", "links", (F.col("row") == F.col("label")).alias("keep"))
        .unionByName(alone)
    )


def keep_one(
    docs: DataFrame,
    n: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One document of each class of ``near_duplicates``, with all its columns.

    Documents are written once with row numbers, so that repeated ids are told apart.
    Those without words all stay.
    """
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    held = materialise(docs.select(document, F.monotonically_increasing_id().alias("row")), "rows")
    numbered = held.select("document.doc_id", "row", "document.text")
    signed, nodes = near_nodes(numbered, n, similarity, recall, block)
    stay = nodes.where("node = label").select(F.col("node").alias("row")).unionByName(
        signed.where("size = 0").select("row")
    )
    return held.join(stay.hint("merge"), "row", "left_semi").select("document.*")
