"""How far the word use of the sources of a language differs, by row accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pmtspark.llm.terms import count_terms, fold_table
from pmtspark.llm.text import text_slices
from pmtspark.sources import materialise

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Postings of a block of terms, and pairs of postings that its rows visit, on average.
BLOCK_POSTINGS = 1_000_000
BLOCK_VISITS = 200_000_000
#: Rows of a block that a row group's batch of sums holds.
OUT_ROWS = 200_000

_LETTERS = fold_table(digits=False)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, documents with it.

    The empty term stands for the group itself. Counts are combined per slice of texts
    before the shuffle, so a group with very many rows is no large one there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(
                zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            )
            for s in text_slices(batch.column("text")):
                groups = {g: i for i, g in enumerate(dict.fromkeys(names[s.first : s.first + s.rows]))}
                own = np.array([groups[g] for g in names[s.first : s.first + s.rows]])
                c = count_terms(s, _LETTERS)
                width = max(1, len(c.terms))
                key, place = np.unique(own[c.row] * width + c.code, return_inverse=True)
                n = np.bincount(place, weights=c.count, minlength=len(key)).astype(np.int64)
                held = np.bincount(place, minlength=len(key))
                at = np.concatenate([key // width, np.arange(len(groups))])
                langs, sources = zip(*groups, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(langs, pa.string()).take(pa.array(at)),
                        pa.array(sources, pa.string()).take(pa.array(at)),
                        pa.concat_arrays(
                            [c.terms.take(pa.array(key % width)), pa.array([""] * len(groups))]
                        ),
                        pa.array(np.append(n, np.zeros(len(groups), np.int64))),
                        pa.array(np.append(held, np.bincount(own, minlength=len(groups)))),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*named, "text").mapInArrow(
        count, "lang string, source string, term string, n long, docs long"
    )
    return rows.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def smoothed(n: Column, total: Column, terms: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * terms)), exact; 0 without terms."""
    top = (n + smoothing).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    low = (total + smoothing * terms).cast("decimal(20,0)")
    # the quotient is a decimal rounded at its last digit: take the remainder off first
    return F.when(terms > 0, ((top - top % low) / low).cast("long") + 1).otherwise(
        F.lit(0).cast("long")
    )


def row_sums(
    source: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """For each row ``g``: what it adds to its pair with each peer ``h``, over these terms.

    ``source`` and ``term`` are positions of the postings, ``p`` their values and ``base`` the
    value that each source has for a term that it lacks. A row adds its own terms against the
    peer's base, and for later peers also what both have: each of the row's terms is looked up
    in the term-major index and scattered into one dense accumulator, which corrects what was
    taken with the bases there. So the sum of both rows' shares of a pair is the distance.
    """
    terms = int(term.max()) + 1 if len(term) else 0
    by_term = np.lexsort((source, term))
    peer, there = source[by_term], p[by_term]
    first = np.searchsorted(term[by_term], np.arange(terms + 1))
    by_row = np.lexsort((term, source))
    start = np.searchsorted(source[by_row], np.arange(len(base) + 1))
    held = np.diff(start)
    for g in range(len(base)):
        mine = by_row[start[g] : start[g + 1]]
        own, t = p[mine], term[mine]
        # own terms against every peer's base, by prefix sums over the sorted values
        rising = np.sort(own)
        upto = np.concatenate([[0], np.cumsum(rising)])
        k = np.searchsorted(rising, base)
        out = base * k - upto[k] + (upto[-1] - upto[k]) - base * (len(own) - k)
        n = first[t + 1] - first[t]
        at = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        h, there_h, own_h = peer[at], there[at], np.repeat(own, n)
        fix = (
            np.abs(own_h - there_h)
            - np.abs(own_h - base[h])
            - np.abs(base[g] - there_h)
            + np.abs(base[g] - base[h])
        )
        # whole numbers far below 2**53, so sums of doubles are exact
        both = np.bincount(h, weights=fix, minlength=len(base)).astype(np.int64)
        both += (terms - held[g] - held) * np.abs(base[g] - base)
        out[g + 1 :] += both[g + 1 :]
        yield g, out


def pair_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language, a before b.

    ``postings``: lang, source, term, p, block. ``groups``: lang, source, base, blocks. The
    terms of a language are dealt to blocks by hash, and a task holds a block's term-major
    index and one accumulator. Blocks give sums per pair of sources, never per posting.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        lang = table.column("lang")[0].as_py()
        of_group = table.column("term").is_null()
        bases, rows = table.filter(of_group), table.filter(pc.invert(of_group))
        names = bases.column("source").combine_chunks()
        base = bases.column("p").to_numpy()
        source = pc.index_in(rows.column("source"), names).to_numpy().astype(np.int64)
        term = rows.column("term").combine_chunks().dictionary_encode().indices
        term = term.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, OUT_ROWS // max(1, len(base)))
        held: list[tuple[int, np.ndarray]] = []

        def batch():
            g = np.repeat([x for x, _ in held], len(base))
            h = np.tile(np.arange(len(base)), len(held))
            value = np.concatenate([v for _, v in held])
            other = np.flatnonzero(g != h)
            g, h, value = g[other], h[other], value[other]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(len(g), np.int64))),
                    names.take(pa.array(np.minimum(g, h))),
                    names.take(pa.array(np.maximum(g, h))),
                    pa.array(value, pa.int64()),
                ],
                ["lang", "a", "b", "value"],
            )

        for pair in row_sums(source, term, rows.column("p").to_numpy(), base):
            held.append(pair)
            if len(held) >= size:
                yield batch()
                held = []
        if held:
            yield batch()

    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    bases = groups.select(
        "lang", block, "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p")
    )
    rows = postings.select("lang", "block", "source", "term", "p").unionByName(bases)
    return (
        rows.groupBy("lang", "block")
        .applyInArrow(scatter, "lang string, a string, b string, value long")
        .groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.sum("value").alias("value"))
    )


def audit_sources(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """Distances between the sources of a language and the terms that mark each source.

    Rows: lang, source, part, item, value, rank. Part ``pair``: item is another source of the
    language, value the sum over the language's kept terms of the difference of both sources'
    smoothed shares, in 10^-9. Part ``term``: item is a kept term that the source uses more
    than the language does, value the excess; the ``top_terms`` first. A language keeps terms
    in at least ``least_documents`` of its documents. Ranks go down by value, then up by item.

    Columns used: text, lang, source; nulls count as ''. Empty texts and groups without terms
    take part in pairs. Repeated rows are documents of their own. Texts are held one slice at a
    time, so memory follows the longest. An empty table gives an empty result.
    """
    counts = materialise(term_counts(docs), "term-counts")
    kept = materialise(
        counts.where("term <> ''")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("held"))
        .where(F.col("docs") >= least_documents)
        .select("lang", "term", "lang_n", "held"),
        "kept-terms",
    )
    langs = kept.groupBy("lang").agg(
        F.count("*").alias("terms"),
        F.sum("lang_n").alias("lang_total"),
        F.greatest(
            F.ceil(F.sum("held") / BLOCK_POSTINGS),
            F.ceil(F.sum(F.col("held").cast("double") * F.col("held")) / BLOCK_VISITS),
        ).alias("blocks"),
    )
    own = materialise(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = {"total": 0, "terms": 0, "lang_total": 0, "blocks": 1}
    groups = (
        counts.where("term = ''")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(zero)
        .withColumn("base", smoothed(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    )
    groups = materialise(groups, "groups")
    postings = own.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        F.pmod(F.xxhash64("term"), "blocks").alias("block"),
    )
    pairs = pair_distances(postings, groups).select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
            )
        ),
        "value",
    )
    terms = postings.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    rank = F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    )

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")
        )

    return ranked(pairs, "pair").unionByName(
        ranked(terms, "term").where(F.col("rank") <= top_terms)
    )
