"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pmtspark.llm.text import SPACES, split_words
from pmtspark.sources import materialise

SYMBOLS = "#*$%&|<>"
EXACT = "decimal(38,0)"  # whole numbers of scaled counts


@dataclass(frozen=True)
class Rule:
    """A whole-number measure and its fence.

    The upper bound lies beyond the quantile of ``percent`` by ``reach`` times that quantile's
    distance from the median; with ``below``, a lower bound mirrors it.
    """

    name: str
    percent: int
    reach: int
    below: bool = False


RULES = (
    Rule("symbol_rate", percent=85, reach=1),
    Rule("dup_line_rate", percent=99, reach=1),
    Rule("repeat_rate", percent=99, reach=1),
    Rule("word_length", percent=85, reach=4, below=True),
)


def covered_words(pairs: Column) -> Column:
    """Words inside a window that occurs twice; ``pairs`` are sorted (window hash, position)."""
    same = F.filter(
        pairs,
        lambda x, i: F.coalesce(x["g"] == F.get(pairs, i - 1)["g"], F.lit(False))
        | F.coalesce(x["g"] == F.get(pairs, i + 1)["g"], F.lit(False)),
    )
    inside = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(inside))


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Counts of each text: doc_id, lang, source and the columns of the contract.

    With ``carry``, the whole row goes along as the struct ``document``.
    """
    text = F.coalesce("text", F.lit(""))
    along = ["document"] if carry else []
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] * carry
    split = docs.select("doc_id", "lang", "source", *whole, text.alias("text")).withColumns(
        {
            "words": split_words(F.col("text")),
            "lines": F.filter(
                F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0
            ),
        }
    )
    w, n = F.col("words"), F.size("words")
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        *along,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("grams"),
    )
    g = F.col("grams")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    paired = counted.withColumn(
        "pairs",
        F.when(
            repeats, F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        ),
    )
    return paired.select(
        "doc_id",
        "lang",
        "source",
        *along,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.when(F.col("pairs").isNull(), 0)
        .otherwise(covered_words(F.col("pairs")))
        .cast("long")
        .alias("n_repeat_words"),
    )


def rates(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and the whole-number measures of RULES; 0 where there are no words."""

    def rate(times: int, part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{times} * {part} div {whole}")).otherwise(
            F.lit(0).cast("long")
        )

    return measured.withColumns(
        {
            "base_failed": (F.col("n_words") < 50)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_rate": rate(1000, "n_symbols", "word_chars"),
            "dup_line_rate": rate(1000, "n_dup_lines", "n_lines"),
            "repeat_rate": rate(1000, "n_repeat_words", "n_words"),
            "word_length": rate(10, "word_chars", "n_words"),
        }
    )


def cell_of(value: Column) -> Column:
    """Cell of a value: itself below 10,000, beyond that its four leading digits."""
    width = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 4, F.lit(0))).cast("long")
    return value - value % width


def sketch(rated: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Quantile sketch of every (lang, source, rule): counts of cells over the texts that pass
    the base rules.

    Sketches merge by adding the counts of equal cells, so each task makes its own and
    only cells are shuffled. A quantile is exact below 10,000 and within a thousandth beyond.
    """
    cells = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), cell_of(F.col(r.name)).alias("cell")) for r in rules]
    )
    return (
        rated.where(~F.col("base_failed"))
        .select("lang", "source", F.inline(cells))
        .groupBy("lang", "source", "rule", "cell")
        .agg(F.count("*").cast(EXACT).alias("n"))
    )


def merge_sketches(cells: DataFrame, *group: str) -> DataFrame:
    return cells.groupBy(*group, "rule", "cell").agg(F.sum("n").cast(EXACT).alias("n"))


def shrink(cells: DataFrame, wider: DataFrame, group: list[str], shared: list[str], prior: int):
    """Sketches of ``group`` with ``prior`` rows added that are spread as in ``wider``.

    Counts are scaled to whole numbers: n * wider rows + prior * wider n. A group's weight in
    its own sketch so grows with its rows, without a step.
    """
    rule = W.partitionBy(*shared, "rule")
    totalled = wider.withColumn("rows", F.sum("n").over(rule).cast(EXACT))
    totals = totalled.select(
        *[F.col(c).alias(f"t_{c}") for c in shared], F.col("rule").alias("t_rule"), "rows"
    ).distinct()
    groups = cells.select(*[F.col(c).alias(f"g_{c}") for c in [*group, "rule"]]).distinct()

    def same(left: str, right: str) -> Column:
        on = F.col(f"{left}rule") == F.col(f"{right}rule")
        for c in shared:
            on &= F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
        return on

    own = cells.join(totals, same("", "t_")).select(
        *group, "rule", "cell", (F.col("n") * F.col("rows")).cast(EXACT).alias("n")
    )
    spread = wider.withColumnsRenamed({c: f"w_{c}" for c in [*shared, "rule"]})
    added = groups.join(spread, same("g_", "w_")).select(
        *[F.col(f"g_{c}").alias(c) for c in [*group, "rule"]],
        "cell",
        (F.col("n") * F.lit(prior)).cast(EXACT).alias("n"),
    )
    return merge_sketches(own.unionByName(added), *group)


def quantiles(cells: DataFrame, group: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Median, and each rule's lower and upper quantile, of each (group, rule)."""
    by = W.partitionBy(*group, "rule")
    run = by.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    percent = F.coalesce(*[F.when(F.col("rule") == r.name, r.percent) for r in rules])
    summed = cells.withColumns(
        {
            "upto": (F.sum("n").over(run) * 100).cast(EXACT),
            "rows": F.sum("n").over(by).cast(EXACT),
            "percent": percent,
        }
    )

    def at(p: Column) -> Column:
        return F.min(F.when(F.col("upto") >= (F.col("rows") * p).cast(EXACT), F.col("cell")))

    return summed.groupBy(*group, "rule").agg(
        at(F.lit(50)).alias("mid"),
        at(100 - F.col("percent")).alias("low"),
        at(F.col("percent")).alias("high"),
    )


def thresholds(cells: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = 200) -> DataFrame:
    """Bounds of every (lang, source): columns <rule>_min and <rule>_max.

    A language's sketch gains ``prior`` rows spread as in the table, and a group's sketch
    gains ``prior`` rows spread as in that of its language.
    """
    every = merge_sketches(cells)
    lang = shrink(merge_sketches(cells, "lang"), every, ["lang"], [], prior)
    own = shrink(cells, lang, ["lang", "source"], ["lang"], prior)
    q = quantiles(own, ["lang", "source"], rules)
    bounds = []
    for r in rules:
        here = F.col("rule") == r.name
        above = F.col("high") + r.reach * (F.col("high") - F.col("mid"))
        bounds.append(F.max(F.when(here, above)).alias(f"{r.name}_max"))
        if r.below:
            under = F.col("low") - r.reach * (F.col("mid") - F.col("low"))
            bounds.append(F.min(F.when(here, under)).alias(f"{r.name}_min"))
    return q.groupBy("lang", "source").agg(*bounds)


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = 200
) -> DataFrame:
    """Measures and verdict of every document: counts, base_failed, kept.

    ``kept`` is false where ``base_failed`` is true or a measure lies outside the bounds of
    the document's language and source. Columns used: doc_id, text, lang, source. A whole
    text is one value of a task: memory grows with the longest text, not with the group.

    Null and empty texts have zero counts and fail. Null languages and sources are groups of
    their own. Every row has its own result, repeated ids too. An empty table gives none.
    """
    return judge(materialise(rates(measures(docs)), "measures"), rules, prior).select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def keep_documents(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = 200
) -> DataFrame:
    """The documents that ``apply_rules`` keeps, with all their columns.

    Documents are written once beside their measures, so neither is made twice and no text
    is shuffled.
    """
    rated = materialise(rates(measures(docs, carry=True)), "measures")
    return judge(rated, rules, prior).where("kept").select("document.*")


def judge(rated: DataFrame, rules: tuple[Rule, ...], prior: int) -> DataFrame:
    """Adds ``kept`` to documents with their rates."""
    bounds = thresholds(sketch(rated, rules), rules, prior).withColumnsRenamed(
        {"lang": "group_lang", "source": "group_source"}
    )
    joined = rated.join(
        bounds,
        rated["lang"].eqNullSafe(bounds["group_lang"])
        & rated["source"].eqNullSafe(bounds["group_source"]),
        "left",
    )
    fits = F.lit(True)
    for r in rules:
        value = cell_of(F.col(r.name))
        fits &= value <= F.col(f"{r.name}_max")
        if r.below:
            fits &= value >= F.col(f"{r.name}_min")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))
