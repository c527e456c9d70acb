"""Survey modules -> one analysis table with a row per household."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pmtspark.functions import (
    any3,
    bin_left,
    bin_right,
    collapse_levels,
    cross_levels,
    if_known,
    in_set,
    max_or_neg_inf,
    yes_no,
)
from pmtspark.operators.reshape import pivot_any, pivot_values
from pmtspark.sources import drop_range, materialise, pick

# Questionnaire codes and bin limits.
PAST_SCHOOL_HEAD = {
    0: (2, 10, 11, 12, 13, 14, 15, 16),
    1: (17, 31, 32, 33, 41),
    2: (34, 35, 36, 21, 22, 23, 51, 61),
}
PAST_SCHOOL_HEAD_UNKNOWN = 99
NOW_SCHOOL_HEAD = {1: (32,), 2: (34, 50, 61)}
PAST_SCHOOL_MEMBER = {
    0: (2, 10, 11, 12, 13, 14, 15, 16),
    1: (17, 31, 32, 33, 41),
    2: (34, 35, 36, 21, 22, 23, 51, 61),
}
NOW_SCHOOL_MEMBER = {
    0: (1, 10, 11, 12, 13, 14, 15),
    1: (16, 17, 30, 31, 32, 40),
    2: (33, 34, 35, 50, 61),
}
PERSON_EDUCATION_OVERRIDE = {"115300270402": 2}
EXCLUDED_HOUSEHOLDS = ("205300170503",)
FUEL_GROUPS = {"electric_gas": (1, 2), "coal": (6,), "wood": (4, 5)}
STOVE_FUELS = (1, 2, 3, 4, 5, 6, 7)
ASSETS = {
    7: "radio",
    6: "television",
    10: "bicycle",
    11: "motorbike",
    12: "car",
    16: "mobile_phone",
    17: "computer",
    5: "iron",
    8: "generator",
    1: "own_house",
}
HOUSING_CODES = {
    "water_piped": ("h9q7", (1, 2)),
    "water_well": ("h9q7", (4, 5)),
    "toilet_flush": ("h9q22", (6, 7)),
    "toilet_pit": ("h9q22", (1, 2, 3, 4, 5)),
    "roof_natural": ("h9q4", (1, 2)),
    "roof_rudimentary": ("h9q4", (3, 4)),
    "roof_finished": ("h9q4", (5, 6, 7, 8)),
    "wall_natural": ("h9q5", (1, 2)),
    "wall_rudimentary": ("h9q5", (3, 4, 5)),
    "wall_finished": ("h9q5", (6, 7, 8, 24)),
    "floor_natural": ("h9q6", (1, 2)),
    "floor_rudimentary": ("h9q6", (3,)),
    "floor_finished": ("h9q6", (4, 5, 6, 96)),
}
AGE_BREAKS, AGE_LABELS = (0, 5, 14, 64, 110), ("5", "14", "64", "65")
COMPOSITION_CELLS = tuple(f"{sex}_{age}" for sex in "fm" for age in AGE_LABELS)
HHSIZE_BREAKS = (1, 3, 5, 7, 9, float("inf"))
HEAD_AGE_BREAKS = (14, 24, *range(29, 85, 5), 105)


def _level(code: Column, levels: Mapping[int, Sequence[int]]) -> Column:
    out = F.lit(None).cast("double")
    for level, codes in levels.items():
        out = F.when(code.isin(*codes), F.lit(float(level))).otherwise(out)
    return out


def _education_level(past: Mapping, now: Mapping) -> Column:
    """0 below primary, 1 primary, 2 secondary or more, by school attendance."""
    return (
        F.when(F.col("h4q5") == 1, F.lit(0.0))
        .when(F.col("h4q5") == 2, _level(F.col("h4q7"), past))
        .when(F.col("h4q5") == 3, _level(F.col("h4q9"), now))
    )


def head_flags(gsec2: DataFrame) -> DataFrame:
    """Household heads with sex, age and marital status."""
    marital = F.col("h2q10")
    return gsec2.filter(F.col("h2q4") == 1).select(
        "HHID",
        "PID",
        (F.col("h2q3") == 2).alias("head_female"),
        F.col("h2q8").alias("head_age"),
        in_set(marital, (1, 2)).alias("head_married"),
        (marital == 3).alias("head_divorced"),
        (marital == 4).alias("head_widow"),
        (marital != 5).alias("head_married_ever"),
        (marital == 5).alias("head_married_never"),
    )


def head_education(persons: DataFrame) -> DataFrame:
    """Add the head's education flags from h4q5, h4q7 and h4q9."""
    unknown = (F.col("h4q5") == 2) & (F.col("h4q7") == PAST_SCHOOL_HEAD_UNKNOWN)
    level = F.coalesce(
        _education_level(PAST_SCHOOL_HEAD, NOW_SCHOOL_HEAD), F.when(unknown, F.lit(0.0))
    )
    return (
        persons.withColumn("_level", level)
        .withColumn("head_educ_primary", F.col("_level") >= 1)
        .withColumn("head_educ_secondary", F.col("_level") == 2)
        .drop("_level", "h4q5", "h4q7", "h4q9")
    )


def head_work(persons: DataFrame) -> DataFrame:
    """Add the head's work flags from h8q4 ... h8q15."""

    def yes(q: int) -> Column:
        return F.col(f"h8q{q}") == 1

    flagged = (
        persons.withColumn("head_work_salary", yes(5) | yes(11))
        .withColumn("head_work_selfemployed", yes(7) | yes(9))
        .withColumn("head_work_farm", yes(13))
        .withColumn("head_work_daily", F.coalesce(yes(15), F.lit(False)))
    )
    return drop_range(flagged, "h8q4", "h8q15")


def head_block(gsec2: DataFrame, gsec4: DataFrame, gsec8: DataFrame) -> DataFrame:
    """One row per head. A household with two heads keeps two rows."""
    person = ["HHID", "PID"]
    joined = head_flags(gsec2).join(gsec4, person, "left").join(gsec8, person, "left")
    return head_work(head_education(joined)).drop("PID")


def composition(gsec2: DataFrame) -> DataFrame:
    """Household size and the share of members in each sex and age cell.

    Members of unknown sex or age count in the size and in every denominator.
    """
    sex = if_known(F.col("h2q3") == 1, F.lit("m"), F.lit("f"))
    cell = cross_levels(sex, bin_right(F.col("h2q8"), AGE_BREAKS, AGE_LABELS))
    members = gsec2.select("HHID", cell.alias("_cell"))
    return members.groupBy("HHID").agg(
        F.count(F.lit(1)).alias("hhsize"),
        *[
            F.avg(F.when(F.col("_cell") == c, 1.0).otherwise(0.0)).alias(f"shares_{c}")
            for c in COMPOSITION_CELLS
        ],
    )


def education(gsec4: DataFrame) -> DataFrame:
    """Highest education in the household.

    A household of which nothing is known gets FALSE, not NULL, and so survives
    the later removal of incomplete rows.
    """
    level = F.coalesce(
        _education_level(PAST_SCHOOL_MEMBER, NOW_SCHOOL_MEMBER),
        F.when(F.col("h4q5").isNull() & (F.col("h4q9") == 15), F.lit(0.0)),
    )
    for pid, known in PERSON_EDUCATION_OVERRIDE.items():
        is_person = F.coalesce(F.col("PID").cast("string") == pid, F.lit(False))
        level = F.when(is_person, F.lit(float(known))).otherwise(level)
    top = gsec4.groupBy("HHID").agg(max_or_neg_inf(level).alias("_top"))
    return top.select(
        "HHID",
        (F.col("_top") >= 1).alias("hh_educ_primary"),
        (F.col("_top") == 2).alias("hh_educ_secondary"),
    )


def housing(gsec9a: DataFrame) -> DataFrame:
    flags = [in_set(F.col(q), codes).alias(name) for name, (q, codes) in HOUSING_CODES.items()]
    return gsec9a.select("HHID", *flags, F.col("h9q3").alias("rooms"))


def fuel_use(gsec10b: DataFrame) -> DataFrame:
    """Use of each fuel group; FALSE where a household has no row for it."""
    named = gsec10b.withColumn("_fuel", collapse_levels(F.col("h10q8_1"), FUEL_GROUPS))
    names = {f: f"fuel_{f}" for f in ("electric_gas", "wood", "coal")}
    return pivot_any(named, ["HHID"], "_fuel", F.col("h10q8_2") == 1, names)


def _stove() -> Column:
    return in_set(F.col("h10q8_1"), STOVE_FUELS) & (F.col("h10q8_2") == 1)


def stove_any(gsec10b: DataFrame) -> DataFrame:
    return gsec10b.groupBy("HHID").agg(any3(_stove()).alias("stove_any"))


def fuel_and_stove(gsec10b: DataFrame) -> DataFrame:
    """``fuel_use`` and ``stove_any`` from one scan and one shuffle."""
    named = gsec10b.select(
        "HHID",
        collapse_levels(F.col("h10q8_1"), FUEL_GROUPS).alias("_fuel"),
        (F.col("h10q8_2") == 1).alias("_used"),
        _stove().alias("_stove"),
    )

    def fuel_cell(fuel: str) -> Column:
        here = F.coalesce(F.col("_fuel") == fuel, F.lit(False))
        return any3(F.when(here, F.col("_used")).otherwise(F.lit(False)))

    return named.groupBy("HHID").agg(
        *[fuel_cell(f).alias(f"fuel_{f}") for f in ("electric_gas", "wood", "coal")],
        any3(F.col("_stove")).alias("stove_any"),
    )


def power(gsec10a: DataFrame) -> DataFrame:
    return gsec10a.select(
        "HHID",
        (F.col("h10q1") == 1).alias("electricity"),
        (F.col("h10q12") == 1).alias("kitchen_room"),
    )


def assets(gsec14: DataFrame) -> DataFrame:
    """Ownership of the listed assets; a repeated answer takes the lower code."""
    wide = pivot_values(
        gsec14,
        ["HHID"],
        "h14q2",
        ASSETS,
        lambda here: F.min(F.when(here, F.col("h14q3"))),
    )
    return wide.select("HHID", *[yes_no(F.col(a)).alias(a) for a in ASSETS.values()])


#: Rows of a household and block that one piece of a repeated household's join holds.
PIECE_ROWS = 8192


def merge_blocks(
    blocks: Sequence[DataFrame], key: str = "HHID", piece: int = PIECE_ROWS
) -> DataFrame:
    """Full outer merge of all blocks on ``key``, as a chain of full joins gives it.

    Such a chain shuffles the growing table again at every step, because a full join's
    output is not partitioned by its key. Here every block is written once with its own
    columns. Keys that no block repeats are brought together in a single grouping of the
    blocks' rows, in which a block is one structure and not as many mostly empty columns. Keys
    that some block repeats are found by counting and take joins; their rows are dealt to pieces
    of about ``piece`` rows, and every combination of the blocks' pieces is a join key of its
    own, so that a household with very many rows in several blocks is spread over as many
    tasks as its combinations need.

    A NULL key is a household as any other. Columns are the key and then those of the blocks.
    """
    names = [(i, c) for i, df in enumerate(blocks) for c in df.columns if c != key]
    flat = [f"_b{i}_{c}" for i, c in names]
    held = [
        materialise(
            df.select(
                key,
                F.monotonically_increasing_id().alias("_row"),
                *[F.col(c).alias(f"_b{i}_{c}") for c in df.columns if c != key],
            ),
            "block",
        )
        for i, df in enumerate(blocks)
    ]
    own = [[F.col(c) for c in df.columns if c not in (key, "_row")] for df in held]
    packed = [F.struct(*(c or [F.lit(True)])).alias(f"_s{i}") for i, c in enumerate(own)]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.select(key, p) for df, p in zip(held, packed, strict=True)],
    )
    counted = stacked.groupBy(key).agg(*[F.count(f"_s{i}").alias(f"_n{i}") for i in range(len(held))])
    many = reduce(lambda a, b: a | b, [F.col(f"_n{i}") > 1 for i in range(len(held))])
    numbered = counted.filter(many).withColumn("_id", F.monotonically_increasing_id())
    hot = materialise(numbered, "repeated")
    most = hot.agg(*[F.max(f"_n{i}") for i in range(len(held))]).first()
    repeated = [i for i, n in enumerate(most) if n is not None and n > 1]
    # dealt by key before grouping, as rows of different keys do not combine; the few keys with
    # more rows than a piece are kept out of that
    few = stacked
    heavy = reduce(lambda a, b: a | b, [F.col(f"_n{i}") > piece for i in range(len(held))])
    if any(n is not None and n > piece for n in most):
        apart = hot.filter(heavy).select(F.col(key).alias("_key"))
        few = stacked.join(F.broadcast(apart), stacked[key].eqNullSafe(apart["_key"]), "left_anti")
    # of the others, a key's blocks have a row each, so there is one value to take
    grouped = few.repartition(key).groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.first(f"_s{i}", ignorenulls=True).alias(f"_s{i}") for i in range(len(held))],
    )
    present = [F.col(f"_s{i}").isNotNull().cast("int") for i in range(len(held))]
    once = grouped.filter(F.col("_rows") == reduce(lambda a, b: a + b, present)) if repeated else grouped
    merged = once.select(key, *[F.col(f"_s{i}")[f].alias(f) for f, (i, _) in zip(flat, names, strict=True)])
    if repeated:
        merged = merged.unionByName(_repeated_keys(held, hot, repeated, key, flat, piece))
    return merged.select(key, *[F.col(f).alias(c) for f, (_, c) in zip(flat, names, strict=True)])


def _beside(keys: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """``keys`` with the columns of all ``blocks`` joined to ``_key``, NULL where one has no row."""
    for df in blocks:
        here = keys["_key"].eqNullSafe(df[key])
        keys = keys.join(df.hint("merge"), here, "left").drop(df[key], df["_row"])
    return keys


def _repeated_keys(
    held: Sequence[DataFrame],
    hot: DataFrame,
    repeated: Sequence[int],
    key: str,
    flat: Sequence[str],
    piece: int,
) -> DataFrame:
    """Every combination of the rows of the keys in ``hot``, block by block.

    A block's rows of a key are cut into pieces, and a cell is one piece of each repeated
    block: a number whose digits are the pieces. A row stands in all cells of its piece.
    Few bytes make many rows here, so rows are dealt to a set number of tasks.
    """
    tasks = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = {i: F.greatest(F.ceil(F.col(f"_n{i}") / piece), F.lit(1)).cast("long") for i in repeated}
    cut = hot.select(
        F.col(key).alias("_key"),
        "_id",
        *[F.col(f"_n{i}") for i in repeated],
        *[n.alias(f"_s{i}") for i, n in pieces.items()],
    )
    cells = reduce(lambda a, b: a * b, [F.col(f"_s{i}") for i in repeated])
    of_block = {i: [c for c in flat if c.startswith(f"_b{i}_")] for i in repeated}
    fixed = [c for c in flat if not any(c in own for own in of_block.values())]
    single = _beside(cut, [df for i, df in enumerate(held) if i not in repeated], key)
    every = F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("_cell")
    out = single.select("_key", "_id", *fixed, every)
    out = out.repartition(tasks, "_id", "_cell")
    below = F.lit(1).cast("long")
    for i, own in of_block.items():
        size = F.col(f"_s{i}")
        there = held[i].join(cut, held[i][key].eqNullSafe(cut["_key"])).select(
            *cut.columns, *own, F.pmod(F.xxhash64("_row"), size).alias("_piece")
        )
        absent = cut.filter(F.col(f"_n{i}") == 0).withColumn("_piece", F.lit(0).cast("long"))
        rows = there.unionByName(absent, allowMissingColumns=True)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("_cells div _own") - 1))
        cell = F.expr("(_other div _below) * _below * _own + _piece * _below + _other % _below")
        placed = (
            rows.withColumns({"_cells": cells, "_own": size, "_below": below})
            .withColumn("_other", other)
            .select("_id", cell.alias("_cell"), *own)
        )
        out = out.join(placed.repartition(tasks, "_id", "_cell"), ["_id", "_cell"])
        below = below * size
    return out.select(F.col("_key").alias(key), *flat)


def merge_households(modules: Mapping[str, DataFrame]) -> DataFrame:
    """All household blocks, full-outer merged on HHID."""
    m = modules
    return merge_blocks(
        [
            m["gsec1"].select("HHID", "region", "urban", "month", "mult"),
            assets(m["gsec14"]),
            composition(m["gsec2"]),
            education(m["gsec4"]),
            fuel_and_stove(m["gsec10b"]),
            power(m["gsec10a"]),
            housing(m["gsec9a"]),
            pick(m["consumption"], "HHID", "cpexp30", "welfare", "poor"),
            head_block(m["gsec2"], m["gsec4"], m["gsec8"]),
        ]
    )


def per_capita(df: DataFrame) -> DataFrame:
    """Yearly consumption per head, and members per room in place of rooms."""
    size, rooms = F.col("hhsize").cast("double"), F.col("rooms")
    per_room = if_known(rooms == 0, size, F.try_divide(size, rooms))
    return df.withColumn("cpp", F.try_divide(F.col("cpexp30"), size) * 12).withColumn(
        "rooms", per_room
    )


def exclude_households(df: DataFrame, ids: Sequence[str] = EXCLUDED_HOUSEHOLDS) -> DataFrame:
    return reduce(lambda d, i: d.filter(F.col("HHID").cast("string") != i), ids, df)


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without a NULL in any column (an infinite or NaN value counts as known)."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    return df.filter(known)


def add_bins(df: DataFrame) -> DataFrame:
    """Categories used in regressions; a value outside the limits stays NULL."""
    return (
        df.withColumn("hhsize_fct", bin_left(F.col("hhsize"), HHSIZE_BREAKS))
        .withColumn("head_age_fct", bin_left(F.col("head_age"), HEAD_AGE_BREAKS))
        .withColumn("month", F.col("month").cast("string"))
        .withColumn("region", F.col("region").cast("string"))
    )


def finish(merged: DataFrame) -> DataFrame:
    """Exclude, derive, keep complete rows, then cut the categories."""
    return add_bins(complete_cases(per_capita(exclude_households(merged))))


def build_households(modules: Mapping[str, DataFrame]) -> DataFrame:
    return finish(merge_households(modules))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row: empty when a join on them cannot fan out."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
