"""Design matrices: model terms -> numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pmtspark.functions import left_labels
from pmtspark.operators.households import HEAD_AGE_BREAKS, HHSIZE_BREAKS

# Covariate sets.
BASIC = (
    "toilet_flush", "toilet_pit", "floor_finished", "wall_finished", "roof_finished",
    "fuel_electric_gas", "fuel_coal", "urban", "head_age_fct", "head_female",
    "head_educ_primary", "head_educ_secondary", "head_divorced", "head_widow",
    "head_work_salary", "head_work_selfemployed", "shares_f_5", "shares_m_5",
    "shares_f_14", "shares_m_14", "shares_f_65", "shares_m_65", "hhsize_fct", "month",
    "region",
)
EXTENDED = (
    "water_piped", "water_well", "toilet_flush", "toilet_pit", "floor_finished",
    "wall_finished", "roof_finished", "rooms", "kitchen_room", "fuel_electric_gas",
    "fuel_coal", "electricity", "radio", "television", "bicycle", "motorbike", "car",
    "mobile_phone", "computer", "stove_any", "iron", "generator", "own_house", "urban",
    "head_age_fct", "head_female", "head_educ_primary", "head_educ_secondary",
    "hh_educ_primary", "hh_educ_secondary", "head_divorced", "head_widow",
    "head_married_never", "head_work_salary", "head_work_selfemployed", "head_work_daily",
    "shares_f_5", "shares_m_5", "shares_f_14", "shares_m_14", "shares_f_65",
    "shares_m_65", "hhsize_fct", "month", "region",
)
SIMPLE = (
    "head_female", "head_age", "head_married", "head_educ_primary", "head_educ_secondary",
    "hhsize", "urban",
)
COVARIATE_SETS = {"Basic": BASIC, "Extended": EXTENDED}
BINNED_LEVELS = {
    "hhsize_fct": left_labels(HHSIZE_BREAKS),
    "head_age_fct": left_labels(HEAD_AGE_BREAKS),
}
MAX_LEVELS = 1000


def observed_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels of categorical columns, numeric codes in numeric order."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns
    ]))
    seen = df.select(pairs.alias("p")).select("p.c", "p.v").filter("v IS NOT NULL").distinct()
    # more rows than this mean that some column has more levels than it may
    rows = seen.limit(MAX_LEVELS * len(columns) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r.c].append(r.v)
    for c, v in out.items():
        if len(v) > MAX_LEVELS:
            raise ValueError(f"{c}: over {MAX_LEVELS} levels, not a category of a dense design")
    return {
        c: sorted(v, key=(lambda s: (int(s), s)) if all(_is_int(s) for s in v) else str)
        for c, v in out.items()
    }


def _text(level: str) -> str:
    return "'" + level.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sum(pieces: Sequence[str]) -> str:
    """Sum as a balanced tree, so that long ones do not nest deeply."""
    if len(pieces) == 1:
        return pieces[0]
    half = len(pieces) // 2
    return f"({_sum(pieces[:half])} + {_sum(pieces[half:])})"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1D ELSE 0D END"


def _is_int(text: str) -> bool:
    return text.lstrip("-").isdigit()


@dataclass(frozen=True)
class Design:
    """Named numeric columns for a list of terms, with fixed category levels."""

    terms: tuple[str, ...]
    levels: Mapping[str, Sequence[str]]
    booleans: frozenset[str]
    intercept: bool = True
    drop_first: bool = True
    pairwise: bool = False

    @classmethod
    def of(
        cls,
        df: DataFrame,
        terms: Sequence[str],
        levels: Mapping[str, Sequence[str]] | None = None,
        **options: bool,
    ) -> Design:
        """Design whose category levels come from the whole of ``df``.

        Fix it before splitting, so that every part has the same columns.
        """
        types = {f.name: f.dataType for f in df.schema}
        known = {t: v for t, v in {**BINNED_LEVELS, **(levels or {})}.items() if t in terms}
        open_ = [t for t in terms if isinstance(types[t], T.StringType) and t not in known]
        known |= observed_levels(df, open_)
        flags = frozenset(t for t in terms if isinstance(types[t], T.BooleanType))
        return cls(tuple(terms), known, flags, **options)

    def with_options(self, **options: bool) -> Design:
        return Design(**{**self.__dict__, **options})

    def _parts(self) -> list[tuple[str, str, str]]:
        """(term, column name, SQL expression) of the main effects."""
        out = []
        for t in self.terms:
            if t in self.levels:
                for level in list(self.levels[t])[1 if self.drop_first else 0 :]:
                    out.append((t, f"{t}{level}", _flag(f"`{t}` = {_text(level)}")))
            elif t in self.booleans:
                if not self.drop_first:
                    out.append((t, f"{t}FALSE", _flag(f"NOT `{t}`")))
                out.append((t, f"{t}TRUE", _flag(f"`{t}`")))
            else:
                out.append((t, t, f"CAST(`{t}` AS DOUBLE)"))
        return out

    def expressions(self) -> list[tuple[str, str]]:
        """Column names with their SQL expressions, in the order of coefficients."""
        parts = self._parts()
        out = [("(Intercept)", "1D")] if self.intercept else []
        out += [(name, text) for _, name, text in parts]
        if self.pairwise:
            for i, (ti, ni, ei) in enumerate(parts):
                out += [
                    (f"{ni}:{nj}", f"{ei} * {ej}") for tj, nj, ej in parts[i + 1 :] if tj != ti
                ]
        return out

    def columns(self) -> list[tuple[str, Column]]:
        return [(name, F.expr(text)) for name, text in self.expressions()]

    def dot(self, beta: str) -> Column:
        """Sum of coefficients times columns; an aliased (NULL) coefficient counts as zero.

        Without a fit, that is a NULL ``beta``, the result is NULL.

        A category adds the coefficient of its level, found by position, instead
        of a product for every dummy, which keeps the generated code small.
        """

        def coefficient(at: int | str) -> str:
            return f"coalesce(get(`{beta}`, {at}), 0D)"

        def scored(pieces: Sequence[str]) -> Column:
            return F.expr(f"CASE WHEN `{beta}` IS NOT NULL THEN {_sum(pieces)} END")

        if self.pairwise:
            pieces = [f"{coefficient(i)} * {e}" for i, (_, e) in enumerate(self.expressions())]
            return scored(pieces)
        pieces = [coefficient(0)] if self.intercept else []
        at, skipped = len(pieces), 1 if self.drop_first else 0
        for t in self.terms:
            if t in self.levels:
                used = list(self.levels[t])[skipped:]
                whens = " ".join(f"WHEN {_text(v)} THEN {at + i}" for i, v in enumerate(used))
                if used:
                    pieces.append(coefficient(f"CASE `{t}` {whens} END"))
                at += len(used)
            elif t in self.booleans:
                if skipped:
                    pieces.append(f"CASE WHEN `{t}` THEN {coefficient(at)} ELSE 0D END")
                else:
                    pieces.append(coefficient(f"CASE WHEN `{t}` THEN {at + 1} ELSE {at} END"))
                at += 2 - skipped
            else:
                pieces.append(f"{coefficient(at)} * CAST(`{t}` AS DOUBLE)")
                at += 1
        return scored(pieces)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.expressions()]

    def ordinal(self) -> list[tuple[str, Column]]:
        """One column per term, categories as level numbers."""
        out = []
        for t in self.terms:
            if t in self.levels:
                whens = [f"WHEN {_text(v)} THEN {i}D" for i, v in enumerate(self.levels[t])]
                text = f"CASE `{t}` {' '.join(whens)} END"
            elif t in self.booleans:
                text = _flag(f"`{t}`")
            else:
                text = f"CAST(`{t}` AS DOUBLE)"
            out.append((t, F.expr(text)))
        return out

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows where every term is known (a category outside its levels is not)."""
        known = [
            f"`{t}` IN ({', '.join(map(_text, self.levels[t]))})"
            if t in self.levels
            else f"`{t}` IS NOT NULL"
            for t in self.terms
        ]
        return df.filter(" AND ".join(known)) if known else df

    def frame(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The design as a table of its own."""
        return self.complete(df).select(*keep, *[c.alias(n) for n, c in self.columns()])
