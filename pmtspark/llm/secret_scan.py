"""Secrets in every version of every path, scanned once per content and rule version."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pmtspark.sources.tables import scratch_root


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, of which ``group`` is long enough.

    A match that is too short still uses up its text. ``hints`` are lower-case ASCII texts of
    which a match has at least one, in either case; none: every text is searched.
    """

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()


# The three base kinds are given; the others follow the public formats of keys.
BASE = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
        any_case=True,
        hints=("password", "passwd", "secret", "token", "api_key", "apikey"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24),
)
MORE = (
    Rule("github", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", hints=("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
)
RULES = BASE + MORE

PAIR = "struct<rule:string,version:int>"
SPAN = "struct<rule:string,version:int,start:int,end:int>"
LEDGER = f"blob binary, rules array<{PAIR}>, spans array<{SPAN}>, run string"


def spans_of(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int, int]]:
    """(rule, version, start, end) in code points of all matches that are long enough."""
    lowered = text.encode().lower()
    out = []
    for r in rules:
        if r.hints and not any(h.encode() in lowered for h in r.hints):
            continue
        # ASCII only: else letters such as the long s would match in either case
        flags = re.ASCII | (re.IGNORECASE if r.any_case else 0)
        for m in re.compile(r.pattern, flags).finditer(text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((r.name, r.version, m.start(), m.end()))
    return out


def with_blob(versions: DataFrame) -> DataFrame:
    """Adds ``blob``, the content's address: SHA-256 of the text in UTF-8, null as empty."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))


class BlobLedger:
    """Table of the contents that have been scanned, with which rule versions, and the finds.

    A row is one content of one run: what it was scanned for and all spans found. So a run that
    is lost half-way leaves whole rows or none, and what it left out is scanned by the next. No
    text is kept. ``folder`` must be one that all executors reach.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES):
        if len({r.name for r in rules}) < len(rules):
            raise ValueError("rules share a name")
        self.path, self.rules, self._spark = f"{folder}/ledger", tuple(rules), spark
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(self.path)

    def rows(self) -> DataFrame:
        return self._spark.read.schema(LEDGER).parquet(self.path)

    def _wanted(self):
        return F.array(
            *[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in self.rules]
        )

    def unseen(self, versions: DataFrame) -> DataFrame:
        """(blob, text, todo): contents with the rules not yet run on them, a row per task at most.

        Copies are dropped where they are read, so a content with very many copies is a few rows
        when texts are dealt out by content; what is left of copies then meets in one task.
        """

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                new = []
                for i, blob in enumerate(batch.column("blob").to_pylist()):
                    if blob not in seen:
                        seen.add(blob)
                        new.append(i)
                yield batch.take(pa.array(new, pa.int64()))

        texts = with_blob(versions.select(F.coalesce("text", F.lit("")).alias("text")))
        dealt = texts.mapInArrow(once, "text string, blob binary").repartition("blob")
        done = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        todo = F.array_except(
            self._wanted(), F.coalesce("done", F.array().cast(f"array<{PAIR}>"))
        ).alias("todo")
        return (
            dealt.join(done.hint("shuffle_hash"), "blob", "left")
            .select("blob", "text", todo)
            .where(F.size("todo") > 0)
        )

    def update(self, versions: DataFrame) -> None:
        """Scan what is new in ``versions`` (column text) or in the rules, and write it down."""
        rules = {(r.name, r.version): r for r in self.rules}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            pairs = pa.list_(pa.struct([("rule", pa.string()), ("version", pa.int32())]))
            span = [("rule", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
            names = [n for n, _ in span]
            for batch in batches:
                blobs, todos, finds = [], [], []
                for i, blob in enumerate(batch.column("blob").to_pylist()):
                    if blob in seen:
                        continue
                    seen.add(blob)
                    todo = batch.column("todo")[i].as_py()
                    own = [rules[t["rule"], t["version"]] for t in todo]
                    found = spans_of(batch.column("text")[i].as_py(), own)
                    blobs.append(blob)
                    todos.append(todo)
                    finds.append([dict(zip(names, x, strict=True)) for x in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blobs, pa.binary()),
                        pa.array(todos, pairs),
                        pa.array(finds, pa.list_(pa.struct(span))),
                    ],
                    ["blob", "rules", "spans"],
                )

        scanned = self.unseen(versions).mapInArrow(scan, LEDGER.rpartition(",")[0])
        scanned.withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """(blob, found): spans of the ledger's rules by start, then rule order; none, no row.

        ``found`` holds structs of start, place (of the rule), rule and end.
        """
        place = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.name, i)])
        spans = self.rows().where(F.size("spans") > 0).select("blob", F.inline("spans"))
        current = F.array_contains(self._wanted(), F.struct("rule", "version"))
        found = F.struct("start", F.element_at(place, F.col("rule")).alias("place"), "rule", "end")
        return (
            spans.where(current)
            .groupBy("blob")
            .agg(F.array_sort(F.collect_set(found)).alias("found"))
        )

    def report(self, versions: DataFrame, *paths: str) -> DataFrame:
        """Columns ``paths`` of every version with the spans of its content, empty if none."""
        empty = F.array().cast("array<struct<start:int,place:int,rule:string,end:int>>")
        return (
            with_blob(versions)
            .select(*paths, "blob")
            .join(self.findings(), "blob", "left")
            .select(*paths, "blob", F.coalesce("found", empty).alias("found"))
        )


def joined_spans(found: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ","
    )


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, folder: str | None = None) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Runs the ledger in ``folder`` (a new one in the shared folder if none is named) over the
    documents, whose rows are versions of the path doc_id, and joins the finds back to all of
    them. ``spans`` has all spans as kind:start:end in code points, end exclusive, by start and
    then rule order; ``base_sha256`` is the digest of those of the base kinds.

    Columns used: doc_id, text. Null is the empty text; null and repeated ids are rows of their
    own, as are repeated rows, whose text is scanned once. Texts are searched whole, one at a
    time, so memory follows the longest. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ledger = BlobLedger(spark, folder or f"{scratch_root(spark)}/secrets-{uuid.uuid4().hex}", rules)
    ledger.update(docs)
    base = F.filter("found", lambda x: x["rule"].isin([r.name for r in BASE]))

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("long").alias(f"n_{kind}")

    return ledger.report(docs, "doc_id").select(
        "doc_id",
        *[count(r.name) for r in BASE],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )
