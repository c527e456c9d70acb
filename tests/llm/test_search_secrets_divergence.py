"""Ranked search, the secret ledger and source divergence: brute force and odd rows."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pmtspark.llm import divergence, ranked_search as search
from pmtspark.llm.divergence import audit_sources, row_sums
from pmtspark.llm.ranked_search import nra, ranked_search
from pmtspark.llm.secret_scan import RULES, BlobLedger, Rule, scan_secrets, spans_of
from pmtspark.llm.terms import count_terms, fold_table
from pmtspark.llm.text import text_slices

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, term string, rank int"
ITEM = "item_id long, text string, doc_id string, score string"


def docs_of(spark, rows):
    """Rows (id, text, lang, source), with columns whose names the operators also use."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ITEM)


@pytest.fixture(scope="module")
def odd_rows():
    prose = " ".join(f"word{i % 97} and{i % 13}" for i in range(400))
    return [
        (1, prose, "en", "a"),
        (1, prose, "en", "a"),
        (1, "Another text under the SAME id", "en", None),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n", None, "b"),
        (None, prose + " more", "en", "b"),
        (None, None, None, None),
        (5, " ".join(f"w{i % 5000}" for i in range(60_000)), "de", "b"),
        (6, "one ONE One", "de", ""),
        (7, "é ü É 日本語 \U0001f600 word1", "fr", "c"),
        (8, "word1 token: abcdefgh", "en", "c"),
        (9, "word1 token: abcdefgh", "de", "c"),
    ]


@pytest.mark.parametrize("digits", [True, False])
def test_terms_are_counted_by_text(digits):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aB9 .é日\n\x00"), 40)) for _ in range(50)] + ["", "a", "é"]
    texts[10] = ""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import pyarrow as pa

    found = {}
    for s in text_slices(pa.array(texts), 200):
        c = count_terms(s, fold_table(digits))
        terms = c.terms.to_pylist()
        for row, code, count in zip(c.row, c.code, c.count, strict=True):
            found[s.first + int(row), terms[code]] = int(count)
        for row, total in enumerate(c.total):
            assert total == len(re.findall(pattern, texts[s.first + row]))
    want = collections.Counter(
        (i, t) for i, x in enumerate(texts) for t in re.findall(pattern, x.translate(lower))
    )
    assert found == dict(want)


# Ranked search


@pytest.mark.parametrize("seed", range(30))
def test_nra_equals_full_sums(seed):
    rng = np.random.default_rng(seed)
    size, top = int(rng.integers(1, 900)), int(rng.integers(1, 12))
    total = np.zeros(size, np.int64)
    lists = []
    for _ in range(int(rng.integers(1, 9))):
        docs = rng.permutation(size)[: int(rng.integers(0, size + 1))]
        gains = np.sort(rng.integers(1, 4 if seed % 2 else 10_000, len(docs)))[::-1]
        total[docs] += gains
        lists.append((docs, gains.astype(np.int64)))
    want = sorted(((-t, d) for d, t in enumerate(total) if t > 0))[:top]
    assert nra(lists, size, top) == [(d, -t) for t, d in want]


def test_nra_stops_before_the_end_of_its_lists():
    class Watched(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Watched.read = max(Watched.read, min(at.stop, len(self)))
            return super().__getitem__(at)

    size = 100_000
    gains = np.ones(size, np.int64)
    gains[:5] = 1_000
    docs = np.arange(size).view(Watched)
    assert nra([(docs, gains), (np.arange(size), gains)], size, 5) == [(d, 2_000) for d in range(5)]
    assert Watched.read <= 2 * search.FIRST_DEPTH


def best_by_force(rows, items, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms_of = lambda t: re.findall(search.TERM, (t or "").translate(lower))
    docs = [(r[0], collections.Counter(terms_of(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, size = len(docs), sum(x for *_, x in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set((i, t or "") for i, t in items), key=str):
        scored = []
        for doc, c, length in docs:
            m = 100 - 90 + 90 * length * n // size
            score = 0
            for t in set(terms_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [1 << 23, 3000])
def test_search_on_odd_rows(spark, odd_rows, shard, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 5)  # several blocks of items
    items = [
        (1, "word1 and2 w7 another"), (1, "word1 and2 w7 another"), (1, "日本語 ONE"),
        (2, None), (3, ""), (None, "word1"), (4, "nowhere"), (5, "word1 " * 3_000 + "token"),
    ]
    docs = docs_of(spark, odd_rows).repartition(3)
    found = ranked_search(docs, items_of(spark, items), shard_bytes=shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == best_by_force(odd_rows, items)


def test_search_of_empty_tables(spark, odd_rows):
    docs, items = docs_of(spark, odd_rows), items_of(spark, [(1, "word1")])
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_search_by_text_ids(spark, odd_rows):
    docs = docs_of(spark, odd_rows).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = ranked_search(docs, items_of(spark, [(1, "word1 token")])).collect()
    want = best_by_force(odd_rows, [(1, "word1 token")])
    assert [(r.rank, r.doc_id, r.score) for r in found] == [
        (r[1], None if r[2] is None else str(r[2]), r[3]) for r in want
    ]


def test_search_equals_brute_force_on_shards(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    found = ranked_search(docs, items, shard_bytes=50_000)
    assert rows_of(found) == best_by_force(rows, asked)


# Secrets


def test_spans_are_leftmost_and_failing_matches_use_up_text():
    hexes = "0123456789abcdef0123456789"
    text = f"é secret:token:abcdefgh PASSWORD = 'abc123' x{hexes}g AKIA{'A' * 16} AKIAabc"
    found = [(r, s, e) for r, _, s, e in spans_of(text, RULES)]
    at = text.index("PASSWORD")
    h, a = text.index(hexes), text.index("AKIA")
    assert sorted(found) == [
        ("access", a, a + 20), ("assign", at, at + len("PASSWORD = 'abc123")), ("hex", h, h + 26)
    ]


def test_only_ascii_letters_match_in_either_case():
    assert spans_of("ſecret: abcdefgh toKen: abcdefgh", RULES) == []
    assert [x[0] for x in spans_of("Api_Key: abcdefgh aPIkEY=abcdefg", RULES)] == ["assign"] * 2


def test_added_kinds():
    text = (
        f"ghp_{'Z' * 36} AIza{'Y' * 35} xoxb-1234567890 eyJabcdefgh1.eyJabcdefgh2.sig_12345 "
        "-----BEGIN RSA PRIVATE KEY-----"
    )
    assert {x[0] for x in spans_of(text, RULES)} == {r.name for r in RULES[3:]}


def test_hints_lose_no_match():
    plain = [Rule(r.name, r.version, r.pattern, r.least, r.group, r.any_case) for r in RULES]
    rng = np.random.default_rng(5)
    parts = ["password", "PassWD", "=", ":", " ", "'", "abcdef12", "AKIA" + "Z" * 17, "token", "é",
             "gho_" + "1" * 40, "0" * 30, "AIza" + "x" * 35, "xoxa-" + "1" * 12, "\n"]
    for _ in range(300):
        text = "".join(rng.choice(parts, 12))
        assert spans_of(text, RULES) == spans_of(text, plain)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    one = spark.createDataFrame(
        [("a", 1, "token: abcdefgh"), ("b", 1, "token: abcdefgh"), ("a", 2, "clean"), ("c", 1, None)],
        "path string, version int, text string",
    )
    ledger = BlobLedger(spark, str(tmp_path))
    ledger.update(one.repartition(4))
    assert ledger.rows().count() == 3  # a content per row, however many paths and versions
    ledger.update(one)
    assert ledger.rows().count() == 3 and ledger.unseen(one).count() == 0
    more = one.unionByName(spark.createDataFrame([("d", 1, "secret=12345678")], one.schema))
    assert ledger.unseen(more).count() == 1
    ledger.update(more)
    assert ledger.rows().count() == 4
    found = {(r.path, r.version): [x.rule for x in r.found] for r in ledger.report(more, "path", "version").collect()}
    assert found == {
        ("a", 1): ["assign"], ("b", 1): ["assign"], ("a", 2): [], ("c", 1): [], ("d", 1): ["assign"]
    }


def test_ledger_runs_a_new_rule_version_alone(spark, tmp_path):
    docs = spark.createDataFrame([("token: abcdefgh zz99",), ("zz88",)], "text string")
    BlobLedger(spark, str(tmp_path), [*RULES, Rule("own", 1, "zz8[0-9]")]).update(docs)
    later = BlobLedger(spark, str(tmp_path), [*RULES, Rule("own", 2, "zz[0-9]+")])
    assert {(t.rule, t.version) for r in later.unseen(docs).collect() for t in r.todo} == {("own", 2)}
    later.update(docs)
    found = sorted(tuple(x.rule for x in r.found) for r in later.findings().collect())
    assert found == [("assign", "own"), ("own",)]
    # the older version's finds stay written, but are not reported
    assert {s.version for r in later.rows().collect() for s in r.spans if s.rule == "own"} == {1, 2}


def test_ledger_after_a_lost_run(spark, tmp_path):
    """A run that wrote only some contents leaves the rest to the next; repeats count once."""
    docs = spark.createDataFrame([("token: abcdefgh",), ("secret: abcdefgh",)], "text string")
    ledger = BlobLedger(spark, str(tmp_path))
    ledger.update(docs.limit(1))
    rows = ledger.rows().collect()
    spark.createDataFrame(rows, ledger.rows().schema).write.mode("append").parquet(ledger.path)
    ledger.update(docs)
    assert sorted(len(r.found) for r in ledger.findings().collect()) == [1, 1]


def test_rules_need_names_of_their_own(spark, tmp_path):
    with pytest.raises(ValueError, match="share"):
        BlobLedger(spark, str(tmp_path), [RULES[0], RULES[0]])


def test_secrets_of_odd_rows(spark, odd_rows):
    long = "x " * 300_000 + "password=hunter22 é " + "ab" * 20
    rows = [*odd_rows, (10, long, "en", "a"), (10, long, "en", "a")]
    found = scan_secrets(docs_of(spark, rows).repartition(3))
    none = hashlib.sha256(b"").hexdigest()
    assert found.count() == len(rows)
    got = collections.Counter((r.doc_id, r.spans) for r in found.collect())
    at = long.index("password")
    assert got[10, f"assign:{at}:{at + 17},hex:{len(long) - 40}:{len(long)}"] == 2
    assert got[8, "assign:6:21"] == got[9, "assign:6:21"] == 1
    assert got[None, ""] == 2 and got[1, ""] == 3
    assert {r.base_sha256 for r in found.where("spans = ''").collect()} == {none}
    assert scan_secrets(docs_of(spark, [])).count() == 0


# Source divergence


def distances_by_force(source, term, p, base):
    terms = range(int(term.max()) + 1 if len(term) else 0)
    value = {(s, t): x for s, t, x in zip(source.tolist(), term.tolist(), p.tolist(), strict=True)}
    return {
        (g, h): sum(abs(value.get((g, t), base[g]) - value.get((h, t), base[h])) for t in terms)
        for g, h in itertools.combinations(range(len(base)), 2)
    }


@pytest.mark.parametrize("seed", range(20))
def test_row_sums_are_distances(seed):
    rng = np.random.default_rng(seed)
    groups, terms = int(rng.integers(1, 9)), int(rng.integers(0, 30))
    cells = [(g, t) for t in range(terms) for g in range(groups) if rng.random() < 0.4]
    held = {t: i for i, t in enumerate(sorted({t for _, t in cells}))}  # a kept term occurs
    source = np.array([g for g, _ in cells], np.int64)
    term = np.array([held[t] for _, t in cells], np.int64)
    p = rng.integers(1, 10**9, len(cells))
    base = rng.integers(1, 10**6, groups)
    found = collections.Counter()
    for g, out in row_sums(source, term, p, base):
        for h in range(groups):
            if h != g:
                found[min(g, h), max(g, h)] += int(out[h])
    want = distances_by_force(source, term, p, base.tolist())
    assert {k: found[k] for k in want} == want


def audit_by_force(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [
        (la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)))
        for _, t, la, so in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for la, _, w in docs if la == lang for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: collections.Counter() for la, s, _ in docs if la == lang}
        for la, s, w in docs:
            if la == lang:
                counts[s].update(t for t in w if t in set(kept))

        def shares(c):
            n = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // n for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), collections.Counter()))
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i, -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least, top", [(1, 3), (2, 50), (1_000, 50)])
def test_audit_of_odd_rows(spark, odd_rows, least, top, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 40)  # several blocks of terms
    found = audit_sources(docs_of(spark, odd_rows).repartition(3), least, top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(found) == audit_by_force(odd_rows, least, top)


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert rows_of(audit_sources(docs)) == audit_by_force(rows, 30, 50)


def test_audit_counts_are_exact_beyond_64_bits(spark):
    n = 4_000_000_000_000
    row = spark.range(1).select(
        divergence.smoothed(F.lit(n - 1), F.lit(n), F.lit(7)).alias("p"),
        divergence.smoothed(F.lit(0), F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert row.p == 1 + 10**9 * (n - 1 + 5) // (n + 35) and row.none == 0


def test_audit_of_an_empty_table(spark):
    assert audit_sources(docs_of(spark, [])).count() == 0
