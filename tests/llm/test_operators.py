"""The training-data operators on odd rows, against brute force, and on held-out labels."""

import collections
import gzip
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pmtspark.llm import decontaminate, mixing
from pmtspark.llm.chat import digest_conversations, examples, format_turns, parse, render
from pmtspark.llm.components import components
from pmtspark.llm.decontaminate import drop_leaks, edits_allowed, find_leaks
from pmtspark.llm.langid import identify_languages
from pmtspark.llm.license_scan import TEMPLATES, scan_licenses
from pmtspark.llm.mixing import mix_documents
from pmtspark.llm.near_duplicates import choose_bands, keep_one, near_duplicates
from pmtspark.llm.quality import classify_quality
from pmtspark.llm.quality_rules import Rule, apply_rules, keep_documents, sketch, thresholds
from pmtspark.llm.text import hash_strings, shingle_hashes, text_slices, words
from pmtspark.llm.toxicity import detect_toxicity
from pmtspark.llm.warc import (
    RECORD,
    archive_pages,
    chunked,
    dechunk,
    inflated,
    read_warc,
    reassemble,
    records_of,
    split_records,
)

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, row string, document int"


def docs_of(spark, rows):
    """Rows (id, text, lang, source), with two columns whose names operators also use."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows and ids."""
    prose = " ".join(f"word{i % 97} and{i % 13}" for i in range(400))
    long = " ".join(f"w{i}" for i in range(60_000))
    return docs_of(
        spark,
        [
            (1, prose, "en", "a"),
            (1, prose, "en", "a"),
            (1, "another text under the same id", "en", None),
            (2, None, None, None),
            (3, "", "en", "a"),
            (4, " \t\n", None, "b"),
            (None, prose + " more", "en", "a"),
            (None, None, None, None),
            (5, long, "de", "b"),
            (6, "one", "de", ""),
            (7, "é ü 日本語 \U0001f600", "fr", "c"),
        ],
    )


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def plain_words(text):
    return WORDS.findall(text or "")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_words_and_shingles():
    texts = ["", "a b", None, "  one two three four five six\n", "é ü"]
    (s,) = text_slices(pa.array(texts))
    w = words(s)
    assert [int(x) for x in np.diff(w.first)] == [len(plain_words(t)) for t in texts]
    expected = hash_strings([x for t in texts for x in plain_words(t)])
    assert (w.hash == expected).all()
    _, bounds = shingle_hashes(w, 5)
    assert np.diff(bounds).tolist() == [0, 1, 0, 2, 1]
    assert sum(s.rows for s in text_slices(pa.array(texts), 3)) == len(texts)


def test_license_scan(spark, odd, none):
    lines = list(TEMPLATES.items())
    rows = [(i, "before it " * i + t + " after it", None, None) for i, (_, t) in enumerate(lines)]
    found = scan_licenses(docs_of(spark, rows)).collect()
    assert {(i, k) for i, (k, _) in enumerate(lines)} <= {(r.doc_id, r.license) for r in found}
    edited = TEMPLATES["gpl-header"].replace("redistribute it", "hand it on")
    one = scan_licenses(docs_of(spark, [(1, edited.upper(), None, None)])).collect()
    assert [r.license for r in one] == ["gpl-header"] and 0.8 <= one[0].containment < 1
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi </turn>\n<turn x>\n"),
        (1, 1, "assistant", "\\<back\\"),
        (1, 2, "user", None),
        (1, 3, "assistant", "Ünï"),
        (1, 4, "user", "rest"),
        (2, None, None, "x"),
        (2, 0, "assistant", "y"),
        (2, 0, "assistant", "y"),
        (None, 1, "user", "no id"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = format_turns(turns).cache()
    back = sorted((r.conv_id or -1, r.number, *parse(r.segment)) for r in segments.collect())
    assert [x[2:] for x in back if x[0] == 1] == [(r[2], r[3] or "") for r in rows[:5]]
    texts = {(r.conv_id, r.target): r for r in render(segments, examples(segments)).collect()}
    assert set(texts) == {(1, 1), (1, 3), (1, 4), (2, 1), (2, 2), (None, 0)}
    assert texts[1, 3].text[texts[1, 3].loss_start : texts[1, 3].loss_end] == "Ünï"
    assert texts[1, 3].text.startswith(texts[1, 1].text) and texts[1, 4].loss_start is None
    digests = {r.conv_id: r for r in digest_conversations(segments).collect()}
    assert digests[1].loss_chars == len("\\<back\\") + 3 and digests[1].n_turns == 5
    assert digests[1].formatted_chars == sum(len(t.text) for k, t in texts.items() if k[0] == 1)
    assert digests[2].loss_chars == 2 and digests[None].examples == 1
    assert digest_conversations(format_turns(turns.limit(0))).count() == 0


def test_chat_digests_come_from_examples(spark):
    """Against plain Python, with clashing names, a very long text and many conversations."""
    rng = random.Random(8)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["<a>", "\\", "é\n", None, "x" * 40]))
        for c in [*range(40), None]
        for t in rng.sample(range(90), rng.randrange(1, 9))
    ]
    rows.append((99, 0, "assistant", "<" * 300_000))
    extra = [(*r, "s", 1, 2) for r in rows]
    turns = spark.createDataFrame(
        extra, "conv_id long, turn long, role string, text string, segment string, start int, target int"
    ).repartition(5)
    digests = digest_conversations(format_turns(turns))
    plan = digests._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 2
    got = {r.conv_id: r for r in digests.collect()}
    assert len(got) == 42
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        upto, spelled = "", []
        for i, (_, _, role, text) in enumerate(own):
            safe = re.sub(r"([\\<>])", r"\\\1", text or "")
            upto += f"<turn {role}>\n{safe}\n</turn>\n"
            if role == "assistant" or i == len(own) - 1:
                spelled.append(upto)
        assert (r.n_turns, r.loss_chars, r.examples) == (len(own), len(loss), len(spelled))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(map(len, spelled))


def test_chat_examples_hold_their_context(spark):
    """An example's text is every turn before it and its own, and ``render`` makes the same."""
    rows = [(c, t, ["user", "assistant"][t % 2], f"<{c}> {t}\\") for c in (1, 2, None) for t in range(7)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = format_turns(turns)
    made = {(r.conv_id, r.target): r for r in examples(segments).collect()}
    assert set(made) == {(c, t) for c in (1, 2, None) for t in (1, 3, 5, 6)}
    for (c, t), r in made.items():
        pieces = r.text.split("\n</turn>\n")[:-1]
        assert [parse(p + "\n</turn>\n") for p in pieces] == [x[2:] for x in rows if x[0] == c and x[1] <= t]
    spelled = {(r.conv_id, r.target): r.text for r in render(segments, examples(segments)).collect()}
    assert spelled == {k: r.text for k, r in made.items() if k in spelled} and (1, 6) in spelled


def test_decontamination(spark, odd, none):
    items = table(spark, "benchmark")
    rng = np.random.default_rng(3)
    rows, near = [], 0
    base = " ".join(f"filler{i % 31}" for i in range(300))
    for r in items.collect():
        w = r.text.split()
        n = len(re.findall(r"[^\W_]+", r.text))
        for k in rng.choice(len(w), min(edits_allowed(n, 0.2), len(w)), replace=False):
            w[k] = f"zz{k}"
        rows.append((r.item_id, f"{base} {' '.join(w).upper()} {base}", None, None))
        near += 1
    docs = docs_of(spark, rows)
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert {(i, i) for i, *_ in rows} <= found
    assert drop_leaks(docs, items).count() == 0
    kept = drop_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert find_leaks(none, items).count() == 0 and find_leaks(odd, items.limit(0)).count() == 0
    blank = items.select(F.col("item_id"), F.lit(None).cast("string").alias("text"))
    assert find_leaks(odd, blank).count() == 0
    real, plain = table(spark, "documents"), lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    texts = {r.doc_id: plain(r.text) for r in real.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if plain(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in find_leaks(real, items).collect()} >= exact


def test_edit_distance():
    edit = decontaminate.edit_distance_within
    assert edit(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (0, 4)
    assert edit(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 4, 9]))[0] == 1
    assert edit(np.array([1, 2]), np.array([7, 8]))[0] == 2


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = plain_words(t)
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    links, parent = collections.Counter(), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


@pytest.mark.parametrize("block", [1_000_000, 1500])
def test_near_duplicates(spark, block):
    docs = table(spark, "documents").select("doc_id", "text")
    rng = np.random.default_rng(8)
    w = [f"v{i}" for i in range(80)]
    more = []
    for k in range(40):  # a group of near copies
        own = list(w)
        own[rng.integers(len(w))] = f"new{k % 7}"
        more.append((10_000 + k, " ".join(own)))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.class_id, r.links) for r in near_duplicates(docs, block=block).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_odd(spark, odd, none):
    out = near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert sorted(r.links for r in out) == [0] * 8 + [2, 2, 2]
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_bands():
    bands, rows = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (5, 5), (7, 6)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {
        **{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100,
    }


def test_targets():
    sizes, weights = [100, 1000, 10], [1, 2, 3]
    out = mixing.targets(sizes, weights)
    assert sum(out) == pytest.approx(1110) and out[2] == 30 and out[0] == 300
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 256, 1000])
def test_permutation(size):
    assert sorted(mixing.permute(np.arange(size), size, 9)) == list(range(size))


def test_shard_counts():
    counts = np.array([700, 0, 5, 295])
    own = [mixing.shard_counts(counts, 10, k, 100, 3) for k in range(10)]
    assert (sum(x for x, _ in own) == counts).all() and all(x.sum() == 100 for x, _ in own)
    assert (own[4][1] == sum(x for x, _ in own[:4])).all()


def test_mixing(spark, odd, none):
    docs = table(spark, "documents")
    a, b = (mix_documents(docs).toPandas().sort_values("doc_id") for _ in range(2))
    assert (a.values == b.values).all() and len(a) == docs.count()
    assert (a["taken"] <= 3 * a["size"]).all()
    by = a.groupby("source").agg({"taken": "sum", "size": "sum", "target": "first"})
    assert (abs(by["taken"] - by["target"]) <= 0.05 * by["target"] + 128).all()
    assert (by["target"] <= 3 * by["size"] + 1e-6).all()
    out = mix_documents(odd).collect()
    counts = collections.Counter((r.doc_id, len(plain_words(r.text))) for r in odd.collect())
    assert counts == collections.Counter((r.doc_id, r["size"]) for r in out)
    assert mix_documents(none).count() == 0


def test_languages(spark, odd, none):
    docs = table(spark, "documents")
    out = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    got = [(r.lang_pred, r.score) for r in identify_languages(odd).collect()]
    assert len(got) == odd.count() and got.count(("und", 0.0)) == 4
    assert all(0 <= s <= 1 for _, s in got)
    assert identify_languages(none).count() == 0


def test_toxicity(spark, odd, none):
    bad, rows, labels = ["vile", "grubby", "rotten"], [], []
    rng = np.random.default_rng(1)
    for i in range(400):
        own = [f"plain{rng.integers(60)}" for _ in range(rng.integers(20, 200))]
        if i % 4 == 0:
            for _ in range(3):
                own[rng.integers(len(own))] = bad[rng.integers(3)]
        rows.append((i, " ".join(own), None, None))
        labels.append((i, 1, int(i % 4 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows.append((1000, "plain1 plain2 grubbby plain4 rottten rottten plain5 " * 2, None, None))
    out = {r.doc_id: r for r in detect_toxicity(docs_of(spark, rows), marks).collect()}
    wrong = [i for i in range(400) if out[i].held_out and out[i].predicted != (i % 4 == 0)]
    assert len(wrong) <= 3 and out[1000].predicted == 1
    assert detect_toxicity(odd, marks.limit(0)).where("score <> 0").count() == 0
    assert detect_toxicity(none, marks).count() == 0
    scored = detect_toxicity(docs_of(spark, rows).unionByName(odd), marks)
    assert scored.where("score between 0 and 1").count() == len(rows) + odd.count()


def test_quality_classifier(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = classify_quality(docs).join(labels, "doc_id").toPandas()
    assert out[out["quality"] == 1]["kept"].mean() > 0.99
    assert out[out["quality"] == 0]["kept"].mean() < 0.1
    rows = classify_quality(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.score == 0 and not r.kept for r in rows) >= 4
    assert classify_quality(none).count() == 0


def test_quality_rules(spark, odd, none):
    rows = apply_rules(odd).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in rows) == collections.Counter(
        (r.doc_id, len(plain_words(r.text))) for r in odd.collect()
    )
    assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)
    kept = keep_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert apply_rules(none).count() == 0 and keep_documents(none).count() == 0
    text = "a b c x a b c\nq\nq\n\n#$"
    (r,) = apply_rules(docs_of(spark, [(1, text, None, None)])).collect()
    assert (r.n_repeat_words, r.n_dup_lines, r.n_symbols, r.word_chars) == (6, 1, 2, 11)


def test_thresholds_follow_groups_without_a_step(spark):
    """Bounds against a plain mixture of sorted values; they move smoothly with a group's rows."""

    def mixed(values, wider, prior):
        whole = [(v, Fraction(1)) for v in values]
        return whole + [(v, w * prior / sum(x for _, x in wider)) for v, w in wider]

    def quantile(weighted, percent):
        total, upto = sum(w for _, w in weighted), Fraction(0)
        for v, w in sorted(weighted):
            upto += w
            if 100 * upto >= percent * total:
                return v

    rng = random.Random(4)
    sizes = {("en", "a"): 10, ("en", "b"): 199, ("en", None): 201, (None, "a"): 900, ("xx", "c"): 1}
    groups = {
        g: [round(rng.gauss(50 + 9 * i, 4 + i)) for _ in range(n)]
        for i, (g, n) in enumerate(sizes.items())
    }
    groups[("en", "b")][0] = 123_456
    rule = (Rule("word_length", percent=85, reach=4, below=True),)
    rows = [(*g, False, v) for g, vs in groups.items() for v in vs] + [("en", "a", True, 9999)] * 500
    rated = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, word_length long")
    got = {(r.lang, r.source): r for r in thresholds(sketch(rated, rule), rule, prior=200).collect()}
    cells = {g: [v if v < 10_000 else v // 100 * 100 for v in vs] for g, vs in groups.items()}
    every = [(v, Fraction(1)) for vs in cells.values() for v in vs]
    assert got.keys() == groups.keys()
    for g, values in cells.items():
        same = [v for h, vs in cells.items() if h[0] == g[0] for v in vs]
        own = mixed(values, mixed(same, every, 200), 200)
        low, mid, high = (quantile(own, p) for p in (15, 50, 85))
        assert got[g].word_length_max == high + 4 * (high - mid)
        assert got[g].word_length_min == low - 4 * (mid - low)
    assert len({r.word_length_max for r in got.values()}) > 3


def test_quality_rules_on_labelled_texts(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = apply_rules(docs).where("not base_failed").join(labels, "doc_id").toPandas()
    assert not out[out["quality"] == 0]["kept"].any()
    assert out[out["quality"] == 1]["kept"].mean() > 0.98


def test_warc(spark):
    big = "<p>" + "é" * 40_000
    rows = [
        (3, "http://a/ b\r\n", big), (2, None, big), (2, None, big), (5, "u", "short"),
        (6, "u", "short"), (7, "u", None), (None, "u", big), (9, "u", "a\r\n\r\nWARC/1.1" * 20),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    out = sorted(
        ((r.page_id or 99, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(pages).collect()),
        key=str,
    )
    size = len(big.encode())
    assert out == sorted(
        [
            (3, size, "revisit", 2), (2, size, "response", None), (2, size, "response", None),
            (5, 5, "response", None), (6, 5, "response", None), (7, 0, "response", None),
            (99, size, "revisit", 2), (9, 260, "response", None),
        ],
        key=str,
    )
    assert archive_pages(pages.limit(0)).count() == 0


def test_segments(spark):
    payload = bytes(range(256)) * 40
    assert dechunk(chunked(payload, 100)) == payload and dechunk(chunked(b"")) == b""
    row = {"page_id": 1, "url": "u", "digest": "d", "refers_to": None, "payload": payload}
    assert len(list(records_of(row, "n", 1000))) == 11
    rows = [
        ("a", 2, 4, "continuation", None, None, None, "", b"cd"),
        ("a", 1, None, "response", 1, None, None, "", b"ab"),
        ("b", 1, None, "response", 2, None, None, "", b"ab"),  # its end is lost
        ("c", 2, 4, "continuation", None, None, None, "", b"cd"),  # its start is lost
    ]
    got = reassemble(spark.createDataFrame(rows, RECORD)).collect()
    assert sorted((r.complete, r.page_id or 0) for r in got) == [(False, 0), (False, 2), (True, 1)]


def warc_record(kind, name, block, *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """One gzip member per record, ids that are no numbers, padding, no records at all."""
    plain = b"HTTP/1.1 200 OK\r\n\r\n"
    records = [
        warc_record("warcinfo", "urn:uuid:0", b"software: x"),
        warc_record("response", "urn:uuid:1", plain + b"one"),
        warc_record("revisit", "urn:uuid:2", plain, "WARC-Refers-To: <urn:uuid:1>"),
        warc_record("response", "urn:uuid:3", plain + b"tw", "WARC-Segment-Number: 1"),
        warc_record("continuation", "urn:uuid:4", b"o" * 2_000_000, "WARC-Segment-Number: 2",
                    "WARC-Segment-Origin-ID: <urn:uuid:3>",
                    f"WARC-Segment-Total-Length: {len(plain) + 2_000_002}"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)) + b"\0" * 9)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[1:3])))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    got = read_warc(spark, str(tmp_path)).collect()
    assert all(r.complete and r.page_id is None and r.refers_to is None for r in got)
    assert collections.Counter((r.record_type, r.refers_uri, len(r.payload or b"")) for r in got) == {
        ("warcinfo", None, 0): 1, ("response", None, 3): 2, ("revisit", "urn:uuid:1", 0): 2,
        ("response", None, 2_000_002): 1,
    }


@pytest.mark.parametrize(
    "damage", [lambda x: x[:-20], lambda x: x + b"\0\0rest", lambda x: gzip.compress(b"no record\r\n\r\n")]
)
def test_damaged_archives_are_errors(damage):
    data = damage(gzip.compress(warc_record("response", "n", b"x" * 5_000)))
    with pytest.raises((ValueError, zlib.error)):
        list(split_records(inflated(memoryview(data))))


def test_components_of_ids_of_any_size(spark):
    big = 2**62
    edges = [(big + i, big + i - i % 7) for i in range(700)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert all(r.label == r.node - (r.node - big) % 7 for r in got) and len(got) == 700


def test_near_duplicates_of_one_id(spark):
    """Thousands of rows under one id are documents of their own, compared by content alone."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(1_500)]
    near = [t + " more" for t in texts]
    docs = spark.createDataFrame([(1, t) for t in texts + near], "doc_id long, text string")
    found = near_duplicates(docs.repartition(8))
    assert found.count() == 3_000 and found.where("keep").count() == 1_500
    assert found.where("links = 1").count() == 3_000


def test_pipeline(spark):
    import corpus_pipeline

    docs, left = table(spark, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        left.append(docs.count())
        assert docs.columns == columns
    assert left == sorted(left, reverse=True) and left[-1] > 100
    assert corpus_pipeline.run(spark, SF).count() == left[-1]
