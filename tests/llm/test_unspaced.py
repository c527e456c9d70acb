"""Scripts without spaces, long runs, and short items: nothing is cut off or left out."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pmtspark.llm import toxicity
from pmtspark.llm.decontaminate import drop_leaks, edit_distance_within, find_leaks, plain
from pmtspark.llm.langid import identify_languages
from pmtspark.llm.text import RangeHash, script_words, text_slices
from pmtspark.llm.toxicity import GRAMS, pieces_of, subwords


def split(texts):
    out = []
    for s in text_slices(pa.array(texts)):
        p = plain(s)
        w = script_words(p)
        for r in range(s.rows):
            own = range(w.first[r], w.first[r + 1])
            out.append([p.data[w.start[i] : w.end[i]].tobytes().decode() for i in own])
    return out


def test_characters_of_unspaced_scripts_are_words():
    assert split(["Ab 日本語。テスト abc語d", "", "ไทย x", "한국 말", "𠀀𠀁y"]) == [
        ["ab", "日", "本", "語", "テ", "ス", "ト", "abc", "語", "d"], [],
        ["ไ", "ท", "ย", "x"], ["한국", "말"], ["𠀀", "𠀁", "y"],
    ]


CHINESE = "下列哪一种动物不是哺乳动物而是生活在水里的鱼类呢请选择"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_short_and_unspaced_items(spark, kind):
    near = CHINESE[:10] + "它" + CHINESE[11:]
    docs = spark.createDataFrame(
        [
            (1, "so What is dark matter? it says"), (2, f"前文在此。{CHINESE}后文"), (3, f"x{near}y"),
            (4, "what is dark energy"), (5, CHINESE[:8]), (6, None), (7, "matter dark is what"),
        ],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(
        [(1, "what is dark matter"), (2, CHINESE), (3, ""), (4, None), (5, "?!")],
        "item_id long, text string",
    ).withColumn("item_id", F.col("item_id").cast(kind))
    found = sorted((r.doc_id, int(r.item_id), r.edits) for r in find_leaks(docs, items).collect())
    assert found == [(1, 1, 0), (2, 2, 0), (3, 2, 1)]
    assert [r.doc_id for r in drop_leaks(docs, items).orderBy("doc_id").collect()] == [4, 5, 6, 7]


def test_leaks_equal_brute_force_edit_distance(spark):
    """Every document against every item by exact edit distance, planted edits included."""
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [list(rng.choice(vocabulary, n)) for n in (3, 6, 10, 17, 25, 40)]
    docs = []
    for d in range(120):
        text = list(rng.choice(vocabulary, int(rng.integers(0, 80))))
        if d % 2:
            own = list(items[d % len(items)])
            for _ in range(int(rng.integers(0, 1 + len(own) // 4))):
                at = int(rng.integers(0, len(own)))
                own[at : at + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary))] * int(rng.integers(0, 2))
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = own
        docs.append((d, " ".join(text)))
    code = {w: i for i, w in enumerate(vocabulary)}
    want = set()
    for d, text in docs:
        words = np.array([code[w] for w in text.split()], np.int64)
        for i, item in enumerate(items):
            edits, _ = edit_distance_within(np.array([code[w] for w in item]), words)
            if edits <= len(item) // 5:
                want.add((d, i, edits))
    found = find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"),
    )
    got = {(r.doc_id, r.item_id, r.edits) for r in found.collect()}
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    assert len(got & want) >= 0.98 * len(want) and len(want) > 50


@pytest.mark.parametrize("text", ["x" * 100 + "é" * 1500 + "toxic" + "語" * 700, "short words", "a" * 5000])
def test_every_byte_of_a_long_run_is_in_a_subword(monkeypatch, text):
    """The n-grams of a run that is cut are those of the whole run, each as often."""

    def grams(limit):
        monkeypatch.setattr(toxicity, "RUN_BYTES", limit)
        (s,) = text_slices(pa.array([text]))
        *parts, first = pieces_of(s)
        assert first.tolist() == [0, len(parts[0])]
        bucket, bounds = subwords(RangeHash(s.data), *parts)
        # a piece's own hash comes first
        own = np.ones(len(bucket), bool)
        own[bounds[:-1]] = False
        return collections.Counter(bucket[own].tolist()), len(parts[0])

    (cut, pieces), (whole, words) = grams(512), grams(1 << 20)
    assert cut == whole
    size = [len(w.encode()) for w in text.split()]
    assert words == len(size) and pieces >= sum(-(-n // 512) for n in size)
    assert sum(cut.values()) == sum(max(0, n - g + 1) for n in size for g in GRAMS)


def test_languages_without_spaces_are_learned(spark):
    """Two languages of one script, whose words are far over the length learned whole."""
    rng = np.random.default_rng(2)
    hans = ["".join(chr(0x4E00 + i) for i in rng.integers(low, low + 300, 400)) for low in (0, 250) for _ in range(60)]
    rows = [(i, t, "aa" if i < 60 else "bb") for i, t in enumerate(hans)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify_languages(docs).where("held_out").collect()
    right = [r.lang_pred == ("aa" if r.doc_id < 60 else "bb") for r in found]
    assert len(right) > 15 and np.mean(right) > 0.9
