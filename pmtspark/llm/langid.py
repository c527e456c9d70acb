"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pmtspark.llm.text import (
    HashIndex,
    PrefixMatrix,
    RangeHash,
    hash_strings,
    held_out,
    learning_row,
    runs,
    split_words,
    text_slices,
    word_ranges,
)

MARK = "▁"  # in the vocabulary, the start of a word
RUN_BYTES = 512
LEARNED_BYTES = 48
BYTE_PROBABILITY = 1e-7
CACHE_WORDS = 400_000
FIRST = np.uint64(0xABCDEF)  # marks the keys of pieces that start a word


def read_pieces(path: str) -> list[str]:
    """Pieces of a SentencePiece model, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [model.id_to_piece(i) for i in ids if not special(i)]


class Vocabulary:
    """Pieces that start a word (mark taken off) and pieces inside words."""

    def __init__(self, pieces: list[str]):
        plain = [p for p in pieces if p.replace(MARK, "")]
        self.first = [p[1:] for p in plain if p.startswith(MARK) and MARK not in p[1:]]
        self.inner = [p for p in plain if MARK not in p]
        texts = self.first + self.inner
        keys = hash_strings(texts)
        keys[: len(self.first)] ^= FIRST
        self.size = len(texts) + 1  # the last is the mark alone
        self.index = HashIndex(keys)
        self.longest = max(len(t.encode()) for t in texts)
        lengths = {len(t.encode()) for t in texts}
        self.lengths = sorted(lengths)

    def find(self, hashes: RangeHash, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Piece inside a word on each byte range, or -1."""
        return self.index.find(hashes.of(start, end))

    def find_first(self, hashes: RangeHash, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.index.find(hashes.of(start, end) ^ FIRST)


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    pieces: np.ndarray  # probability of each piece (rows) in each language; one more row, zero


def forward(
    vocabulary: Vocabulary,
    probability: np.ndarray,
    data: np.ndarray,
    start: np.ndarray,
    end: np.ndarray,
) -> np.ndarray:
    """Log probability of byte ranges in each language, all segmentations summed.

    ``probability`` has a row for each piece and a zero row at the end. Words stand in the
    columns of a matrix, longest first, so position by position all that are long enough
    are worked on at once. The sums of the last positions are kept in a ring, scaled anew
    before they become too small.
    """
    order = np.argsort(start - end, kind="stable")  # longest first
    start, length = start[order], (end - start)[order]
    n, langs = len(start), probability.shape[1]
    out = np.empty((n, langs))
    if not n:
        return out
    prefix = PrefixMatrix(data, start, length)
    ring = vocabulary.longest + 1
    sums = np.zeros((ring, n, langs))
    scale = np.zeros((n, langs))
    sums[0] = probability[vocabulary.size - 1]
    for i in range(1, int(length[0]) + 1):
        active = int(np.searchsorted(-length, -i, "right"))
        total = sums[(i - 1) % ring, :active] * BYTE_PROBABILITY
        for k in vocabulary.lengths:
            if k > i:
                break
            keys = prefix.of(i - k, i, active)
            at, piece = vocabulary.index.hits(keys)
            if len(at):
                total[at] += sums[(i - k) % ring, at] * probability[piece]
            if k == i:
                at, piece = vocabulary.index.hits(keys ^ FIRST)
                if len(at):
                    total[at] += probability[piece] * np.exp(-scale[at])
        sums[i % ring, :active] = total
        small = np.flatnonzero(total.max(axis=1) < 1e-100)
        if len(small):
            most = np.maximum(total[small], 1e-300)
            sums[:, small] /= most
            scale[small] += np.log(most)
        done = np.flatnonzero(length[:active] == i)
        out[order[done]] = np.log(np.maximum(sums[i % ring, done], 1e-300)) + scale[done]
    return out


def expectation(
    vocabulary: Vocabulary,
    probability: np.ndarray,
    matches: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
    length: np.ndarray,
    count: np.ndarray,
) -> np.ndarray:
    """Expected number of uses of each piece, over all segmentations of counted words."""
    word, begin, end, piece = matches
    n, longest = len(length), int(length.max())
    p = probability[piece]
    up = np.zeros((longest + 1, n))
    down = np.zeros((longest + 1, n))
    up[0] = 1
    down[length, np.arange(n)] = 1
    by_end = np.searchsorted(end, np.arange(longest + 2))
    for i in range(longest + 1):  # a match of width 0 is the bare mark, at position 0
        at = slice(by_end[i], by_end[i + 1])
        if i:
            up[i] = np.bincount(word[at], up[begin[at], word[at]] * p[at], n)
            up[i] += up[i - 1] * BYTE_PROBABILITY
    order = np.argsort(-begin, kind="stable")
    by_begin = np.searchsorted(-begin[order], -np.arange(longest, -2, -1))
    for j, i in enumerate(range(longest, -1, -1)):
        at = order[by_begin[j] : by_begin[j + 1]]
        # of no matches, the counts would be whole numbers
        add = np.bincount(word[at], down[end[at], word[at]] * p[at], n).astype(float)
        if i < longest:
            add += down[i + 1] * BYTE_PROBABILITY
        down[i] = np.where(length == i, 1, add)
    whole = np.maximum(up[length, np.arange(n)], 1e-300)
    use = up[begin, word] * p * down[end, word] / whole[word] * count[word]
    return np.bincount(piece, use, vocabulary.size)


def find_matches(vocabulary: Vocabulary, words: list[str]):
    """All pieces on all byte ranges of the words, by end: (word, begin, end, piece)."""
    parts = [w.encode() for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(length) - length
    hashes, found = RangeHash(data), []
    for k in vocabulary.lengths:
        for b in range(int(length.max()) - k + 1):
            w = np.flatnonzero(length >= b + k)
            if not len(w):
                break
            for first in (False, True) if b == 0 else (False,):
                look = vocabulary.find_first if first else vocabulary.find
                piece = look(hashes, start[w] + b, start[w] + b + k)
                hit = np.flatnonzero(piece >= 0)
                found.append((w[hit], np.full(len(hit), b), np.full(len(hit), b + k), piece[hit]))
    word, begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    return (word[order], begin[order], end[order], piece[order]), length


def learn(
    docs: DataFrame,
    pieces: list[str],
    docs_per_language: int = 200,
    max_words: int = 400_000,
    max_languages: int = 1000,
    rounds: int = 4,
) -> LanguageModel:
    """Piece probabilities of each language by expectation-maximisation.

    Learns from rows of known language that ``learning_row`` allows: about
    ``docs_per_language`` texts a language, and of their words the ``max_words`` that are
    most frequent; these bound what the driver gets. Words over LEARNED_BYTES, which languages
    without spaces mostly have, are cut into parts of whole characters, and all parts count.
    """
    rows = docs.where(learning_row(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return LanguageModel([], np.zeros(0), np.zeros((0, 0)))
    languages = [r["lang"] for r in sizes]
    counts = np.array([r["count"] for r in sizes], float)
    # one scan for all languages: each has a share of its own
    shares = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(docs_per_language / r["count"]))]
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(drawn < F.element_at(F.create_map(*shares), F.col("lang")))
    word = F.explode(split_words(F.lower("text"))).alias("word")
    long = F.octet_length("word") > LEARNED_BYTES
    parts = F.regexp_extract_all("word", F.lit(f"(?s).{{1,{LEARNED_BYTES // 4}}}"), F.lit(0))
    words = (
        sample.select("lang", word)
        .select("lang", F.explode(F.when(long, parts).otherwise(F.array("word"))).alias("word"))
        .groupBy("lang", "word")
        .count()
        .orderBy(F.desc("count"), "lang", "word")
        .limit(max_words)
        .toPandas()
    )
    vocabulary = Vocabulary(pieces)
    table = np.zeros((vocabulary.size + 1, len(languages)))
    mark = vocabulary.size - 1
    for k, lang in enumerate(languages):
        own = words[words["lang"] == lang]
        p = np.full(vocabulary.size, 1 / vocabulary.size)
        if len(own):
            matches, length = find_matches(vocabulary, own["word"].tolist())
            count = own["count"].to_numpy(float)
            inner = (matches[1] == 0) & (matches[3] >= len(vocabulary.first))
            for _ in range(rounds):
                # an inner piece at the start follows the bare mark
                q = np.append(p, 0.0)
                q_start = expectation_start(vocabulary, q, matches, inner, length, count, mark)
                p = (q_start + 0.01) / (q_start + 0.01).sum()
        table[:-1, k] = p
    return LanguageModel(languages, np.log(counts / counts.sum()), table)


def expectation_start(vocabulary, q, matches, inner, length, count, mark):
    """``expectation`` with the bare mark before an inner piece that starts a word."""
    word, begin, end, piece = matches
    # a copy of each such piece has the probability of the mark and the piece together
    joint = np.concatenate([q[:-1], q[piece[inner]] * q[mark]])
    alias = piece.copy()
    alias[inner] = vocabulary.size + np.arange(inner.sum())
    wide = type("Sized", (), {"size": len(joint)})
    use = expectation(wide, joint, (word, begin, end, alias), length, count)
    out = use[: vocabulary.size].copy()
    extra = use[vocabulary.size :]
    np.add.at(out, piece[inner], extra)
    out[mark] += extra.sum()
    return out


class WordScores:
    """Scores of words by hash; keeps those of up to CACHE_WORDS words for later slices."""

    def __init__(self, vocabulary: Vocabulary, model: LanguageModel):
        self.vocabulary, self.model = vocabulary, model
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(model.languages)))

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = RangeHash(data)
        keys, at, back = np.unique(hashes.of(start, end), return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        values = np.empty((len(keys), len(self.model.languages)))
        if known.any():
            values[known] = self.values[spot[known]]
        new = np.flatnonzero(~known)
        values[new] = forward(
            self.vocabulary, self.model.pieces, data, start[at[new]], end[at[new]]
        )
        if len(self.keys) + len(new) <= CACHE_WORDS:
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.values = np.insert(self.values, where, values[new], axis=0)
        return values[back]


def predict(docs: DataFrame, model: LanguageModel, pieces: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text; only the text is used.

    ``score`` is the posterior of the predicted language. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if no language was learned. A run
    of over RUN_BYTES bytes without white space is summed in parts of that length.
    """
    languages = pa.array([*model.languages, "und"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(Vocabulary(pieces), model) if model.languages else None
        for batch in batches:
            best = np.full(batch.num_rows, len(model.languages))
            share = np.zeros(batch.num_rows)
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            for s in text_slices(batch.column("text")) if words else ():
                start, end, first = word_ranges(s)
                start, end, owner = runs(start, end, s.data, RUN_BYTES)
                row = (np.searchsorted(first, np.arange(first[-1]), "right") - 1)[owner]
                value = words.of(s.data, start, end)
                total = np.stack(
                    [np.bincount(row, v, s.rows) for v in value.T], axis=1
                ) + model.prior
                here = slice(s.first, s.first + s.rows)
                top = total.argmax(axis=1)
                gap = total - total[np.arange(s.rows), top][:, None]
                best[here] = np.where(letter[here], top, len(model.languages))
                share[here] = np.where(letter[here], 1 / np.exp(gap).sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    languages.take(pa.array(best)),
                    pa.array(share),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.lower("text").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def identify_languages(
    docs: DataFrame, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model", **bounds: int
) -> DataFrame:
    """Learn from the allowed rows of ``docs`` and predict all of them, one row per row.

    Columns used: doc_id, text, lang (to learn only). Rows of null id are never learned
    from. Repeated rows have equal results. An empty table gives an empty result.
    """
    pieces = read_pieces(vocabulary)
    return predict(docs, learn(docs, pieces, **bounds), pieces)
