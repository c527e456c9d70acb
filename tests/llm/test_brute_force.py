"""Sums and draws of the training-data operators against plain enumeration."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from pmtspark.llm.langid import BYTE_PROBABILITY, Vocabulary, forward
from pmtspark.llm.mixing import (
    draw_without_return,
    permute,
    shard_counts,
    split_counts,
    targets,
)

PIECES = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba", "é", "▁é"]


def all_segmentations(word: bytes):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(bounds)]


@pytest.mark.parametrize("word", ["a", "ab", "ababab", "bbaab", "é", "aéxb", "xx"])
def test_forward_sums_all_segmentations(word):
    """A word starts with a marked piece, or with the mark and then inner pieces or single bytes."""
    v = Vocabulary(PIECES)
    rng = np.random.default_rng(len(word))
    p = np.vstack([rng.dirichlet(np.ones(v.size), 2).T, np.zeros((1, 2))])
    first = {t.encode(): i for i, t in enumerate(v.first)}
    inner = {t.encode(): len(v.first) + i for i, t in enumerate(v.inner)}
    mark, total = v.size - 1, np.zeros(2)

    def rest_of(parts):
        out = np.ones(2)
        for x in parts:
            step = p[inner[x]] if x in inner else np.zeros(2)
            out = out * (step + (BYTE_PROBABILITY if len(x) == 1 else 0.0))
        return out

    for parts in all_segmentations(word.encode()):
        if parts[0] in first:
            total += p[first[parts[0]]] * rest_of(parts[1:])
        total += p[mark] * rest_of(parts)
    data = np.frombuffer(word.encode(), np.uint8)
    got = forward(v, p, data, np.array([0]), np.array([len(data)]))[0]
    assert got == pytest.approx(np.log(total), rel=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_targets_fill_up_to_the_limit(seed):
    """Pouring by small drops, each by weight among the sources below their limit."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 200, 6).tolist()
    weights = [1, 2, 3, 1, 2, 3]
    filled, left, drop = [0.0] * 6, float(sum(sizes)), 0.01
    while left > 1e-9:
        open_ = [i for i in range(6) if filled[i] < 3 * sizes[i] - 1e-9]
        if not open_:
            break
        part = min(drop * sum(weights[i] for i in open_), left)
        share = part / sum(weights[i] for i in open_)
        for i in open_:
            filled[i] += share * weights[i]
        left -= part
    assert targets(sizes, weights) == pytest.approx(filled, abs=0.2)


def test_shards_take_all_slots_once():
    counts, shards, size = np.array([70, 0, 41, 9]), 6, 20
    drawn = [shard_counts(counts, shards, s, size, 3) for s in range(shards)]
    assert all(own.sum() == size for own, _ in drawn)
    assert (sum(own for own, _ in drawn) == counts).all()
    for s, (_, before) in enumerate(drawn):
        assert (before == sum((own for own, _ in drawn[:s]), np.zeros(4, int))).all()
    for n in (1, 2, 7, 100, 1000):
        assert sorted(permute(np.arange(n), n, 5)) == list(range(n))


def test_shard_counts_follow_the_multinomial():
    """Mean and spread of a source's slots in a shard, drawn without return."""
    counts, shards, size = np.array([30, 90]), 4, 30
    own = [shard_counts(counts, shards, 1, size, seed)[0][0] for seed in range(2_000)]
    p = 30 / 120
    spread = math.sqrt(size * p * (1 - p) * (120 - size) / 119)
    assert np.mean(own) == pytest.approx(size * p, abs=0.2)
    assert np.std(own) == pytest.approx(spread, rel=0.1)


def test_draws_without_return_at_any_size():
    """Against exact probabilities where they can be listed, against moments where not."""
    rng = np.random.default_rng(6)
    for own, other, left in [(7, 9, 5), (40, 300, 100), (3, 100_000, 50_000), (6, 2, 7), (5, 0, 3)]:
        drawn = np.array([draw_without_return(own, other, left, rng) for _ in range(20_000)])
        values = range(max(0, left - other), min(own, left) + 1)
        p = np.array([float(Fraction(math.comb(own, k) * math.comb(other, left - k), math.comb(own + other, left))) for k in values])
        seen = np.array([(drawn == k).sum() for k in values])
        assert seen.sum() == len(drawn)
        assert (np.abs(seen - p * len(drawn)) < 5 * np.sqrt(p * (1 - p) * len(drawn)) + 3).all()
    own, other, left = 3 * 10**12, 7 * 10**12, 5 * 10**12
    drawn = np.array([draw_without_return(own, other, left, rng) for _ in range(20_000)], float)
    z = (drawn - 1.5e12) / (left * 0.3 * 0.7 * 0.5) ** 0.5
    assert abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.05 and abs((z**4).mean() - 3) < 0.35
    counts = np.array([4 * 10**12, 0, 10**9, 7])
    part = split_counts(counts, 2 * 10**12, rng)
    assert part.sum() == 2 * 10**12 and (part <= counts).all() and (part >= 0).all()
