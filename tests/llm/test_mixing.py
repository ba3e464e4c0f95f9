"""Mixing with many sources: numbers, targets and the two-storey splitting tree against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from ladle.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    names = [f"s{i:03d}.é" if i % 7 else f"S{i}" for i in range(150)] + [None, "", "\U0001F600", "￿"]
    out = []
    for i in range(3000):
        source = names[0] if rng.random() < 0.33 else rng.choice(names)  # one source holds a third
        text = None if i % 211 == 0 else " ".join(["w"] * int(rng.paretovariate(1.0) % 300))
        out.append((None if i % 500 == 0 else i, text, source, "clash"))
    return out


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Raise the level source by source: the one that fills first is taken out, until none does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        first = min(free, key=lambda s: cap * sizes[s] / weight[s])
        if cap * sizes[first] >= weight[first] * level:
            break
        target[first] = cap * sizes[first]
        left -= target[first]
        free.remove(first)
    return {s: target.get(s, weight[s] * level) for s in names}


def test_many_sources(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, shard_words=300).collect()
    sizes, taken, shards = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        for d in r.draws:
            shards[d.shard] += 1
    want = brute_targets(sizes)
    assert len(got) == len(rows) and len(sizes) > 100 and len(shards) > 20
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    nulls = Counter(s for i, _, s, _ in rows if i is None)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 + nulls[s], s  # rows with one id share a cut, in whole words
    again = mixing.mix(docs.repartition(7), shard_words=300).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("width", [1, 4, 100])
def test_every_draw_is_dealt_once(spark, width):
    rng = random.Random(width)
    numbers = {k: rng.choice([1, 2, 5, 40, 900]) for k in range(0, 60, 2)}  # numbers without draws are left out
    sources = spark.createDataFrame(list(numbers.items()), "k long, n long")
    got = mixing.deal_draws(sources, 17, 5, width).collect()
    assert sorted((r.k, r.rank) for r in got) == sorted((k, i) for k, n in numbers.items() for i in range(n))
    total = sum(numbers.values())
    per_shard = Counter(r.shard for r in got)
    assert [per_shard[i] for i in range(17)] == [total * (i + 1) // 17 - total * i // 17 for i in range(17)]
    for k in numbers:  # a source's ranks go up with the shards
        ranks = [r.shard for r in sorted((r for r in got if r.k == k), key=lambda r: r.rank)]
        assert ranks == sorted(ranks)


def test_a_part_of_the_tree_is_the_same_tree():
    quotas = [100, 7, 0, 3001, 12]
    edge = lambda i: 3120 * i // 23
    whole = list(mixing.split_quotas(quotas, edge, 23, [9]))
    assert [i for i, _, _ in whole] == list(range(23))
    for first, until in ((0, 1), (4, 11), (22, 23), (0, 23)):
        part = list(mixing.split_quotas(quotas, edge, 23, [9], first, until))
        assert [p[0] for p in part] == list(range(first, until))
        for (_, a, b), (_, c, d) in zip(part, whole[first:until]):
            assert np.array_equal(a, c) and np.array_equal(b, d)


def test_shares_are_hypergeometric():
    """Over many seeds a source's share of a shard has the mean and the variance of a hypergeometric sample."""
    seen = np.array([mixing.shard_quotas([60, 40], 2, 5, seed)[0][0] for seed in range(2000)])
    n, p, total = 20, 0.6, 100
    assert abs(seen.mean() - n * p) < 0.2
    assert abs(seen.var() / (n * p * (1 - p) * (total - n) / (total - 1)) - 1) < 0.15
