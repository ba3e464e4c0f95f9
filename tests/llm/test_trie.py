"""The conversation trie against a brute-force trie of Python tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladle.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, a string, conv int, depth string, total string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
            if d:
                children[full[c][:d - 1]].add(full[c][:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -99, len(m), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if full[c] == k).encode()).hexdigest()) for k, m in members.items())


def result(df):
    assert df.columns == ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[:2]) + (-99 if r.parent is None else r.parent,) + tuple(r[3:]) for r in df.collect())


def random_rows(seed, n=120):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(300), n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None]),
                         rng.choice(["hi there", "a b  c\td", "", None, "hi", f"{c % 4} x"]), "x", 0, "y", "z"))
    return rows + rng.sample(rows, 10)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_every_shape_of_spine(spark):
    """One very long conversation, a common first turn, exact copies, conversations that end inside others."""
    rows = [(0, t, "user", f"t{t}", "x", 0, "y", "z") for t in range(150)]
    rows += [(20 * i, t, "user", f"t{t}", "x", 0, "y", "z") for i in range(1, 12) for t in range(i)]
    rows += [(1000 + i, t, "user", "same", "x", 0, "y", "z") for i in range(60) for t in range(2)]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for shard_rows in (1, 7, 1 << 17):
        assert result(trie.prefix_trie(df, shard_rows=shard_rows)) == want


def test_no_rows_null_ids_long_text_turnless(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    short = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 1)
    rows = [(None, 0, "user", "dropped", "x", 0, "y", "z"), (short, 0, "user", "w " * 50000, "x", 0, "y", "z")]
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)  # no base: it has no turn left
    assert brute(rows)[0][1:4] == (0, -99, 1) and len(brute(rows)) == 1


def test_colliding_digests_are_drawn_anew(spark, monkeypatch):
    rows, real, seeds = random_rows(7, 30), trie._digests, []

    def digests(turns, seed):
        seeds.append(seed)
        return real(turns, seed) if seed > 1 else real(turns, seed).withColumns({"a": F.lit(5).cast("long"), "b": F.lit(5).cast("long")})

    monkeypatch.setattr(trie, "_digests", digests)
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and seeds == [1, 2]


def test_pieces_of_ids_are_hashed_in_order(spark):
    ids = list(range(-5, 40)) + [10 ** 12]
    df = spark.createDataFrame([(1, 1, c, 0, 0) for c in ids] + [(2, 1, 3, 0, 0)], "a long, b long, conv long, depth long, total long")
    got = {r.a: r.ends_sha256 for r in trie.ends_sha256(df, piece_ids=4).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"3").hexdigest()}


def test_node_table_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        a, b = rng.integers(-2 ** 62, 2 ** 62, n), rng.integers(-2 ** 62, 2 ** 62, n)
        t = trie.NodeTable(a, b)
        assert sorted(t.find(a, b)) == list(range(n))
        assert (t.find(a, b + 1) == -1).all()
    with pytest.raises(ValueError):
        trie.NodeTable(np.array([1, 1]), np.array([2, 2]))
