"""Conversation prefix trie over a minimal-perfect-hash node table.

Nodes are distinct prefixes of conversations (role and text of every turn), the root being the empty one.

1. A prefix digest is the sum, modulo 2^32 in each of four limbs, of hashes of (depth, turn): a running sum over the
   turns of a conversation, cut into range slices so that one very long conversation spans many tasks.  Digests are
   verified: all rows of one must agree on depth, parent digest and SHA-256 of the last turn, which by induction makes
   the prefixes equal; else all digests are drawn anew from another seed.
2. Nodes are counted by digest.  The rows below a node are known from the lengths of its members.  Nodes with more than
   a shard's share of all rows below them are the *spine*, closed upwards; every other node belongs to the subtree of
   its topmost ancestor outside the spine.  Subtrees are dealt whole to shards.
3. A shard enumerates its digests, gives each a slot by a minimal perfect hash (levels of bit arrays, ranks by popcount;
   the digest kept at a slot is compared at every look-up), scatters counts into flat numpy arrays by slot, and
   accumulates leaves and savings through the array of parent slots, deepest nodes first.
4. The spine has one row per node of its own plus the totals of the subtrees that hang from it; it is summed by pointer
   doubling: as many rounds as its depth has binary digits, whatever its width.

``ends_sha256`` needs the member ids of a node in order: slices of the sorted ids are joined to pieces of text in
parallel, and a task only hashes the pieces of a node in a row.

Defined cases: turns are ordered by number, null first, then by the SHA-256 of role and text; equal rows are turns of
their own.  A null role or text is empty.  Rows with a null conversation id belong to no conversation and are dropped.
``%`` keeps the sign of a negative id.  No rows give no nodes, not even a root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import running_sum
from .common import fits_broadcast, shuffle_partitions, ship, stage, unstage, words

DIGEST, PARENT = ["a", "b"], ["pa", "pb"]
LIMB = 1 << 32
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --------------------------------------------------------------------- the table of a shard
def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of two longs."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed * 0x632BE59BD9B4E019 % 2 ** 64)
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x


class NodeTable:
    """Slots 0 to n - 1 of n distinct digests, without gaps; foreign digests are told by the kept keys."""

    def __init__(self, a: np.ndarray, b: np.ndarray, load: float = 2.0):
        self.levels, offset, left = [], 0, np.arange(len(a))
        while len(left):
            seed = len(self.levels)
            size = max(1, int(load * len(left)))
            at = (_mixed(a[left], b[left], seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            rank = offset + np.cumsum(alone) - alone
            self.levels.append((seed, size, alone, rank))
            offset += int(alone.sum())
            left = left[~alone[at]]
            if seed > 400:
                raise ValueError("digests are not distinct")
        self.a, self.b = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b
        if (self.a[slots] != a).any() or (self.b[slots] != b).any():
            raise ValueError("two digests share a slot")

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for seed, size, alone, rank in self.levels:
            at = (_mixed(a[left], b[left], seed) % np.uint64(size)).astype(np.int64)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where the table has no such digest."""
        slots = self._slots(a, b)
        if len(self.a):
            slots[(self.a[slots] != a) | (self.b[slots] != b)] = -1
        return slots


SHARD = "a long, b long, pa long, pb long, conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, " \
    "saved_tokens long, top boolean"


def _accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Children, leaves and savings of whole subtrees, as flat arrays by slot; ``top`` marks their roots."""
    a, b = nodes["a"].to_numpy(), nodes["b"].to_numpy()
    table = NodeTable(a, b)
    slot, n = table.find(a, b), len(nodes)
    parent = np.full(n, -1, dtype=np.int64)
    parent[slot] = table.find(nodes["pa"].to_numpy(), nodes["pb"].to_numpy())
    depth, conv, members, saved = (np.zeros(n, dtype=np.int64) for _ in range(4))
    depth[slot], conv[slot], members[slot] = nodes["depth"], nodes["conv"], nodes["n_convs"]
    parent[depth == 0] = -1  # the root's parent digest is its own
    saved[slot] = (nodes["n_convs"] - 1) * nodes["n_words"]
    inner = np.flatnonzero(parent >= 0)
    children = np.bincount(parent[inner], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pd.Series(conv[parent], dtype="Int64").mask(parent < 0)
    return pd.DataFrame({"a": a, "b": b, "pa": nodes["pa"], "pb": nodes["pb"], "conv": nodes["conv"], "depth": nodes["depth"],
                         "parent": above.to_numpy()[slot], "n_convs": nodes["n_convs"], "n_children": children[slot],
                         "n_leaves": leaves[slot], "saved_tokens": saved[slot], "top": parent[slot] < 0})


# --------------------------------------------------------------------- prefixes
def _narrow(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, sha, n_words) of every turn: all that the trie needs of its text."""
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256).alias("sha"),
        F.size(words(said)).cast("long").alias("n_words"))


def rebuilt(turns: DataFrame, family: int, head: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth from 1, sha, n_words, total) and conversations (conv, total) after the rebuilding: a conversation
    c starts with the first h turns of c - c % family, h = crc32 of its decimal id modulo ``head``, then has its own turns
    after its first h."""
    at = stage(running_sum(turns, ["conv"], ["turn", "sha"], F.lit(1).cast("long"), "pos"), "trie-turns")
    heads = at.where(F.col("pos") < head - 1).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "sha", "n_words"))).alias("head"))  # at most head - 1 entries
    convs = at.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({
        "base": F.col("conv") - F.col("conv") % family, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % head})
    head_part = F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = convs.join(heads, "base", "left").withColumn("taken", head_part).withColumn(
        "total", F.size("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = stage(convs.select("conv", "h", "taken", F.col("total").cast("long").alias("total")), "trie-conversations")
    first = convs.select("conv", "total", F.explode("taken").alias("t")).select(
        "conv", (F.col("t.pos") + 1).alias("depth"), "t.sha", "t.n_words", "total")
    rest = at.join(convs.select("conv", "h", F.size("taken").alias("t"), "total"), "conv").where(F.col("pos") >= F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("t") + 1).alias("depth"), "sha", "n_words", "total")
    return first.unionByName(rest), convs.select("conv", "total")


def _digests(turns: DataFrame, seed: int) -> DataFrame:
    """(conv, depth, a, b, pa, pb, sha, n_words, total): digest of the prefix that ends with each turn, and its parent's."""
    limbs = [f"_l{i}" for i in range(4)]
    for i in (0, 2):
        h = F.xxhash64(F.lit(seed), F.lit(i), F.col("depth"), F.col("sha"))
        turns = turns.withColumns({limbs[i]: F.shiftrightunsigned(h, 32), limbs[i + 1]: h.bitwiseAND(F.lit(LIMB - 1))})
    sums = running_sum(turns, ["conv"], ["depth"], [F.col(x) for x in limbs], [f"{x}s" for x in limbs])

    def joined(hi: Column, lo: Column) -> Column:
        return F.shiftleft(hi % LIMB, 32).bitwiseOR(lo % LIMB)

    before, after = [F.col(f"{x}s") for x in limbs], [F.col(f"{x}s") + F.col(x) for x in limbs]
    return sums.select("conv", "depth", joined(*after[:2]).alias("a"), joined(*after[2:]).alias("b"),
                       joined(*before[:2]).alias("pa"), joined(*before[2:]).alias("pb"), "sha", "n_words", "total")


def _nodes(prefixes: DataFrame) -> DataFrame:
    """One row per digest, with ``same``: whether all its rows are the same prefix."""
    same = F.lit(True)
    for c in ("depth", "pa", "pb", "sha"):
        same = same & (F.min(c) == F.max(c))
    return prefixes.groupBy(*DIGEST).agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"),
        F.sum(F.col("total") - F.col("depth") + 1).alias("below"), same.alias("same"))


def _prefixes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix rows and verified nodes, the root included."""
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), *[zero.alias(c) for c in DIGEST + PARENT], F.lit("").alias("sha"),
                        zero.alias("n_words"), "total")
    for seed in range(1, 100):
        prefixes = stage(_digests(turns, seed).unionByName(root), "trie-prefixes")
        nodes = stage(_nodes(prefixes), "trie-nodes")
        if nodes.where(~F.col("same")).isEmpty():
            return prefixes, nodes
        unstage(prefixes, nodes)
    raise RuntimeError("no seed gives distinct digests")


# --------------------------------------------------------------------- subtrees and spine
def _small(table: DataFrame) -> DataFrame:
    """Marked for broadcast only if its rows are counted to be few."""
    return F.broadcast(table) if fits_broadcast(table, 96) else table


def _subtree_roots(prefixes: DataFrame, spine: DataFrame) -> DataFrame:
    """(conv, root): digest of the topmost prefix of each conversation outside the spine."""
    mark = _small(spine).select(*DIGEST, F.lit(True).alias("in_spine"))
    outside = prefixes.join(mark, DIGEST, "left").where(F.col("in_spine").isNull())
    return outside.groupBy("conv").agg(F.min_by(F.struct(*DIGEST), "depth").alias("root"))


def _spine_sums(spine: DataFrame, hanging: DataFrame) -> DataFrame:
    """The spine's nodes with their totals, from those of the subtrees that hang from it."""
    below = hanging.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("c1"), F.sum("n_leaves").alias("l1"), F.sum("saved_tokens").alias("s1"))
    inside = spine.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("c2"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = F.col("depth") > 0
    state = stage(spine.join(below, DIGEST, "left").join(inside, DIGEST, "left").select(
        *spine.columns, (n("c1") + n("c2")).alias("n_children"),
        (n("l1") + F.when(n("c1") + n("c2") == 0, 1).otherwise(0)).alias("n_leaves"),
        (n("s1") + (F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
        F.when(has, F.col("pa")).alias("ua"), F.when(has, F.col("pb")).alias("ub")), "trie-spine")
    while not state.where(F.col("ua").isNotNull()).isEmpty():
        sent = state.where(F.col("ua").isNotNull()).groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        higher = _small(state).select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("ua").alias("na"), F.col("ub").alias("nb"))
        up = state.join(sent, DIGEST, "left").join(higher, ["ua", "ub"], "left")
        new = stage(up.select(*[c for c in state.columns if c not in ("n_leaves", "saved_tokens", "ua", "ub")],
                              (F.col("n_leaves") + n("l")).alias("n_leaves"), (F.col("saved_tokens") + n("s")).alias("saved_tokens"),
                              F.col("na").alias("ua"), F.col("nb").alias("ub")), "trie-spine")
        unstage(state)
        state = new
    return state


def ends_sha256(prefixes: DataFrame, piece_ids: int = 4096) -> DataFrame:
    """(a, b, ends_sha256) of the nodes that a conversation ends at."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids = None, []
        for batch in batches:
            rows = []
            for a, b, conv in zip(batch["a"], batch["b"], batch["conv"]):
                if ids and (key != (a, b) or len(ids) == piece_ids):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = (a, b)
                ids.append(conv)
            yield pd.DataFrame(rows, columns=["a", "b", "first", "piece"])
        if ids:
            yield pd.DataFrame([(*key, ids[0], ",".join(map(str, ids)))], columns=["a", "b", "first", "piece"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            rows = []
            for a, b, piece in zip(batch["a"], batch["b"], batch["piece"]):
                if key == (a, b):
                    state.update(b",")
                else:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(rows, columns=["a", "b", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["a", "b", "ends_sha256"])

    n = shuffle_partitions(prefixes.sparkSession)
    ends = prefixes.where("depth = total").select(*DIGEST, "conv").repartitionByRange(n, *DIGEST, "conv")
    cut = ends.sortWithinPartitions(*DIGEST, "conv").mapInPandas(pieces, "a long, b long, first long, piece string")
    return cut.repartition(n, *DIGEST).sortWithinPartitions(*DIGEST, "first").mapInPandas(hashes, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                family: int = 20, head: int = 4, shard_rows: int = 1 << 17) -> DataFrame:
    """One row per node: conv (smallest member), depth, parent (the parent's conv, null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  A shard has ``shard_rows`` prefix rows below each of its subtrees at most, and
    at most a shuffle partition's share of all."""
    spark = turns.sparkSession
    ship(spark)
    prefixes, nodes = _prefixes(*rebuilt(_narrow(turns, conv_col, turn_col, role_col, text_col), family, head))
    parts = shuffle_partitions(spark)
    total = prefixes.count()
    share = min(shard_rows, max(1, -(-total // parts)))
    spine = stage(nodes.where(F.col("below") > share).drop("below", "same"), "trie-spine-nodes")
    light = nodes.where(F.col("below") <= share).join(_subtree_roots(prefixes, spine), "conv")
    shards = max(parts, -(-total // shard_rows))
    dealt = light.select(*DIGEST, *PARENT, "conv", "depth", "n_convs", "n_words", F.pmod(F.xxhash64("root.a", "root.b"), F.lit(shards)).alias("shard"))
    summed = stage(dealt.groupBy("shard").applyInPandas(lambda nodes: _accumulate(nodes), SHARD), "trie-subtrees")
    top = _spine_sums(spine, summed.where("top"))

    done = ["a", "b", "pa", "pb", "conv", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = summed.where(~F.col("top")).select(*done, "parent")
    names = _small(spine).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    outer = summed.where("top").select(*done).unionByName(top.select(*done))
    outer = outer.join(names, PARENT, "left").withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))).select(*done, "parent")
    every = inner.unionByName(outer).join(ends_sha256(prefixes), DIGEST, "left")
    return every.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
