"""MinHash near-duplicate removal with sequential Bayesian verification.

1.  Every text becomes the set of its distinct word shingles (64-bit hashes)
    and a MinHash signature of ``bands * rows`` values.  Texts with the same
    set are one *node*, however many copies there are.
2.  Nodes that agree on a whole band share a bucket.  Pairs are not expanded
    inside buckets: each member is first paired with a few leaders of its
    bucket (linear in the members, however large the bucket).
3.  Sequential Bayesian verification: the signatures of a pair are compared
    batch by batch; after each batch the pair is dropped as soon as the
    posterior probability that its similarity reaches the threshold (uniform
    prior, so a Beta posterior) falls below ``miss``.
4.  Survivors are verified on the full shingle sets, and links become
    components (large-star / small-star).
5.  Completion: a pair that shares a bucket but still lies in two components
    may be an unseen link.  Buckets that hold more than one component are
    compared in full across components, in blocks of bounded size, by steps 3
    and 4.  So every pair of nodes that shares a band is either tested or
    already connected; no bucket size is capped.

At similarity ``s`` a pair shares no band with probability
``(1 - s ** rows) ** bands``: 8e-7 at 0.85 with 24 bands of 5 rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, shuffle_partitions, stage, trimmed, unstage

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text.

    Words are maximal runs without space and U+0009 to U+000D, A-Z in lower
    case (exactly what ``bytes.lower`` and ``bytes.split`` do).  A text with
    fewer than ``k`` words gives its whole sequence as one shingle, a text
    without words the empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    with np.errstate(over="ignore"):
        s = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            s = _mixed(s * _MIX[0] + h[j:n - k + 1 + j])
    return np.unique(s)


@functools.lru_cache(maxsize=8)
def _family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**64, (size, 1), np.uint64, endpoint=False) | np.uint64(1),
            rng.integers(0, 2**64, (size, 1), np.uint64, endpoint=False))


def signature(shingles: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """MinHash signature (32-bit values); long sets go through in slices."""
    a, b = _family(size, seed)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            v = shingles[None, i:i + 4096] * a
            v += b
            v >>= np.uint64(32)
            out = np.minimum(out, v.min(axis=1).astype(np.uint32))
    return out


def prune_table(size: int, threshold: float, miss: float) -> np.ndarray:
    """``t[n]``: the fewest matches among ``n`` compared hashes with which a pair stays.

    With a uniform prior, ``P(similarity >= threshold | m of n match)`` is the
    upper tail of Beta(m + 1, n - m + 1), that is
    ``P(Binomial(n + 1, threshold) <= m)``.
    """
    out = np.zeros(size + 1, np.int64)
    for n in range(1, size + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                             + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, table: np.ndarray, batch: int) -> np.ndarray:
    """Indices of the signature pairs (rows of a and b) that no batch prunes."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i in range(0, a.shape[1], batch):
        j = min(i + batch, a.shape[1])
        matches = matches + (a[alive, i:j] == b[alive, i:j]).sum(axis=1)
        stay = matches >= table[j]
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, count, sig = [], [], []
            for text in pdf["t"]:
                s = shingle_set(text, k)
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                count.append(len(s))
                sig.append(signature(s, size).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "node": node, "n": count, "sig": sig})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).mapInPandas(
        trimmed(run), f"id {kind}, h long, node binary, n long, sig binary")


def _fits(a: str, b: str, pct: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return (100 * F.least(a, b)) >= pct * F.greatest(a, b)


def _pruned(pairs: DataFrame, nodes: DataFrame, table: np.ndarray, batch: int) -> DataFrame:
    """Pairs (a, b) of nodes that survive the sequential Bayesian test."""
    sig = nodes.select("node", "sig")
    both = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["sa"]), np.uint32).reshape(len(pdf), -1)
                y = np.frombuffer(b"".join(pdf["sb"]), np.uint32).reshape(len(pdf), -1)
                yield pdf.iloc[surviving(x, y, table, batch)][["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(trimmed(run), "a binary, b binary")


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, s): the shingle set of each wanted node, from the text of its smallest id (staged)."""
    needed = stage(wanted.distinct().join(nodes.select("node", "id"), "node"), "needed")
    keys = F.broadcast(needed) if fits_broadcast(needed, 64) else needed
    texts = docs.select(F.col(id_col).alias("at"), F.col(text_col).alias("t")).join(
        keys, F.col("at").eqNullSafe(F.col("id"))).select("node", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, kept = [], []
            for h, text in zip(pdf["node"], pdf["t"]):
                s = shingle_set(text, k).tobytes()
                if xxhash.xxh3_128_digest(s) == h:  # another row with this id is another text
                    node.append(h)
                    kept.append(s)
            yield pd.DataFrame({"node": node, "s": kept}, dtype=object)

    found = stage(texts.mapInPandas(trimmed(run), "node binary, s binary").dropDuplicates(["node"]), "sets")
    unstage(needed)
    return found


def _reaches(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= pct * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int,
              pct: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold (``pairs`` is staged)."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    found = _sets(wanted, nodes, docs, id_col, text_col, k)
    both = (pairs.join(found.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
            .join(found.select(F.col("node").alias("b"), F.col("s").alias("y")), "b"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [_reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), pct)
                  for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    links = stage(both.select("a", "b", "x", "y").mapInPandas(trimmed(exact), "a binary, b binary"), "links")
    unstage(found)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the smallest node of its component.

    Alternating large-star and small-star steps until no edge changes.  Each
    step aggregates edges by node with partial sums, so a node with very many
    links is combined before the shuffle.
    """
    edges = stage(links.filter(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct())
        # small star: every node and its smaller neighbours point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct())
        after = stage(small, "edges")
        unstage(edges)
        edges = after
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


GROUP = ["bucket", "p", "q"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows sorted by ``GROUP``, one at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[GROUP].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        for x, y in zip(cuts, cuts[1:]):
            if held and tuple(keys[x]) != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[x:y])
            last = tuple(keys[x])
    if held:
        yield pd.concat(held, ignore_index=True)


def _open_pairs(g: pd.DataFrame, table: np.ndarray, batch: int, pct: int, rows: int,
                label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the members of other components that sequential testing leaves to it.

    A pair that shares several bands is tested in the first of them only.
    ``label`` is read anew for each member, so it may be merged meanwhile.
    """
    n = g["n"].to_numpy()
    sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), -1)
    band, p, q = int(g["band"].iloc[0]), int(g["p"].iloc[0]), int(g["q"].iloc[0])
    left, right = np.flatnonzero(g["own"] == p), np.flatnonzero(g["own"] == q)
    for i in left:
        j = right[right > i] if p == q else right
        j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= pct * np.maximum(n[j], n[i]))]
        if len(j):
            j = j[surviving(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], table, batch)]
        if len(j) and band:
            same = (sig[j, :band * rows] == sig[i, :band * rows]).reshape(len(j), band, rows).all(axis=2).any(axis=1)
            j = j[~same]
        if len(j):
            yield i, j


def _across(members: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int,
            table: np.ndarray, batch: int, pct: int, rows: int, block: int, parts: int) -> DataFrame:
    """Links between different components of a bucket.

    ``members``: bucket, band, size, mass (shingles of the bucket), node,
    label, n.  A bucket of more than ``block`` members or a million shingles is
    cut by hash into chunks, and every pair of chunks is one group; a task
    streams through its sorted groups and holds one at a time.  The first pass
    reads signatures and keeps the members that have a pair left to verify;
    the second verifies these pairs on the full sets.  Neither writes pairs
    that are no links.
    """
    chunks = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.col("mass") / F.lit(1 << 20))).cast("int")
    cut = members.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("bucket", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                     "own", "node", "label", "n")
    sig = nodes.select("node", "sig")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *GROUP).sortWithinPartitions(*GROUP)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            label = pd.factorize(g["label"])[0]
            used = np.zeros(len(g), bool)
            if label.max() > 0:
                for i, j in _open_pairs(g, table, batch, pct, rows, label):
                    used[i] = True
                    used[j] = True
            if used.any():
                yield g.loc[used, [*GROUP, "band", "own", "node", "label", "n"]]

    kinds = "bucket long, p int, q int, band int, own int, node binary, label binary, n long"
    left = stage(grouped(cut.join(sig, "node")).mapInPandas(trimmed(first), kinds), "open")
    found = _sets(left.select("node"), nodes, docs, id_col, text_col, k)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            label = pd.factorize(g["label"])[0]
            sets = [np.frombuffer(x, np.uint64) for x in g["s"]]
            node = g["node"].to_numpy()
            got = []
            for i, js in _open_pairs(g, table, batch, pct, rows, label):
                for j in js:
                    if label[j] != label[i] and _reaches(sets[i], sets[j], pct):
                        got.append((node[i], node[j]))
                        label[label == label[j]] = label[i]
            if got:
                yield pd.DataFrame(got, columns=["a", "b"], dtype=object)

    links = stage(grouped(left.join(sig, "node").join(found, "node")).mapInPandas(trimmed(second), "a binary, b binary"), "links")
    unstage(left, found)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5,
                    threshold_pct: int = 80, bands: int = 24, rows: int = 5, leaders: int = 4,
                    miss: float = 1e-6, batch: int = 20, block: int = 1500) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_hash (Spark's xxhash64 of the text).

    Documents whose shingle sets have ``100 * intersection >= threshold_pct *
    union`` are linked; ``component_id`` is the smallest id reachable over
    links (the row itself included) and ``kept`` marks that document.

    Defined results: a null or blank text has no shingles, is linked with
    nothing and is its own component; rows with the same id and text are one
    document twice (both kept or both not); a null id names a component only if
    no document in it has another id (the component is then null, and its rows
    are kept); an empty table gives an empty result; other columns are not read.
    """
    size = bands * rows
    table = prune_table(size, threshold_pct / 100, miss)
    spark = docs.sparkSession
    signed = stage(_signed(docs, id_col, text_col, k, size), "signed")
    nodes = stage(signed.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")

    # the bucket's number holds its band, so buckets of different bands are different
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * rows) + 1, F.lit(4 * rows))))
    banded = nodes.select("node", "n", F.posexplode(keys).alias("band", "bucket"))
    heads = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"),
        F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node", "n"))
                                   for j in range(leaders)])).alias("lead")).filter("size > 1")
    shared = stage(banded.join(heads, "bucket"), "shared")

    # leaders first: linear in the members of a bucket
    led = (shared.select("node", "n", F.explode("lead").alias("l"))
           .filter((F.col("node") != F.col("l.node")) & _fits("n", "l.n", threshold_pct))
           .select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct())
    first = stage(_pruned(led, nodes, table, batch), "pairs")
    links = _verified(first, nodes, docs, id_col, text_col, k, threshold_pct)
    labels = stage(components(links), "labels")

    # completion: whatever still lies in one bucket and two components
    placed = (shared.filter("size > 2").select("bucket", "band", "node", "n", "size", "mass").join(labels, "node", "left")
              .withColumn("label", F.coalesce("label", "node")))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    members = placed.join(mixed.select("bucket"), "bucket")
    more = _across(members, nodes, docs, id_col, text_col, k, table, batch, threshold_pct, rows, block,
                   shuffle_partitions(spark))
    final = labels if more.isEmpty() else stage(components(links.union(more)), "labels")
    unstage(shared, first)

    named = nodes.select("node", "id").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = named.join(lowest, "label").select("node", "component_id")
    out = signed.select("id", "n", "node", "h").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), F.col("h").alias("text_hash"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each group of near-duplicates.

    The document with the smallest id stays; of rows that repeat an id and its
    text one stays.  Only the keys of what goes are joined to the texts.
    """
    found = stage(near_duplicates(docs, id_col, text_col, **settings).select(
        F.col(id_col).alias("id"), F.col("text_hash").alias("h"), "kept"), "near")
    gone = stage(found.filter(~F.col("kept")).select("id", "h").distinct(), "gone")
    again = stage(found.filter("kept").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "h"),
                  "again")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("at"), F.xxhash64(text_col).alias("key"))

    def matched(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if fits_broadcast(keys, 32) else keys
        return df.join(keys, F.col("at").eqNullSafe(F.col("id")) & (F.col("key") == F.col("h")), how)

    rows = matched(rows, gone, "left_anti")
    if not again.isEmpty():
        rows = matched(rows, again, "left_anti").union(matched(rows, again, "left_semi").dropDuplicates(["at", "key"]))
    return rows.select("row.*")
