"""Document fingerprints by locally consistent parsing.

Level 0 names the code points.  A level cuts runs of equal names into pairs
(the last of an odd run into a triple).  Between runs, deterministic coin
tossing gives every symbol a small label: twice the lowest bit in which its
name differs from the name before, plus that bit, repeated until labels are
below 6.  Neighbouring labels always differ, so their local maxima, which
depend on a handful of neighbours only, cut the sequence into phrases of two to
about ten symbols.  A phrase is named by a hash of its symbols' names, and the
names are the next level's symbols, up to a single name for the text.  Equal
substrings are thus parsed alike except near their ends, at whatever offset
they stand.

The fingerprint is a bottom-k sketch of the set of all phrase names from level
``LOWEST`` upward (and the text's own name, however short it is): the
``SKETCH`` smallest 32-bit names, sorted, in hexadecimal.  The likeness of two
fingerprints is the share of the smallest names of their union that both have,
an estimate of the resemblance of the two phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage

SKETCH = 64
LOWEST = 2  # phrases of about ten code points
PIECE_CHARS = 1 << 20
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; ``first`` marks the sequences' first symbols (their virtual neighbour differs in bit 0)."""
    one = np.uint64(1)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = x[first] ^ one
    d = x ^ before
    low = np.bitwise_count((d & (~d + one)) - one)
    lab = (2 * low + ((x >> low.astype(np.uint64)) & one).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        prev = np.empty_like(lab)
        prev[1:] = lab[:-1]
        prev[first] = lab[first] ^ 1
        d = lab ^ prev
        low = np.bitwise_count((d & (~d + np.uint8(1))) - np.uint8(1))
        lab = (2 * low + ((lab >> low) & 1)).astype(np.uint8)
    return lab


def parse_level(x: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and sequence numbers of the next level's symbols."""
    n = len(x)
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | (seg[1:] != seg[:-1])
    at = np.flatnonzero(new)
    cut = np.zeros(n, bool)
    between = np.arange(n)
    if len(at) < n:  # runs of equal names: pairs, and a triple at the end of an odd run
        runs = np.diff(np.append(at, n))
        length, offset = np.repeat(runs, runs), np.arange(n) - np.repeat(at, runs)
        cut = (length > 1) & (offset % 2 == 0) & (offset <= length - 2)
        between = np.flatnonzero(length == 1)
    if len(between):
        first = np.ones(len(between), bool)
        first[1:] = (between[1:] != between[:-1] + 1) | (seg[between[1:]] != seg[between[:-1]])
        last = np.ones(len(between), bool)
        last[:-1] = first[1:]
        lab = _labels(x[between], first)
        top = np.zeros(len(between), bool)
        top[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
        top[1:] &= ~first[:-1]          # every phrase has two symbols or more, unless the stretch has one
        top &= ~last
        cut[between] = first | top
    start = np.flatnonzero(cut)
    sizes = np.diff(np.append(start, n))
    pos = (np.arange(n) - np.repeat(start, sizes)).astype(np.uint64)
    name = _mixed(np.add.reduceat(_mixed(x + pos * _K[0]), start) + sizes.astype(np.uint64) * _K[2])
    return name, seg[start]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as sorted names (uint32); none for an empty text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return [np.empty(0, np.uint32)] * len(texts)
    with np.errstate(over="ignore"):
        x = _mixed(code.astype(np.uint64) * _K[2] + _K[0])
        seg = np.repeat(np.arange(len(texts)), lengths)
        names, owners = [], []
        level = 0
        while len(x):
            first = np.ones(len(x), bool)
            first[1:] = seg[1:] != seg[:-1]
            alone = first.copy()
            alone[:-1] &= first[1:]     # a sequence of one symbol is done: that is the text's own name
            keep = alone if level < LOWEST else np.ones(len(x), bool)
            names.append((_mixed(x[keep] + np.uint64(level)) >> np.uint64(32)).astype(np.uint32))
            owners.append(seg[keep])
            x, seg = x[~alone], seg[~alone]
            if len(x):
                x, seg = parse_level(x, seg)
            level += 1
    name, owner = np.concatenate(names), np.concatenate(owners)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(32)) | name, kind="stable")
    name, owner = name[order], owner[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    name, owner = name[fresh], owner[fresh]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [name[i:min(i + SKETCH, j)] for i, j in zip(cuts[:-1], cuts[1:])]


def hexed(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def unhexed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance, 0 to 1; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum() / len(union))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the next document's first."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _pieces(pairs: list[tuple], limit: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += 2 * len(p[1]) + len(p[2])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with_next(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(id, text, next text) in lists; rows come by bucket in order, each bucket closed by its ``tail`` row."""
    held: tuple | None = None
    for pdf in batches:
        ready = []
        for i, text, tail in zip(pdf["id"].astype("Int64"), pdf["t"], pdf["tail"]):
            if held is not None:
                ready.append((*held, text))
            held = None if tail else (None if pd.isna(i) else int(i), text)
        yield ready


def ordered_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, t, tail) partitioned so that each row is followed by its next document in descending id order.

    Ids are cut into buckets at approximate quantiles.  Every bucket's rows
    are sorted in one task and closed by a copy of the first document of the
    next bucket (the last bucket by that of the first), so texts are shuffled
    once and no window runs over the whole table.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = 4 * parts
    bounds = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    step = max(1, int(len(bounds) ** 0.5))
    lit = lambda v: F.array(*[F.lit(x).cast("long") for x in v]) if v else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(lit(bounds[step - 1::step]), lambda b: b <= F.col("id"))) * step
    rows = rows.withColumn("_c", F.when(F.col("id").isNotNull(), coarse))
    fine = F.size(F.filter(F.slice(lit(bounds), F.col("_c") + 1, F.lit(step)), lambda b: b <= F.col("id")))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("_c") + fine)).drop("_c")

    heads = stage(rows.groupBy("bucket").agg(F.max("id").alias("id")), "heads")  # one row per bucket
    order = [r["bucket"] for r in heads.select("bucket").orderBy(F.desc("bucket")).collect()]
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "bucket int, prior int")
    first = (rows.join(F.broadcast(heads.join(before, "bucket").select(
        F.col("bucket").alias("b"), F.col("id").alias("head"), "prior")),
        (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("head")))
        .groupBy("prior").agg(F.min("t").alias("t")))
    tails = first.select(F.lit(None).cast("long").alias("id"), "t", F.col("prior").cast("int").alias("bucket"),
                         F.lit(True).alias("tail"))
    both = rows.withColumn("bucket", F.col("bucket").cast("int")).withColumn("tail", F.lit(False)).unionByName(tails)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("id").desc_nulls_last(), "t").select(
        "id", "t", "tail")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before in ascending id order (after the
    smallest id: the largest); the edited text ends with its beginning.

    Defined results: a null text is empty; the fingerprint of an empty text is
    empty, like another empty one (1.0) and unlike any other (0.0); rows with
    the same id follow each other in text order; null ids come last; a table
    of one row has itself as its next; an empty table gives an empty result;
    other columns are not read.
    """
    rows = ordered_with_next(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ready in _with_next(batches):
            for part in _pieces(ready, PIECE_CHARS):
                edited = [edited_text(t, nxt) for _, t, nxt in part]
                # the next row's text is mostly the following row's own
                follow = [i + 1 if i + 1 < len(part) and part[i + 1][1] == nxt else None for i, (_, _, nxt) in enumerate(part)]
                extra = [nxt for (_, _, nxt), f in zip(part, follow) if f is None]
                all_of = sketches([t for _, t, _ in part] + edited + extra)
                own, ed, more = all_of[:len(part)], all_of[len(part):2 * len(part)], iter(all_of[2 * len(part):])
                nexts = [own[f] if f is not None else next(more) for f in follow]
                df = pd.DataFrame({
                    "doc_id": pd.array([i for i, _, _ in part], "Int64"), "n_chars": [len(t) for _, t, _ in part],
                    "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                    "fingerprint": [hexed(s) for s in own], "edited_fingerprint": [hexed(s) for s in ed],
                    "near_edited": [likeness(a, b) for a, b in zip(own, ed)],
                    "near_next": [likeness(a, b) for a, b in zip(own, nexts)]})
                yield df

    return rows.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
