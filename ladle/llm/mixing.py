"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1.  Targets.  Sources in code-point order (null last) take the weights in
    turn; together they share all words.  A source stops at ``cap`` times its
    own words and the excess is reshared by weight (water-filling; the level
    is found by repeated sums over the source totals).
2.  Blocks.  A source's documents fall by hash into about ``sqrt(documents)``
    blocks.  The mix takes every block ``floor(target / words)`` times and, for
    the rest, blocks in permuted order until the target is met; the last
    block is taken document by document in permuted order.  This gives every
    source an exact quota of block draws.
3.  Splitting tree.  The draws of all sources are dealt to ``shards`` output
    shards of equal numbers of draws: a node hands a multivariate-hypergeometric
    sample of its quotas to its left half and the rest to its right half.
    Every node has its own seed, so a task finds its shards' quotas by walking
    down from the root.  The tree has two storeys, groups of neighbouring
    sources and the sources of a group, each about the square root of the
    sources wide, so nothing that is sent or held grows faster than that.
4.  A shard draws its disjoint range of each source's permuted block draws and
    shuffles its documents locally.

Work and state per task stay near ``sqrt(documents of a source)`` beyond the
scans: no window runs over a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage, words


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, k, docs, source_size) from rows (source, size); ``k`` numbers the sources by code point, null last.

    The totals are cut into ranges of sources, and a range's first number is
    the count of the sources before it: no task holds all sources.
    """
    spark = sizes.sparkSession
    by_name = F.col("source").asc_nulls_last()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranges = stage(totals.repartitionByRange(shuffle_partitions(spark), by_name).withColumn(
        "range", F.spark_partition_id()), "mix-sources")
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(  # a row per range
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("range").orderBy(by_name)
    return ranges.withColumn("i", F.row_number().over(inside) - 1).join(F.broadcast(firsts), "range").select(
        "source", (F.col("first") + F.col("i")).alias("k"), "docs", "source_size")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """(source, k, docs, source_size, target) from rows (source, size).

    The water level is what the sources that are not full share, by weight.
    It is found by repeated sums over the sources: whoever would get more
    than its cap at the level becomes full, which raises the level for the
    rest, until nobody else does.  Only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod("k", F.lit(len(weights))) + 1).cast("int"))
    df = stage(numbered_sources(sizes).withColumn("w", weight).withColumn(
        "cap", (cap * F.col("source_size")).cast("double")), "mix-targets")
    total = df.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = (F.col("cap") < F.col("w") * F.lit(level)) if full >= 0 else F.lit(False)
        sums = df.agg(F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("given"),
                      F.sum(F.when(is_full, 0.0).otherwise(F.col("w"))).alias("w"),
                      F.sum(F.when(is_full, 1).otherwise(0)).alias("full")).first()
        if not sums["w"] or sums["full"] == full:  # no source at all, or the level stands
            break
        full, level = sums["full"], (total - sums["given"]) / sums["w"]
    return df.select("source", "k", "docs", "source_size", F.least(F.col("w") * F.lit(level), F.col("cap")).alias("target"))


def split_quotas(quotas: Sequence[int], before: Callable[[int], int], shards: int, seed: Sequence[int],
                 first: int = 0, until: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, position of its first draw in each source, its quota of each) for the shards ``first`` to ``until`` - 1.

    ``before(i)``: the draws of the shards before ``i``.  Nodes outside the
    wanted shards are not opened, and a node shared by many is drawn once.
    """
    until = shards if until is None else until
    quotas = np.asarray(quotas, np.int64)
    nodes = [(0, shards, np.zeros(len(quotas), np.int64), quotas)]
    while nodes:
        lo, hi, start, left = nodes.pop()
        if hi - lo == 1:
            yield lo, start, left
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*seed, lo, hi])
        take = rng.multivariate_hypergeometric(left, before(mid) - before(lo), method="marginals")
        if mid < until:
            nodes.append((mid, hi, start + take, left - take))
        if first < mid:
            nodes.append((lo, mid, start, take))


def shard_quotas(quotas: Sequence[int], shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's quota of draws from each source, and the position of its first draw in each source."""
    total = int(np.sum(quotas))
    _, start, quota = next(split_quotas(quotas, lambda i: total * i // shards, shards, [seed], shard, shard + 1))
    return quota, start


def deal_draws(sources: DataFrame, shards: int, seed: int, width: int) -> DataFrame:
    """(k, shard, rank): the draws of each source dealt to shards of equal numbers of draws; ``sources``: k, n draws.

    ``width`` neighbouring sources form a group.  One tree deals the groups'
    quotas to the shards; below it, a tree for each group deals its sources'
    quotas to the places that the group has in the shards.  A hypergeometric
    sample of the groups, and given that one of each group's sources, is one
    of all sources.  Only the groups' totals are sent to all tasks.
    """
    spark = sources.sparkSession
    grouped = sources.withColumn("g", F.expr(f"k div {width}"))
    totals = [(int(r["g"]), int(r["n"])) for r in  # a row per group: a square root of the sources
              grouped.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()]
    names, numbers = np.array([g for g, _ in totals], np.int64), [n for _, n in totals]
    everything = sum(numbers)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            first, until = int(pdf["id"].min()), int(pdf["id"].max()) + 1  # neighbours: spark.range is in order
            for shard, _, quota in split_quotas(numbers, lambda i: everything * i // shards, shards, [seed], first, until):
                has = quota > 0
                yield pd.DataFrame({"g": names[has], "shard": shard, "quota": quota[has]})

    def deal_group(key: tuple, own: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        own, places = own.sort_values("k"), places.sort_values("shard")
        edges = np.concatenate([[0], np.cumsum(places["quota"].to_numpy(np.int64))])
        k, shard = own["k"].to_numpy(), places["shard"].to_numpy()
        parts = []
        for i, start, quota in split_quotas(own["n"].to_numpy(), lambda i: int(edges[i]), len(shard), [seed, 1, int(key[0])]):
            has = np.flatnonzero(quota)
            parts.append((k[has], np.full(len(has), shard[i]), start[has], quota[has]))
        return pd.DataFrame(dict(zip(("k", "shard", "start", "quota"), map(np.concatenate, zip(*parts)))))

    places = spark.range(shards).mapInPandas(deal, "g long, shard long, quota long")
    dealt = grouped.groupBy("g").cogroup(places.groupBy("g")).applyInPandas(
        deal_group, "k long, shard long, start long, quota long")
    return dealt.select("k", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("rank"))


def _placed(df: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's plan, block and draw order (a hash of the id)."""
    plan = plan.select(F.col("source").alias("_src"), "k", "docs", "source_size", "target")
    df = df.join(plan, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    blocks = F.greatest(F.ceil(F.sqrt("docs")).cast("long"), F.lit(1))
    return df.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), blocks)).withColumn(
        "order", F.xxhash64(F.lit(seed + 1), "id"))


def plan_draws(sized: DataFrame, weights: Sequence[float], cap: int, shard_words: int, seed: int,
               whole: bool) -> tuple[DataFrame, DataFrame]:
    """The sources' plan, and for each (k, block) its draws.

    ``sized``: id, source, size.  A draw is (shard, below, at, words): the
    documents whose order is under ``below`` are taken whole, those at ``at``
    give ``words`` words (null ``below``: the whole block).
    """
    plan = stage(source_targets(sized, weights, cap), "mix-plan")
    placed = _placed(sized, plan, seed)
    blocks = stage(placed.groupBy("k", "block", "source_size", "target").agg(F.sum("size").alias("size"))
                   .withColumn("passes", F.when(F.col("source_size") > 0, F.least(
                       F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("int"))
                   .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
                   .withColumn("rest", F.when(F.col("passes") >= cap, F.lit(0)).otherwise(F.col("rest"))), "mix-blocks")
    permuted = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block")
    partial = blocks.withColumn("upto", F.sum("size").over(permuted)).withColumn(
        "words", F.col("rest") - (F.col("upto") - F.col("size")))
    partial = partial.filter("words > 0 and size > 0").withColumn("cut", F.col("upto") > F.col("rest"))

    # the one block of each source that is taken in part, document by document
    edge = partial.filter("cut").select("k", "block", "words")
    inside = placed.join(edge, ["k", "block"]).groupBy(
        "k", "block", "words", "order").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    along = Window.partitionBy("k").orderBy("order")
    inside = inside.withColumn("before", F.sum("size").over(along) - F.col("size"))
    inside = inside.withColumn("left", F.col("words") - F.col("before")).filter("left > 0 and left <= size")
    share = F.col("left") / F.col("rows")
    take = F.when(2 * F.col("left") >= F.col("size"), F.col("size") / F.col("rows")).otherwise(F.lit(0)) if whole else share
    cuts = inside.select("k", "block", F.col("order").alias("at"), F.floor(take).cast("long").alias("part"))
    part = partial.join(cuts, ["k", "block"], "left").select(
        "k", "block", F.lit(-1).alias("pass"), F.when(F.col("cut"), F.col("at")).alias("at"),
        F.when(F.col("cut"), F.col("part")).alias("part"))
    full = blocks.filter("passes > 0 and size > 0").select(
        "k", "block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"),
        F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("part"))
    mixed = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed + 3), "block", "pass"), "block", "pass")
    draws = stage(part.union(full).withColumn("rank", F.row_number().over(mixed) - 1), "mix-draws")

    sources = stage(draws.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "mix-quotas")
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    counted = sources.agg(F.sum("n").alias("draws"), F.max("k").alias("last")).first()
    shards = max(1, min(math.ceil(total / shard_words), counted["draws"] or 0))
    width = math.isqrt(counted["last"] or 0) + 1
    got = draws.join(deal_draws(sources, shards, seed, width), ["k", "rank"])
    per_block = got.groupBy("k", "block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "at", "part"))).alias("draws"))  # at most cap + 1 draws
    return plan, stage(per_block, "mix-dealt")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        weights: Sequence[float] = (5, 2, 1), cap: int = 3, shard_words: int = 1 << 20, seed: int = 17,
        whole: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, draws (and the columns in ``carry``).

    ``size`` is the number of words, ``target`` the words that the row's
    source shall give, ``taken`` the words that the mix takes from this row,
    repeats counted, and ``draws`` an array of (shard, words).  With ``whole``
    no document is cut: the last one of a source is rounded to all or nothing;
    else at most one document of a source gives only its first words.

    Defined results: a null or blank text has size 0 and is never drawn; a
    null source is a source; rows with the same id, or none (null ids are one
    id), are drawn alike (a cut is shared among them); a source without words has target 0; an empty table
    gives an empty result.  Reruns agree: draws depend on ids and ``seed``.
    """
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.size(words(F.col(text_col))).cast("long").alias("size"), *kept)
    sized = stage(rows.select("id", "source", "size"), "mix-sized")
    plan, dealt = plan_draws(sized, weights, cap, shard_words, seed, whole)
    base = rows if carry else sized
    df = _placed(base, plan, seed).join(dealt.select("k", "block", F.col("draws").alias("_d")), ["k", "block"], "left")

    def taken(d: Column) -> Column:
        return F.when(d["at"].isNull() | (F.col("order") < d["at"]), F.col("size")).when(
            F.col("order") == d["at"], F.least(d["part"], F.col("size"))).otherwise(F.lit(0)).cast("long")

    draws = F.filter(F.transform("_d", lambda d: F.struct(d["shard"].alias("shard"), taken(d).alias("words"))),
                     lambda d: d["words"] > 0)
    draws = F.coalesce(draws, F.array().cast("array<struct<shard:bigint,words:bigint>>"))
    return df.select("id", "source", "size", "source_size", "target", draws.alias("draws"),
                     *[F.col(f"_keep_{i}") for i in range(len(carry))]).withColumn(
        "taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    *, shards_column: str | None = None, **settings) -> DataFrame:
    """The mix itself: each draw is a row with the columns of ``docs``.

    Shards are whole partitions in shard order of a hash, each in a seeded
    random order.  With ``whole=False`` a cut document keeps its first words.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = mix(docs, id_col, text_col, source_col, carry=docs.columns, **settings)
    drawn = got.withColumn("_draw", F.explode("draws"))
    cut = F.col("_draw.words") < F.col("size")
    out = []
    for i, c in enumerate(docs.columns):
        col = F.col(f"_keep_{i}")
        if c == text_col:
            first = F.slice(words(col), F.lit(1), F.col("_draw.words").cast("int"))
            col = F.when(cut, F.array_join(first, " ")).otherwise(col)
        out.append(col.alias(c))
    shuffled = drawn.select(*out, F.col("_draw.shard").alias("_shard"),
                            F.xxhash64(F.lit(settings.get("seed", 17)), F.col("_draw.shard"), F.col("id")).alias("_at"))
    shuffled = shuffled.repartition(parts, "_shard").sortWithinPartitions("_shard", "_at")
    if shards_column:
        return shuffled.withColumnRenamed("_shard", shards_column).drop("_at")
    return shuffled.drop("_shard", "_at")
