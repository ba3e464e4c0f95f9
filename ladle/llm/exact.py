"""Exact dedup by progressive refinement: length, then a prefix hash, then a full hash of what is left.

1. One pass over the texts counts, per (length, hash of the first characters), the rows; a length with one row
   or a (length, prefix) with one row can have no copy.
2. The (length, prefix) pairs with several rows, *survivors*, go into a Bloom filter of fixed size (``filter_words``
   64-bit words, the only thing that is sent to every task).  The second pass reads the whole text of a row only if
   the filter has its pair, and takes the SHA-256 of it.  A false positive is hashed in vain and nothing else; with
   far more survivors than bits every text is hashed, and results stay the same.
3. Rows with a full hash are counted by (length, hash).  A group is combined before its shuffle, and never more
   than its count and largest row reach one task; its rows find their group by a join of short rows, which adaptive
   execution splits where one group is hot.  No text is shuffled.

Texts are equal when identical after lower-casing A to Z.  A null text is empty.  Of equal texts, the row with the
largest id stays, a null id being smaller than any other; of rows that share that id too, exactly one stays.  Repeated
rows are rows.  An empty table gives an empty result.  Columns other than the text are carried along; one that has
the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ["keep_id", "group_size", "kept"]


def normalised(text: Column) -> Column:
    """A null text is empty; only A to Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _prefix_hash(text: Column, chars: int) -> Column:
    return F.xxhash64(normalised(F.substring(F.coalesce(text, F.lit("")), 1, chars)))


def _bits(length: Column, prefix: Column, words: int) -> list[Column]:
    """Three bit positions of a key in a filter of ``words`` words."""
    return [F.pmod(F.xxhash64(length, prefix, F.lit(seed)), F.lit(64 * words)) for seed in (1, 2, 3)]


def _filter(survivors: DataFrame, words: int) -> DataFrame:
    """The Bloom filter of (len, prefix): one row with an array of ``words`` longs."""
    bit = F.explode(F.array(*_bits(F.col("len"), F.col("prefix"), words)))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    found = survivors.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = survivors.sparkSession.range(words).withColumnRenamed("id", "word").join(found, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return stage(every.agg(F.transform(pairs, lambda p: p["bits"]).alias("filter")), "exact-filter")


def _may_have_copies(length: Column, prefix: Column, survivors: DataFrame, words: int) -> Column:
    bits = _filter(survivors, words).scalar()
    found = [F.getbit(F.get(bits, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1 for b in _bits(length, prefix, words)]
    return found[0] & found[1] & found[2]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
                     filter_words: int = 1 << 15) -> DataFrame:
    """``docs`` without the text, plus keep_id (id of the row that stays), group_size (long) and kept.

    ``filter_words`` 64-bit words (256 kB by default) bound the filter.  Nulls, ties and repeated rows: see the module.
    """
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    carried = [c for c in docs.columns if c != text_col and c not in RESULT]
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
                        text.alias("text"), F.length(F.coalesce(text, F.lit(""))).alias("len"))

    prefixes = stage(keyed.groupBy("len", _prefix_hash(F.col("text"), prefix_chars).alias("prefix"))
                     .agg(F.count(F.lit(1)).alias("rows")), "exact-prefixes")
    lengths = prefixes.groupBy("len").agg(F.sum("rows").alias("of_length")).where("of_length > 1")
    survivors = stage(prefixes.where("rows > 1").join(lengths, "len", "left_semi").select("len", "prefix"), "exact-survivors")

    if survivors.isEmpty():
        full = F.lit(None).cast("string")
    else:
        full = F.when(_may_have_copies(F.col("len"), _prefix_hash(F.col("text"), prefix_chars), survivors, filter_words),
                      F.sha2(normalised(F.col("text")), 256))
    hashed = stage(keyed.select("id", "row", "len", full.alias("full"), F.monotonically_increasing_id().alias("nth")),
                   "exact-hashed")
    groups = stage(hashed.where("full is not null").groupBy("len", "full")
                   .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "nth")).alias("stays"))
                   .where("group_size > 1"), "exact-groups")
    unstage(prefixes)

    single = hashed.where("full is null").select("row.*", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                 F.lit(True).alias("kept"))
    grouped = hashed.where("full is not null").join(groups, ["len", "full"], "left").select(
        "row.*", F.when(F.col("stays").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce(F.col("stays.nth"), F.col("nth")) == F.col("nth")).alias("kept"))
    return single.unionByName(grouped)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per different text, whole: the rows of ``docs`` that ``exact_duplicates`` keeps."""
    inner = docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = exact_duplicates(inner.select(id_col, text_col, "_whole"), id_col, text_col, **options)
    return found.where("kept").select("_whole.*")
