"""Exact dedup against brute force: nulls, ties, repeated rows, clashing names, no rows, a filter that is too small."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ladle.llm import exact

SCHEMA = "doc_id long, text string, source string, keep_id string, len int, row string, full string"
LOWER = str.maketrans(exact.UPPER, exact.LOWER)


def some_rows(n, seed=5):
    rng = random.Random(seed)
    long = "very long text, equal to its end " * 4000
    texts = [None, "", "A", "a", "Ä", "ä", "same prefix " * 8 + "one", "same prefix " * 8 + "two", "Same Prefix " * 8 + "ONE",
             long, long.upper(), long + "x", "kelvin K", "kelvin k", "İ", "tab\tx", "tab x"]
    rows = []
    for i in range(n):
        text = rng.choice(texts) if rng.random() < 0.5 else f"text number {i}"
        rows.append((i, text, "s", "clash", -1, "r", "f"))
    return rows


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r)
    size = {k: len(g) for k, g in groups.items()}
    best = {k: max((r[0] for r in g if r[0] is not None), default=None) for k, g in groups.items()}
    return size, best


@pytest.mark.parametrize("options", [{}, {"filter_words": 1}, {"prefix_chars": 1}])
def test_equals_brute_force(spark, options):
    rows = some_rows(150)
    size, best = brute(rows)
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    assert got.columns == ["doc_id", "source", "len", "row", "full", "keep_id", "group_size", "kept"]
    text = {r[0]: (r[1] or "").translate(LOWER) for r in rows}
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (best[t], size[t], r.doc_id == best[t])
        assert (r.source, r.len, r.row, r.full) == ("s", -1, "r", "f")


def test_repeated_rows_and_null_ids_keep_exactly_one(spark):
    rows = [(1, "x", *["s"] * 1, "k", 0, "r", "f")] * 3 + [(None, "x", "s", "k", 0, "r", "f")] * 2 \
        + [(None, "only null ids", "s", "k", 0, "r", "f")] * 2 + [(9, "single", "s", "k", 0, "r", "f")]
    out = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept) for r in out)
    assert got == sorted([("1", "1", 5, True), ("1", "1", 5, False), ("1", "1", 5, False), ("None", "1", 5, False),
                          ("None", "1", 5, False), ("None", "None", 2, True), ("None", "None", 2, False), ("9", "9", 1, True)])


def test_drop_duplicates_keeps_whole_rows(spark):
    rows = some_rows(60)
    size, best = brute(rows)
    got = exact.drop_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == sorted((r for r in rows if r[0] in set(best.values())), key=lambda r: r[0])


def test_no_rows_and_no_copies(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.exact_duplicates(empty).count() == 0
    one = exact.exact_duplicates(spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string"))
    assert sorted(map(tuple, one.collect())) == [(i, i, 1, True) for i in range(5)]


def test_full_texts_are_hashed_only_for_survivors(spark):
    """The filter passes every survivor, and few others."""
    docs = spark.range(20000).select(F.concat(F.lit("text "), "id").alias("t"))
    survivors = docs.limit(500).select(F.length("t").alias("len"), exact._prefix_hash(F.col("t"), 64).alias("prefix"))
    survivors = spark.createDataFrame(survivors.collect(), survivors.schema)
    passed = docs.select("t", exact._may_have_copies(F.length("t"), exact._prefix_hash(F.col("t"), 64), survivors, 1 << 10).alias("p"))
    n = passed.where("p").count()
    assert 500 <= n < 600
