"""Phrases of any number of digit groups and neighbour words of any length, against brute force."""

import random
import re

import pytest

from ladle.llm import pii

DIGITS = re.compile(r"[0-9]")


def brute_phrases(text):
    """(start, end, part) of the phrases of two or more neighbouring digit groups, 7 to 19 digits."""
    pieces = list(re.finditer(r"(?<![^ \t-\r])[(]?[0-9][0-9().-]*(?![^ \t-\r,;:!?'\"\]])", text))
    out = set()
    count = lambda m: len(DIGITS.findall(m.group()))
    near = lambda i: 0 < i < len(pieces) and pieces[i - 1].end() + 1 == pieces[i].start()
    for i in range(len(pieces)):
        j, total = i, count(pieces[i])
        while near(j + 1):
            j, total = j + 1, total + count(pieces[j + 1])
            if not 7 <= total <= 19:
                continue
            lead = pieces[i].group()[0] == "(" and not any(")" in p.group() for p in pieces[i:j] or [pieces[i]])
            tail = len(re.search(r"[^0-9]*$", pieces[j].group()).group())
            part = (near(i) and total + count(pieces[i - 1]) <= 19) or (near(j + 1) and total + count(pieces[j + 1]) <= 19)
            out.add((pieces[i].start() + lead, pieces[j].end() - tail, part))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    group = lambda: rng.choice(["1", "22", "333", "4444", "(030)", "12-3", "5.", "(04", "7)"])
    texts = ["".join(rng.choice([group(), group(), group(), "word", "x,"]) + rng.choice([" ", " ", " ", "  ", "\n"])
                     for _ in range(rng.randrange(30))) for _ in range(40)]
    texts += ["1 " * 40, "", "12 34 56 78 90 12 34", "1 2 3 4 5 6 7 8"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    df = pii._located(df, df["t"], "piece", pii.PIECE).withColumn("groups", pii._groups(pii.F.col("piece")))
    got = df.select("id", pii._phrases(pii.F.col("groups")).alias("p")).collect()
    for r in got:
        assert {(x.start, x.end, x.part) for x in r.p} == brute_phrases(texts[r.id]), texts[r.id]


def test_identifiers_in_many_groups_and_long_neighbour_words(spark):
    rng = random.Random(9)
    long = "w" * 400
    phone = lambda sep: sep.join([*(f"{rng.randrange(10, 99)}" for _ in range(5)), "7"])  # noqa: E731  (too short for a card)
    known = [f"{long}a call +49 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {rng.randrange(10, 99)} {long}b" for _ in range(120)]
    hidden = [phone(" ") for _ in range(5)]
    rows = list(enumerate(known)) + [(1000 + i, f"{long}a call {p} {long}b") for i, p in enumerate(hidden)]
    # the same first 48 letters beside a number that is none
    rows += [(2000 + i, f"{'w' * 48}x total {phone(' ')} {'w' * 48}y") for i in range(60)]
    found = {r.id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, p in enumerate(hidden):
        at = len(long) + 7
        assert [tuple(s) for s in found[1000 + i].spans] == [(at, pii.KINDS.index("phone"), at + len(p))]
    assert all(not found[2000 + i].spans for i in range(60))
