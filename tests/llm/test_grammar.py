"""Union-free expressions: language, alignment and matching against brute force; deep, long and repeated pages."""

import random
import re

import numpy as np
import pytest

from ladle.llm import grammar, wrappers
from ladle.llm.grammar import SLOT, Item

LABELS = "abcde"


def random_tree(rng, depth=3):
    kids = []
    for _ in range(rng.choice([0, 1, 2, 4, 7])):
        if depth and rng.random() < 0.6:
            kids.append(random_tree(rng, depth - 1))
        elif not kids or kids[-1] != SLOT:
            kids.append(SLOT)
    return [rng.choice(LABELS), kids]


def tokens(node):
    """The page as a string: one character per label, slot and end."""
    if node == SLOT:
        return "#"
    return node[0] + "".join(tokens(k) for k in node[1]) + "/"


def pattern(item):
    """The expression as a pattern of Python's regex engine over ``tokens``."""
    inner = "".join(pattern(k) for k in item.kids)
    own = inner if item.group else re.escape(item.label) + ("" if item.label == SLOT else inner + "/")
    many = f"(?:{own})" + ("+" if item.repeats else "")
    return f"(?:{many})?" if item.optional else many


@pytest.mark.parametrize("seed", range(25))
def test_every_page_is_in_the_language_and_matched(seed):
    rng = random.Random(seed)
    trees = [["r", random_tree(rng)[1]] for _ in range(rng.choice([1, 2, 5, 9]))]
    w = grammar.merged(grammar.tree_item(trees[0]))
    for t in trees[1:]:
        w = grammar.merged(w, grammar.decoded(grammar.encoded(grammar.merged(grammar.tree_item(t)))))
    assert grammar.encoded(grammar.decoded(grammar.encoded(w))) == grammar.encoded(w)
    regex = re.compile(pattern(w))
    for t in trees:
        assert regex.fullmatch(tokens(t)), (grammar.expression(w), tokens(t))
        places = grammar.Wrapper(grammar.encoded(w)).locate(t)
        assert all(re.fullmatch(r"(/\d+)+", p) for p in places.values())
        # a slot's address leads to a text of the expression
        for address in places.values():
            item = w
            for p in address.split("/")[1:]:
                item = grammar.Matcher(item.kids).targets[int(p)]
            assert item.label == SLOT


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_longest(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
    pairs = grammar._common(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    assert len(pairs) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def collapsed(labels):
    return "".join(_text(x) for x in grammar.collapse([Item(c) for c in labels]))


def _text(x):
    return ("(" + "".join(map(_text, x.kids)) + ")" if x.group else x.label) + ("+" if x.repeats else "")


def test_repeated_groups():
    assert collapsed("abababab") == "(ab)+" and collapsed("aabab") == "(a+b)+"
    assert collapsed("haabhabhaaab") == "(ha+b)+" and collapsed("xabcabcy") == "x(abc)+y"
    assert collapsed("abacabac") == "(abac)+" and collapsed("abc") == "abc" and collapsed("") == ""


def test_deep_and_long_pages(spark):
    deep = "<html><body>" + "<div>" * 5000 + "<p>deep text</p>"
    long = "<html><body><dl>" + "".join(f"<dt>t{i}<dd>d{i}" for i in range(10000)) + "</dl>"
    rows = [(1, "http://a.org/", deep), (2, "http://a.org/", deep.replace("<p>", "<h1>")), (3, "http://b.org/", long),
            (4, "http://b.org/", "<html><body><dl><dt>one</dl>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    assert got[1] == got[2] == "deep text" and got[4] == "one"
    assert got[3] == "\n\n".join(f"{c}{i}" for i in range(10000) for c in "td")
    shown = {r.host: r.wrapper for r in wrappers.infer_wrappers(pages).collect()}
    assert "(<dt> # </> <dd> # </>)+" in shown["b.org"]


def test_the_wrapper_does_not_depend_on_the_number_of_tasks(spark):
    rng = random.Random(4)
    page = lambda: "<html><body>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(["h1", "p", "ul", "pre", "h2"], k=rng.randrange(1, 7)))
    rows = [(i, f"http://h{i % 3}.org/", page()) for i in range(120)]
    found = []
    for n in (1, 7):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * n))
        try:
            found.append({r.host: (r.wrapper, r.pages) for r in wrappers.infer_wrappers(pages).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] and sum(n for _, n in found[0].values()) == 120


def test_a_text_needs_more_than_two_pages_to_be_template(spark):
    """The rule is the same for a host of any size: pages with the text, less two, are half of those with the slot."""
    for n, template in ((2, False), (3, False), (4, True), (30, True)):
        rows = [(i, "http://h.org/", f"<html><body><p>same</p><h1>own {i}</h1>") for i in range(n)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        texts = {r.text for r in wrappers.main_text(pages).collect()}
        assert texts == {f"own {i}" if template else f"same\n\nown {i}" for i in range(n)}
