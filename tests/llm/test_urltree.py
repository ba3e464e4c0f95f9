"""The path-template tree against a brute-force tree, and page labels by text."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ladle.llm import urlfilter

OPTIONS = dict(support=4, share=0.1, z=2.58, gap=0.6)


def shape(s):
    return "<n>" if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]+)?", s) else "*"


def brute_names(kids):
    """seg -> name, from seg -> list of labels (None: no label) of a node's pages."""
    total, mean = sum(map(len, kids.values())), sum(map(len, kids.values())) / len(kids)
    own = []
    for seg, labels in kids.items():
        n = len(labels)
        if n >= OPTIONS["support"] and (n >= OPTIONS["share"] * total or n > mean + OPTIONS["z"] * math.sqrt(mean)):
            seen = [x for x in labels if x is not None]
            own.append(((sum(seen) + 0.5) / (len(seen) + 1), seg, len(seen), sum(seen)))
    groups = []
    for rate, seg, seen, worse in sorted(own):
        if groups:
            r0, _, s0, w0 = groups[-1][-1]
            p = (worse + w0 + 0.5) / (seen + s0 + 1)
            error = OPTIONS["z"] * math.sqrt(p * (1 - p) * (1 / max(seen, 1) + 1 / max(s0, 1)))
            if seen and s0 and rate - r0 <= error <= OPTIONS["gap"]:
                groups[-1].append((rate, seg, seen, worse))
                continue
        groups.append([(rate, seg, seen, worse)])
    out = {}
    for g in groups:
        first = min(seg for _, seg, *_ in g)
        for _, seg, *_ in g:
            out[seg] = first if len(g) == 1 else f"[{first} +{len(g) - 1}]"
    return out


def brute_templates(rows):
    out = {}

    def grow(pages, level, template):
        kids = defaultdict(list)
        for i, parts, bad in pages:
            if len(parts) > level:
                kids[parts[level]].append((i, parts, bad))
            else:
                out[i] = template
        if not kids:
            return
        names = brute_names({s: [b for *_, b in v] for s, v in kids.items()})
        below = defaultdict(list)
        for s, v in kids.items():
            below[template + "/" + names.get(s, shape(s))] += v
        for t, v in below.items():
            grow(v, level + 1, t)

    hosts = defaultdict(list)
    for i, host, path, bad in rows:
        hosts[host].append((i, [s for s in path.split("/") if s], bad))
    for pages in hosts.values():
        grow(pages, 0, "")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        host = rng.choice(["a.org", "a.org", "a.org", "b.org", "c.org", ""])
        depth = rng.choice([0, 1, 2, 3, 6])
        path = "".join("/" + rng.choice(["en", "de", "blog", str(rng.randrange(50)), f"{rng.randrange(9)}.html", f"x{rng.randrange(40)}"])
                       for _ in range(depth)) + rng.choice(["", "/"])
        bad = rng.choice([None, 0, 1]) if "de" in path or seed % 2 else rng.choice([None, 0, 0])
        rows.append((i, host, path, bad))
    rows.append((1000, "deep.org", "/d" * 700, 1))
    df = spark.createDataFrame(rows, "id int, host string, path string, bad int")
    got = {r.id: r.template for r in urlfilter.path_templates(df, **OPTIONS).collect()}
    assert got == brute_templates(rows)
    assert any("[" in t for t in got.values())


def test_unlabelled_branches_stay_apart(spark):
    rows = [(i, "h.org", f"/{'en' if i % 2 else 'fr'}/{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, host string, path string, bad int")
    assert {r.template for r in urlfilter.path_templates(df, **OPTIONS).collect()} == {"/en/<n>", "/fr/<n>"}


def test_pages_are_labelled_by_the_documents_they_show(spark):
    line = lambda d, k: f"line {k} of the text of document {d} in words"
    common = "this line stands in every document of all"
    docs = [(d, "\n".join([common] + [line(d, k) for k in range(4)])) for d in range(6)] + [(6, None), (None, common), (7, "")]
    labels = [(0, 1), (1, 0), (2, 1), (2, 0), (3, 0), (None, 1), (7, 1), (6, 1)]
    show = lambda *ds: "<html><nav>menu of the site, long enough</nav>" + "".join(f"<p>{line(d, k)}</p>" for d in ds for k in range(4))
    pages = [(10, show(0)), (11, show(1)), (12, show(2)), (13, show(4)), (14, f"<p>{common}</p><p>short</p>" + show(5)),
             (15, show(0, 1)), (16, None), (17, ""), (None, show(0)), (18, show(0).replace("<p>", "<p>\n  ").replace(" of ", "  of\t"))]
    got = urlfilter.text_labels(spark.createDataFrame(pages, "page_id long, html string"),
                                spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "id long, bad int"))
    assert {r.id: r.bad for r in got.collect()} == {10: 1, 11: 0, 12: 1, 15: 1, 18: 1}
    none = spark.createDataFrame([], "id long, bad int")
    assert urlfilter.text_labels(spark.createDataFrame(pages, "page_id long, html string"),
                                 spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0
