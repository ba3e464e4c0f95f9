"""Main text of HTML pages by union-free wrapper inference.

A page becomes a stream of block tags and text slots (inline markup is
transparent).  The streams of a host are aligned one after another into a
wrapper, a union-free regular expression (:mod:`grammar`): what one lacks is
optional, repeated neighbours are repeated items or groups, texts are slots.

Every page is matched against its host's wrapper, which puts each of its texts
on a slot, and Spark counts on how many of the host's pages a slot holds the
same text.  A text is template if its pages, less ``doubt``, are half of those
with the slot or more; the rest varies and is content.  The regions (article,
main, content) that the wrapper chooses are those that hold ``region_share``
or more of the varying text of the pages that have them, one more page all
inside them counted.  A page's text is the varying text of the first such
region that it has, or all its varying text.  Word lists of tags and classes
only take out beforehand what is marked as menu, header, footer, sidebar,
notice, advert, form or comment, as that may vary from page to page too.
Pages whose unmarked texts are all equal count as one page.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage
from .grammar import SLOT, Item, Wrapper, decoded, encoded, expression, merged, regions_of, tree_item
from .urlfilter import host_of

# Element names and the words in class, id or role that mark parts of a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "noscript", "object", "ol", "optgroup", "option",
         "p", "pre", "search", "section", "select", "summary", "svg", "table", "tbody", "td", "template", "tfoot", "th",
         "thead", "tr", "ul", "video", "audio", "canvas", "math"} | RAW
DROPPED = {"head", "script", "style", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "textarea",
           "option", "noscript", "template", "iframe", "svg", "dialog", "search", "title", "object", "video", "audio",
           "canvas", "noembed", "noframes"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies",
         "consent", "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "menu", "nav", "navbar",
         "navigation", "breadcrumb", "breadcrumbs", "sidebar", "comment", "comments", "reply", "replies", "disqus", "footer",
         "header", "masthead", "share", "sharing", "social", "related", "widget", "toolbar", "search", "complementary",
         "contentinfo", "hidden"}
REGIONS = ("article", "main", "content")
CONTENT = {"content", "article", "post", "entry", "story"}
# An open element of the first kind ends at the start of one of the second.
P_ENDERS = BLOCK - {"option", "optgroup", "html", "head", "body", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "article", "main", "section", "div", "nav", "aside", "select", "html", "blockquote"}

_TOKEN = re.compile(
    r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _label(tag: str, attrs: str) -> str:
    """Element name, with ``!`` if the element is marked as no article text and ``@`` if it may hold the content."""
    marked = content = main = False
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role", "itemprop"):
                words = set(value.split())
                pieces = {p for w in words for p in re.split(r"[-_]+", w)} | words
                marked |= bool(pieces & MARKS)
                content |= bool(words & CONTENT) or value == "articlebody"
                main |= name == "role" and value == "main"
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                marked = True
            elif name == "style" and re.search(r"display\s*:\s*none", value):
                marked = True
    if tag in DROPPED or (marked and tag not in ("html", "body", "article", "main")) or (marked and tag == "article" and not content):
        return tag + "!"
    if tag == "article":
        return tag + "@article"
    if tag == "main" or main:
        return tag + "@main"
    return tag + "@content" if content and tag != "body" else tag


def parse(page: str) -> tuple[list, list[tuple[tuple[str, ...], str]]]:
    """(tree, blocks): the tree is [label, children], a slot the string ``#``; a block is (path of labels, text)."""
    return _parsed(page)[:2]


def _parsed(page: str) -> tuple[list, list[tuple[tuple[str, ...], str]], list[tuple[int, int]]]:
    """``parse``, and for each block the identity of its element and its slot's position there."""
    root: list = ["", []]
    stack = [("", root)]
    blocks: list[tuple[tuple[str, ...], str]] = []
    places: list[tuple[int, int]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                kids = stack[-1][1][1]
                if not kids or kids[-1] != SLOT:
                    kids.append(SLOT)
                blocks.append((tuple(n[0] for _, n in stack[1:]), text))
                places.append((id(stack[-1][1]), len(kids) - 1))

    def text(s: str) -> None:
        if s:
            held.append(html_lib.unescape(s) if "&" in s else s)

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag not in BLOCK:
            continue
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        flush()
        if tag in P_ENDERS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPE or stack[k][0] in ("td", "th", "li"):
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        node = [_label(tag, m.group(3)), []]
        stack[-1][1][1].append(node)
        if tag in VOID or m.group(3).endswith("/") and tag in ("svg", "iframe"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                at = n
            else:
                stop = page.find(">", end.start())
                at = n if stop < 0 else stop + 1
            continue
        stack.append((tag, node))
    flush()
    return root, blocks, places


def skeleton(tree: list) -> Item:
    """The expression of one page."""
    return merged(tree_item(tree))


def located(tree: list, places: list[tuple[int, int]], wrapper: Wrapper) -> list[str]:
    """The wrapper slot of each block of a page."""
    at = wrapper.locate(tree)
    return [at.get(p, "") for p in places]


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _free(path: tuple[str, ...]) -> bool:
    return not any(x.endswith("!") for x in path)


def extract(blocks: list[tuple[tuple[str, ...], str]], regions: list[str], varies: list[bool] | None = None) -> str:
    """The texts of the first of the wrapper's regions that the page has, else of all that is not dropped.

    ``varies`` tells the blocks that are content from those that are template.
    """
    free = [(path, text) for i, (path, text) in enumerate(blocks) if _free(path) and (varies is None or varies[i])]
    for kind in regions:
        inside = [text for path, text in free if any(x.partition("@")[2] == kind for x in path)]
        if inside:
            return "\n\n".join(inside)
    return "\n\n".join(text for _, text in free)


PARTS, FAN_IN = 4096, 64


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, regions, pages, tree): one wrapper per host, over all its pages (staged).

    Equal streams of a host count once.  Different ones are dealt to parts by a hash and folded part by part, then 64
    parts at a time, each fold reading its rows one by one: no task holds a host, and the result does not depend on how
    many tasks there are.  ``regions`` are the kinds that the host's pages have, ``tree`` the wrapper for ``located``.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "s": [encoded(skeleton(parse(x)[0])) for x in pdf["html"]]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for every run of rows of one host and part."""
        key, wrapper, n = None, None, 0
        for pdf in batches:
            out = []
            for host, part, s, rows in zip(pdf["host"], pdf["part"], pdf["s"], pdf["n"]):
                if (host, part) != key:
                    if key is not None:
                        out.append((*key, wrapper if isinstance(wrapper, str) else encoded(wrapper), n))
                    key, wrapper, n = (host, part), s, 0
                else:
                    wrapper = merged(decoded(wrapper) if isinstance(wrapper, str) else wrapper, decoded(s))
                n += rows
            yield pd.DataFrame(out, columns=["host", "part", "s", "n"])
        if key is not None:
            yield pd.DataFrame([(*key, wrapper if isinstance(wrapper, str) else encoded(wrapper), n)], columns=["host", "part", "s", "n"])

    streams = rows.mapInPandas(read, "host string, s string").groupBy("host", "s").agg(F.count(F.lit(1)).alias("n"))
    left = streams.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(PARTS)))
    parts = PARTS
    while True:
        left = left.repartition("host", "part").sortWithinPartitions("host", "part", F.xxhash64("s"), "s").mapInPandas(
            fold, "host string, part long, s string, n long")
        if parts == 1:
            break
        parts = max(1, parts // FAN_IN)
        left = left.withColumn("part", F.floor(F.col("part") / FAN_IN))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trees = [decoded(s) for s in pdf["s"]]
            found = [regions_of(t) for t in trees]
            yield pd.DataFrame({"host": pdf["host"], "wrapper": [expression(t) for t in trees],
                                "regions": [[k for k in REGIONS if k in f] for f in found], "pages": pdf["n"],
                                "tree": [encoded(t, prune=True) for t in trees]})

    return stage(left.mapInPandas(told, "host string, wrapper string, regions array<string>, pages long, tree string"), "wrappers")


class _Trees(dict):
    """Wrappers by their text, so that a task reads the wrapper of a host once."""

    def __missing__(self, text: str) -> Wrapper:
        if len(self) >= 256:
            self.clear()
        self[text] = Wrapper(text)
        return self[text]


def infer_plans(pages: DataFrame, url_col: str = "url", html_col: str = "html", *, doubt: int = 2,
                region_share: float = 0.25) -> DataFrame:
    """(host, tree, fixed, regions): the wrapper, the (slot, text) hashes that are template, the regions chosen (staged).

    A host's template texts are at most twice as many as the slots' texts of
    its average page, as each stands on half of the pages or more.
    """
    wrappers = infer_wrappers(pages, url_col, html_col)
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.join(wrappers.select("host", "tree"), "host")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _Trees()
        for pdf in batches:
            out = []
            for host, page, tree in zip(pdf["host"], pdf["html"], pdf["tree"]):
                root, blocks, places = _parsed(page)
                free = [(path, text, slot) for (path, text), slot in zip(blocks, located(root, places, trees[tree])) if _free(path)]
                same = _hash(*[x for path, text, _ in free for x in ("/".join(path), text)])
                seen = {}
                for path, text, slot in free:
                    seen[_hash(slot, text)] = (_hash(slot), len(text), sum(
                        1 << j for j, kind in enumerate(REGIONS) if any(x.partition("@")[2] == kind for x in path)))
                out += [(host, same, slot, text, chars, kinds) for text, (slot, chars, kinds) in seen.items()]
            yield pd.DataFrame(out, columns=["host", "page", "slot", "text", "chars", "kinds"])

    texts = stage(rows.mapInPandas(read, "host string, page long, slot long, text long, chars long, kinds int")
                  .dropDuplicates(["host", "page", "text"]), "wrapper-texts")
    slots = texts.groupBy("host", "slot", "page").agg(F.lit(1).alias("one")).groupBy("host", "slot").agg(
        F.count(F.lit(1)).alias("have"))
    fixed = stage(texts.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > doubt)
                  .join(slots, ["host", "slot"]).filter(2 * (F.col("n") - doubt) >= F.col("have")).select("host", "text"), "wrapper-fixed")
    has = lambda j: F.col("kinds").bitwiseAND(1 << j) > 0
    varying = texts.join(fixed, ["host", "text"], "left_anti").groupBy("host", "page").agg(
        F.sum("chars").alias("chars"), *[F.sum(F.when(has(j), F.col("chars"))).alias(k) for j, k in enumerate(REGIONS)])
    shares = varying.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[x for k in REGIONS for x in (
        F.sum(k).alias(k), F.avg(F.when(F.col(k) > 0, F.col("chars"))).alias(f"{k}_page"),
        F.sum(F.when(F.col(k) > 0, F.col("chars"))).alias(f"{k}_of"))])
    chosen = shares.select("host", F.filter(F.array(*[
        F.when(F.col(k) + F.col(f"{k}_page") >= region_share * (F.col(f"{k}_of") + F.col(f"{k}_page")), F.lit(k)) for k in REGIONS]),
        lambda x: x.isNotNull()).alias("regions"))
    out = (wrappers.select("host", "tree").join(fixed.groupBy("host").agg(F.collect_list("text").alias("fixed")), "host", "left")
           .join(chosen, "host", "left"))
    plans = stage(out, "wrapper-plans")
    unstage(wrappers, texts, fixed)
    return plans


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    Character references are decoded, white space inside a block is one
    space, blocks are joined in page order by an empty line; marked parts and
    template texts are dropped, nothing is cut.  Defined results: a null or empty page, or one without
    article text, has the empty text; a null url belongs to the host without
    a name; repeated rows give equal rows; an empty table gives an empty
    result; other columns are not read.
    """
    plans = infer_plans(pages, url_col, html_col).withColumnRenamed("host", "h")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    rows = rows.join(plans, F.col("host") == F.col("h"), "left").select("id", "url", "html", "tree", "fixed", "regions")
    kind = pages.schema[id_col].dataType.simpleString()

    def text_of(page: str, tree: list, fixed: set, regions: list[str]) -> str:
        root, blocks, places = _parsed(page)
        varies = [_hash(slot, text) not in fixed for (_, text), slot in zip(blocks, located(root, places, tree))] if fixed else None
        return extract(blocks, regions, varies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _Trees()
        for pdf in batches:
            texts = [text_of(x, trees[t], set(f) if f is not None else set(), list(r) if r is not None else [])
                     for x, t, f, r in zip(pdf["html"], pdf["tree"], pdf["fixed"], pdf["regions"])]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts})

    out = rows.mapInPandas(run, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
