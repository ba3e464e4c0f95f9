"""URL filtering by rules and by a path-template tree (DataFrame functions only).

Every host has a tree of path segments, grown level by level.  A segment stays
a branch of its own where its pages are many for its node: a constant of the
site.  Other segments are variable and become wildcards by shape (``<n>`` for
numbers, ``*`` else).  Sibling branches whose shares of bad pages a two-sample
test finds alike are merged.  What is left are templates; a template is
rejected when its share of bad among labelled pages, smoothed by ``strength``
pseudo-pages of the overall share, reaches ``purity``.

Only counts by (host, template, segment) are shuffled, combined in the tasks
that read the rows; the branches' names and the templates' verdicts are joined
back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; ``rules`` are (verdict, host/path prefix), a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    return F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), "<n>").otherwise("*")


def branch_names(children: DataFrame, *, support: int, share: float, z: float, gap: float) -> DataFrame:
    """(host, template, seg, name): what the segments below a node are called, for those that are branches of their own.

    ``children``: host, template, seg, n (pages), seen and worse (labelled and bad ones).  A segment is a branch if
    ``support`` pages have it and these are ``share`` of the node's, or more than ``z`` standard errors above the mean of
    its siblings: constants of a site, not variables.  Branches next to each other in order of their share of bad pages
    merge where a two-sample test finds no difference and has labels enough to find one of ``gap``; what nobody
    labelled is not known to be alike and stays apart."""
    node = children.groupBy("host", "template").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    mean = F.col("all") / F.col("kinds")
    own = children.where(F.col("n") >= support).join(node, ["host", "template"]).where(
        (F.col("n") >= share * F.col("all")) | (F.col("n") > mean + z * F.sqrt(mean)))
    rate = (F.col("worse") + 0.5) / (F.col("seen") + 1)
    w = Window.partitionBy("host", "template").orderBy("rate", "seg")
    before = own.withColumn("rate", rate).withColumns({f"_{c}": F.lag(c).over(w) for c in ("seen", "worse", "rate")})
    pooled = (F.col("worse") + F.col("_worse") + 0.5) / (F.col("seen") + F.col("_seen") + 1)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("seen", F.lit(1)) + 1 / F.greatest("_seen", F.lit(1))))
    alike = (F.col("seen") > 0) & (F.col("_seen") > 0) & (F.col("rate") - F.col("_rate") <= z * error) & (z * error <= gap)
    joined = before.withColumn("group", F.sum(F.when(alike, 0).otherwise(1)).over(w))
    names = joined.groupBy("host", "template", "group").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("members"))
    token = F.when(F.col("members") == 1, F.col("first")).otherwise(
        F.concat(F.lit("["), F.col("first"), F.lit(" +"), (F.col("members") - 1).cast("string"), F.lit("]")))
    return joined.join(names, ["host", "template", "group"]).select("host", "template", "seg", token.alias("name"))


def path_templates(rows: DataFrame, *, support: int, share: float, z: float, gap: float) -> DataFrame:
    """``rows`` (host, path, bad) with their ``template``; ``bad`` is 1, 0 or null (no label).

    The tree grows level by level, as deep as the paths are.  Where fewer pages of a host than ``support`` are left, no
    segment can be a branch, so the rest of their paths is generalised at once."""
    carried = rows.columns
    left = stage(rows.withColumns({"parts": F.filter(F.split("path", "/"), lambda s: s != ""), "template": F.lit("")}), "url-level")
    done, level = None, 0
    while True:
        more = F.size("parts") > level
        count = left.where(more).groupBy("host").agg(F.count(F.lit(1)).alias("left"))
        marked = left.join(count, "host", "left").withColumn("grows", more & (F.col("left") >= support))
        rest = F.array_join(F.transform(F.slice("parts", F.lit(level + 1), F.greatest(F.size("parts") - level, F.lit(0))),
                                        lambda s: F.concat(F.lit("/"), _shape(s))), "")
        ended = marked.where(~F.col("grows")).select(*carried, F.concat("template", rest).alias("template"))
        done = ended if done is None else done.unionByName(ended)
        growing = marked.where("grows").withColumn("seg", F.get("parts", F.lit(level))).drop("left", "grows")
        children = stage(growing.groupBy("host", "template", "seg").agg(
            F.count(F.lit(1)).alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("worse")), "url-children")
        if children.isEmpty():
            return done
        names = stage(branch_names(children, support=support, share=share, z=z, gap=gap), "url-branches")
        grown = growing.join(names, ["host", "template", "seg"], "left").withColumn(
            "template", F.concat("template", F.lit("/"), F.coalesce("name", _shape(F.col("seg"))))).drop("name", "seg")
        left, level = stage(grown, "url-level"), level + 1
        unstage(children)


def text_labels(pages: DataFrame, documents: DataFrame, labels: DataFrame, id_col: str = "page_id", html_col: str = "html",
                doc_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, cover: float = 0.25) -> DataFrame:
    """(id, bad) of the pages that show the text of labelled documents.

    A page's lines are what stands between its tags; a line counts with one vote, shared by the labelled documents that
    hold it, so a line of many documents says little.  A page has a label if its votes are ``cover`` of its lines or
    more, and is bad if half of the votes are.  ``labels``: (id, bad) of documents.  Lines under ``least_chars`` characters say nothing.  Lines are counted per text first, and
    a page's line is one row, so neither a common line nor a long page multiplies rows."""
    known = labels.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.max("bad").alias("bad"))

    def lines(text: Column, cut: str) -> Column:
        parts = F.transform(F.split(F.coalesce(text, F.lit("")), cut), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
        return F.array_distinct(F.transform(F.filter(parts, lambda s: F.length(s) >= least_chars), lambda s: F.xxhash64(s)))

    # texts become hashes of lines before the join, so that no text is shuffled
    own = documents.select(F.col(f"`{doc_col}`").alias("doc"), lines(F.col(f"`{text_col}`"), r"\n").alias("lines"))
    held = own.join(known, F.col("doc") == F.col("_id")).select("bad", F.explode("lines").alias("line"))
    votes = held.groupBy("line").agg(F.avg("bad").alias("vote"), F.count(F.lit(1)).alias("docs"))
    shown = pages.select(F.col(f"`{id_col}`").alias("id"), lines(F.col(f"`{html_col}`"), r"<[^>]*>|\n").alias("lines"))
    shown = shown.select("id", F.size("lines").alias("size"), F.explode("lines").alias("line"))
    found = shown.join(votes, "line").groupBy("id").agg(
        F.sum(F.col("vote") / F.col("docs")).alias("for"), F.sum(1 / F.col("docs")).alias("all"), F.max("size").alias("size"))
    return found.where(F.col("id").isNotNull() & (F.col("all") >= cover * F.col("size"))).select("id", (2 * F.col("for") >= F.col("all")).cast("int").alias("bad"))


def judge_urls(pages: DataFrame, labels: DataFrame | None, rules: Sequence[tuple[str, str]] = (),
               id_col: str = "page_id", url_col: str = "url", *, support: int = 5, share: float = 0.02, z: float = 2.58,
               gap: float = 0.3, strength: float = 10.0, purity: float = 0.4) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, template_purity.

    ``labels``: (id, bad), bad 1 or 0; several labels of an id count as bad if
    one is.  The verdict is the rule's, else block if the template's smoothed
    purity reaches ``purity``, else allow.

    Defined results: a null url or one without ``://`` has empty host and
    path (and the empty template); repeated rows are judged alike; without
    labels, or on an empty table, nothing is blocked by the method; other
    columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if labels is None:
        labels = spark.createDataFrame([], f"id {pages.schema[id_col].dataType.simpleString()}, bad int")
    known = labels.filter("id is not null").groupBy(F.col("id").alias("_id")).agg(F.max("bad").cast("int").alias("bad"))
    rows = stage(rows.join(known, F.col("id") == F.col("_id"), "left").drop("_id"), "urls")
    total = rows.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")).first()
    overall = (int(total["k"]) + 0.5) / (int(total["n"]) + 1)
    placed = stage(path_templates(rows, support=support, share=share, z=z, gap=gap), "url-templates")
    stats = placed.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(
        F.count("bad").alias("_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("_k"))
    stats = stage(stats.withColumn("template_purity", (F.col("_k") + strength * overall) / (F.col("_n") + strength)), "url-purity")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("template_purity") >= purity) & (F.col("_n") > 0), "block").otherwise("allow")
    return placed.join(stats, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "template",
        "template_purity")
