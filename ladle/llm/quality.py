"""Quality rules by weak supervision (DataFrame functions only).

Every rule votes good (1), bad (0) or abstains (-1) on a document.  The votes
are counted per vote pattern over all documents -- at most ``3 ** rules`` rows,
a bound of the operator and not of the data -- and expectation-maximisation on
that table estimates, for each rule, how often it says "good" on a good and on
a bad document (given that it votes at all) and the share of good documents.
A document is kept when its posterior probability of being good reaches
``threshold``: no single rule decides, an inaccurate one is outvoted.

Defined results: a null or blank text has no words, all counts are 0 and it
fails the base rule; repeated rows are judged alike; an empty table gives an
empty result; other columns are passed through, and output columns replace
input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, stage, words

SYMBOLS = "#*$%&|<>"
ABSTAIN = -1
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_caps", "n_closed", "n_bangs",
              "n_bare", "n_distinct", "n_repeat_words")


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and the statistics the rules read, all computed inside each row over the whole text.

    ``n_repeat_words`` counts the words covered by a three-word window that is
    found at least twice in the text.  Windows are compared by a 64-bit hash:
    first distinct against all, and only texts with a repeated window are
    sorted to find which words the repeated windows cover.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_w", words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    df = df.withColumn("_lines", lines)
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_caps": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
        "n_closed": F.regexp_count(text, F.lit(r"(?m)[.!?。]" + WS_CLASS + "*$")).cast("long"),
        "n_bangs": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "n_bare": F.regexp_count(text, F.lit(r" [^\p{L}\p{N}\s]{1,3}(?= )")).cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
    })
    w = F.col("_w")
    grams = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(w) - 2),
                    lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))
    df = df.withColumn("_g", F.coalesce(grams, F.array().cast("array<bigint>")))
    df = df.withColumn("_twice", F.size(F.array_distinct("_g")) < F.size("_g"))
    pairs = F.sort_array(F.transform(F.col("_g"), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_s", F.when(F.col("_twice"), pairs))
    s = F.col("_s")
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"]))
                     | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    df = df.withColumn("n_repeat_words", F.coalesce(
        F.when(F.col("_twice"), F.size(F.array_distinct(covered))), F.lit(0)).cast("long"))
    return df.drop("_w", "_lines", "_g", "_twice", "_s")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(ABSTAIN).cast("int")


def rule_votes() -> dict[str, Column]:
    """Each rule's vote, from the statistics columns.  Integer comparisons only."""
    c = F.col
    n, lines = c("n_words"), F.greatest(c("n_lines"), F.lit(1))
    mean_ok = (c("word_chars") >= 3 * n) & (c("word_chars") <= 7 * n)
    return {
        "word_length": _vote(mean_ok, (c("word_chars") < 2 * n) | (10 * c("word_chars") > 68 * n)),
        "symbols": _vote(100 * c("n_symbols") <= n, 100 * c("n_symbols") > 10 * n),
        "repeated_lines": _vote(F.lit(False), (5 * c("n_dup_lines") >= lines) & (c("n_dup_lines") > 1)),
        "repeated_words": _vote(100 * c("n_repeat_words") <= 20 * n, 100 * c("n_repeat_words") > 35 * n),
        "capitals": _vote(100 * c("n_caps") <= 8 * c("word_chars"), 100 * c("n_caps") > 25 * c("word_chars")),
        "closed_lines": _vote(10 * c("n_closed") >= 7 * lines, 4 * c("n_closed") < lines),
        "bangs": _vote(100 * c("n_bangs") <= 5 * n, 100 * c("n_bangs") > 40 * n),
        "bare_marks": _vote(100 * c("n_bare") <= 2 * n, 100 * c("n_bare") > 10 * n),
        "vocabulary": _vote(100 * c("n_distinct") >= 45 * n, 100 * c("n_distinct") < 25 * n),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rules: int, *, prior: float = 0.85,
              good_says_good: float = 0.99, bad_says_good: float = 0.6, strength: float = 2.0,
              tolerance: float = 1e-10) -> dict:
    """Expectation-maximisation on vote-pattern counts.

    It starts from rules that seldom object to a good document and object to a
    bad one in ``1 - bad_says_good`` of all cases (a rule knows one kind of
    junk and passes the others).  ``strength`` pseudo-votes at these values
    keep the estimates inside (0, 1) and the classes from changing places.  The
    patterns are summed in sorted order with ``math.fsum``, so reruns agree.
    """
    patterns = sorted(patterns)
    good = [good_says_good] * rules    # P(vote = good | good document, the rule votes)
    bad = [bad_says_good] * rules      # P(vote = good | bad document, the rule votes)
    share, last = prior, -math.inf
    rounds = 0
    while patterns:
        rounds += 1
        post, ll = [], []
        for votes, n in patterns:
            a, b = math.log(share), math.log(1 - share)
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    a += math.log(good[j] if v else 1 - good[j])
                    b += math.log(bad[j] if v else 1 - bad[j])
            top = max(a, b)
            z = top + math.log(math.exp(a - top) + math.exp(b - top))
            post.append(math.exp(a - z))
            ll.append(n * z)
        total = math.fsum(n for _, n in patterns)
        share = (math.fsum(p * n for p, (_, n) in zip(post, patterns)) + strength * prior) / (total + strength)
        for j in range(rules):
            at = [(p, n, votes[j]) for p, (votes, n) in zip(post, patterns) if votes[j] != ABSTAIN]
            for k, w in ((good, [p * n for p, n, _ in at]), (bad, [(1 - p) * n for p, n, _ in at])):
                start = good_says_good if k is good else bad_says_good
                said = math.fsum(x for x, (_, _, v) in zip(w, at) if v == 1)
                k[j] = (said + strength * start) / (math.fsum(w) + strength)
        now = math.fsum(ll)
        if now - last <= tolerance * abs(now):  # the likelihood never falls, so this ends
            break
        last = now
    return {"share": share, "good": good, "bad": bad, "rounds": rounds}


def log_odds(model: dict, votes: list[Column]) -> Column:
    """Log odds of a good document from its votes."""
    out = F.lit(math.log(model["share"] / (1 - model["share"])))
    for j, v in enumerate(votes):
        g, b = model["good"][j], model["bad"][j]
        out = out + (F.when(v == 1, F.lit(math.log(g / b))).when(v == 0, F.lit(math.log((1 - g) / (1 - b))))
                     .otherwise(F.lit(0.0)))
    return out


def judge_quality(docs: DataFrame, text_col: str = "text", *, min_words: int = 50, max_repeat_pct: int = 50,
                  threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``carry``) with the statistics, base_failed, posterior quality and kept.

    The judged rows are written once to the shared folder, so the texts are
    analysed in one scan; the vote patterns are counted from that table.  ``base_failed`` is the hard rule (fewer than ``min_words``
    words, or more than ``max_repeat_pct`` percent of them in repeated
    three-word windows); every other document goes by its posterior, under a
    model fitted to the votes on all documents that the hard rule passes.
    """
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    out = [*STATISTICS, "base_failed", "quality_posterior", "kept"]
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in out]
    # the row travels as one struct, so that no column name of the input can clash
    packed = docs.select(F.struct(F.lit(1).alias("_"), *[F.col(c) for c in rest]).alias("row"),
                         F.col(text_col).alias("text"))
    stats = stage(word_statistics(packed).withColumn("base_failed", failed).drop("text"), "quality")
    votes = rule_votes()
    names = list(votes)
    counted = (stats.filter(~F.col("base_failed")).select(*[v.alias(k) for k, v in votes.items()])
               .groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3 ** len(names) rows
    model = fit_rules([(tuple(int(r[k]) for k in names), int(r["n"])) for r in counted], len(names))
    odds = log_odds(model, list(votes.values()))
    judged = (stats.withColumn("quality_posterior", 1 / (1 + F.exp(-odds)))
              .withColumn("kept", ~F.col("base_failed") & (odds >= math.log(threshold / (1 - threshold)))))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in rest], *out)


def keep_good(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows and columns of ``docs`` that the rules keep."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    judged = judge_quality(packed, "text", carry=["row"], **settings)
    return judged.filter("kept").select("row.*")
