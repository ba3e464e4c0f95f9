"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers.  These are the seeds: the words around them are lexical patterns, and
the words around other identifier-shaped phrases (tokens with four digits or
more, digit groups with white space between, e-mail forms with or
without digits, IPv6 addresses) are collected too.  Spark then scores the bipartite graph of patterns
and instances, kind by kind:

*   a pattern's confidence is the share of accepted among the different
    identifier-shaped strings it surrounds, with ``prior`` pseudo-rejections
    (a part of a longer phrase counts only if it is accepted);
*   an instance that is still unknown is accepted when a pattern with at least
    ``support`` different accepted strings has a confidence of ``confidence``
    or more for a kind that the string's shape allows.

Accepted instances raise further patterns, so the step repeats until nothing
new is accepted (the accepted set only grows, so it ends).  Strings are counted
once per pattern, so copies of a document have no extra say.  Accepted
occurrences are added to the base spans, which always stay; those inside a
longer accepted one are left out.

Offsets come from the text between matches: Spark has no function that gives a
match's position, but ``split`` and ``regexp_extract_all`` by one pattern give
the pieces and the matches in turn, whose lengths add up to offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the base patterns: the same matches, but no backtracking
# over long runs (what follows each run cannot be part of it).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# An identifier-shaped token: no white space, four digits or more.
TOKEN = r"(?<![^ \t-\r])(?:[^ \t-\r0-9]*+[0-9]){4}[^ \t-\r]*+"
# A group of digits at the start of a token; phrases are made of neighbouring ones.
PIECE = r"(?<![^ \t-\r])[(]?[0-9][0-9().-]*+(?![^ \t-\r,;:!?'\"\]])"
# The words beside a match; each is found in one run over the piece, however long its words are.
LAST_WORD = r"(?<![^ \t-\r])([^ \t-\r]++)\z"
FIRST_WORD = r"\A([^ \t-\r]++)"
NEAR = 48
MOST_DIGITS = 19
# E-mail forms: any host, the sign written out in brackets or as a word.
_L = r"[^ \t-\r@<>()\[\]{},;:\"'|]"
MAIL = (rf"(?<!{_L}){_L}++(?:@{_L}++| ?[\[({{](?i:at)[\])}}] ?{_L}++(?: ?[\[({{](?i:dot)[\])}}] ?{_L}++)*+"
        rf"| (?i:at) {_L}++(?: (?i:dot) {_L}++)++)")
IPV6 = r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:])"
FORMS = {"token": TOKEN, "piece": PIECE, "mail": MAIL, "v6": IPV6}
PRESENT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "piece": lambda t: t.rlike(r"[0-9][().-]*+[ \t-\r][(]?[0-9]"),
    "mail": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"(?i)[\[({]at[\])}]| at [^ \t-\r]++ dot "),
    "v6": lambda t: F.contains(t, F.lit("::")) | t.rlike(r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    "token": lambda t: t.rlike(r"[0-9][^ \t-\r0-9]*+[0-9][^ \t-\r0-9]*+[0-9]"),
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(sum(divmod(2 * x, 10))) for x in range(10)]),
                         F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _located(df: DataFrame, text: Column, name: str, pattern: str) -> DataFrame:
    """``df`` with column ``name``: array of (start, end, s, left, right), ends exclusive, in code points.

    Offsets are prefix sums in two levels (within a chunk of about sqrt(n)
    lengths, and over chunk sums), so n matches cost n ** 1.5 steps, not n ** 2.
    """
    there = PRESENT[name](text)
    df = df.withColumn("_m", F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_l", F.transform(F.col("_m"), lambda m, i: F.length(F.get(F.col("_p"), i)) + F.length(m)))
    df = df.withColumn("_k", F.greatest(F.ceil(F.sqrt(F.size("_l"))).cast("int"), F.lit(1)))
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    k, lens = F.col("_k"), F.col("_l")
    df = df.withColumn("_c", F.when(F.size("_l") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / k).cast("int")),
        lambda c: add(F.slice(lens, c * k + 1, k)))))
    before = lambda i: (add(F.slice(F.col("_c"), F.lit(1), F.floor(i / k).cast("int")))
                        + add(F.slice(lens, F.floor(i / k).cast("int") * k + 1, i % k)))
    blank = F.lit(" \t\n\x0b\x0c\r")

    def word(near: Column, piece: Column, pattern: str) -> Column:
        """The neighbour word: mostly within ``NEAR`` code points; else it is read from the whole piece."""
        w = F.regexp_extract(near, pattern, 1)
        return F.lower(F.when(F.length(w) < NEAR, w).otherwise(F.regexp_extract(piece, pattern, 1)))

    def one(m: Column, i: Column) -> Column:
        before_it, after = F.rtrim(F.get(F.col("_p"), i), blank), F.ltrim(F.get(F.col("_p"), i + 1), blank)
        end = before(i) + F.get(lens, i)
        return F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("s"),
            word(F.right(before_it, F.lit(NEAR)), before_it, LAST_WORD).alias("left"),
            word(F.left(after, F.lit(NEAR)), after, FIRST_WORD).alias("right"))

    empty = F.array().cast("array<struct<start:int,end:int,s:string,left:string,right:string>>")
    return df.withColumn(name, F.coalesce(F.transform(F.col("_m"), one), empty)).drop("_m", "_p", "_l", "_k", "_c")


def _checked(number: int, kind: str) -> Column:
    """The matches of a kind that pass its check, as (start, kind, end, s, left, right)."""
    return F.transform(F.filter(kind, lambda x: _valid(kind, x["s"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["s"].alias("s"),
        x["left"].alias("left"), x["right"].alias("right")))


def locate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of the text, base (array of kind number, start, end, s, left, right) and cand (phrases outside base spans)."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumn("h", F.xxhash64("t"))
    for name, pattern in [*PATTERNS.items(), *FORMS.items()]:
        df = _located(df, F.col("t"), name, pattern)
    kinds = [_checked(j, k) for j, k in enumerate(KINDS)]
    df = df.withColumn("base", F.sort_array(F.concat(*kinds)))
    df = df.withColumn("groups", _groups(F.col("piece")))
    df = df.withColumn("phrase", _phrases(F.col("groups")))
    core = r"^[^\p{L}\p{N}+(]*"
    # without the marks around it
    trimmed = F.transform(F.concat("token", "mail"), lambda x: F.struct(
        (x["start"] + F.length(F.regexp_extract(x["s"], core, 0))).alias("start"),
        (x["end"] - F.length(F.regexp_extract(x["s"], r"[^\p{L}\p{N}]*$", 0))).alias("end"),
        F.regexp_replace(F.regexp_replace(x["s"], core, ""), r"[^\p{L}\p{N}]*$", "").alias("s"),
        x["left"].alias("left"), x["right"].alias("right"), F.lit(False).alias("part")))
    v6 = F.transform("v6", lambda x: x.withField("part", F.lit(False)))
    shaped = F.filter(F.concat(trimmed, F.col("phrase"), v6), lambda x: _shapes(x["s"]) > 0)
    free = F.filter(shaped, lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    df = df.withColumn("sorted", F.sort_array(free))  # to drop repeats beside each other: a long text has very many
    fresh = F.filter("sorted", lambda x, i: ~x.eqNullSafe(F.get(F.col("sorted"), i - 1)))
    return df.withColumn("cand", fresh).select("id", "h", "base", "cand")


def _groups(pieces: Column) -> Column:
    """Digit groups with their number of digits, the length of the marks at the end, their brackets, and whether one
    white space stands between the one before and them."""
    near = lambda x, i: F.coalesce(F.get(pieces, i - 1)["end"] + 1 == x["start"], F.lit(False))
    tail = lambda x: F.length(F.regexp_extract(x["s"], r"[^0-9]*$", 0))
    return F.transform(pieces, lambda x, i: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), x["left"].alias("left"), x["right"].alias("right"),
        near(x, i).alias("near"), F.length(_digits(x["s"])).alias("d"), tail(x).alias("tail"), x["s"].startswith("(").alias("open"),
        F.contains(x["s"], F.lit(")")).alias("close")))


def _phrases(pieces: Column) -> Column:
    """Phrases of two or more digit groups with one white space between and 7 to 19 digits in all; ``part``: a longer
    one has it inside.  A group has a digit or more, so 19 groups are the most."""
    def near(i: Column) -> Column:
        return F.coalesce(F.get(pieces, i)["near"], F.lit(False))

    # elements are read one by one: a slice would copy the whole array each time
    def of(i: Column, k: Column) -> Column:
        own = F.sequence(i, i + k - 1)
        first, last = F.get(pieces, i), F.get(pieces, i + k - 1)
        digits = F.aggregate(own, F.lit(0), lambda a, j: a + F.get(pieces, j)["d"])
        before, after = F.get(pieces, i - 1), F.get(pieces, i + k)
        part = (near(i) & (digits + F.coalesce(before["d"], F.lit(MOST_DIGITS)) <= MOST_DIGITS)) | (
            near(i + k) & (digits + F.coalesce(after["d"], F.lit(MOST_DIGITS)) <= MOST_DIGITS))
        s = F.array_join(F.transform(own, lambda j: F.get(pieces, j)["s"]), " ")
        closed = F.exists(F.sequence(i, i + k - 2), lambda j: F.get(pieces, j)["close"])
        lead = F.when(first["open"] & ~closed, 1).otherwise(0)
        return F.when(digits.between(7, MOST_DIGITS), F.struct(
            (first["start"] + lead).alias("start"), (last["end"] - last["tail"]).alias("end"),
            F.substring(s, lead + 1, last["end"] - first["start"] - last["tail"] - lead).alias("s"), first["left"].alias("left"),
            last["right"].alias("right"), part.alias("part")))

    def from_start(i: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(2), F.least(F.lit(MOST_DIGITS), F.size(pieces) - i)),
                         lambda k: F.forall(F.sequence(i + 1, i + k - 1), near))
        return F.transform(sizes, lambda k: of(i, k))

    starts = F.filter(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: near(i + 1))
    return F.when(F.size(pieces) > 1, F.filter(F.flatten(F.transform(starts, from_start)), lambda x: x.isNotNull())).otherwise(
        F.array().cast("array<struct<start:int,end:int,s:string,left:string,right:string,part:boolean>>"))


def _bit(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(1 << j) for j in range(len(KINDS))]), kind)


def _shapes(s: Column) -> Column:
    """Bits of the kinds that a phrase's shape allows."""
    n = F.length(_digits(s))
    numeric = s.rlike(r"^[+(]?[0-9][0-9 ().-]*$")
    return (F.when(s.rlike(
        r"(?i)[\p{L}\p{N}](?:@| ?[(\[{]at[)\]}] ?)[\p{L}\p{N}]|^[^ ]+ at [^ ]+ dot [\p{L}\p{N}]"), 1).otherwise(0)
            + F.when(s.rlike(r"^[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}$") | s.rlike(
                r"(?i)^(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=[:0-9a-f]*::)(?=[^0-9a-f]*[0-9a-f])[:0-9a-f]+)$"), 2).otherwise(0)
            + F.when(numeric & n.between(12, 19), 4).otherwise(0)
            + F.when(numeric & n.between(7, 15), 8).otherwise(0))


def _patterns(x: Column) -> Column:
    """Lexical patterns of an occurrence: both neighbours, the left one, the right one."""
    return F.array(F.concat(x["left"], F.lit(" _ "), x["right"]), F.concat(x["left"], F.lit(" _")),
                   F.concat(F.lit("_ "), x["right"]))


def discover(found: DataFrame, *, confidence: float, support: int, prior: float) -> DataFrame:
    """(s, kind) of the unknown strings that the pattern graph accepts."""
    seeds = found.select(F.explode("base").alias("x")).select(
        F.explode(_patterns(F.col("x"))).alias("pattern"), F.col("x.s").alias("s"),
        _bit(F.col("x.kind")).alias("kinds"), F.lit(True).alias("seed"), F.lit(False).alias("part"))
    # a part of a longer phrase has a number beside it: one neighbour alone says nothing of the part
    others = found.select(F.explode("cand").alias("x")).select(
        F.explode(F.slice(_patterns(F.col("x")), F.lit(1), F.when(F.col("x.part"), 1).otherwise(3))).alias("pattern"), F.col("x.s").alias("s"),
        _shapes(F.col("x.s")).alias("kinds"), F.lit(False).alias("seed"), F.col("x.part").alias("part"))
    edges = stage(seeds.union(others).groupBy("pattern", "s").agg(F.max("kinds").alias("kinds"), F.max("seed").alias("seed"),
                                                                         F.min("part").alias("part")),
                  "pii-edges")
    spark = found.sparkSession
    accepted, n = spark.createDataFrame([], "s string, kind int"), 0
    while True:
        known = edges.join(accepted, "s", "left").withColumn(
            "as", F.when(F.col("seed"), F.col("kinds")).otherwise(
                F.coalesce(_bit(F.col("kind")), F.lit(0))))
        counts = known.groupBy("pattern").agg(
            F.count(F.when(~F.col("part") | (F.col("as") > 0), 1)).alias("n"),
            *[F.count(F.when(F.col("as").bitwiseAND(1 << j) > 0, 1)).alias(f"n{j}") for j in range(len(KINDS))])
        share = F.array(*[F.struct((F.col(f"n{j}") / (F.col("n") + F.lit(prior))).alias("c"), F.col(f"n{j}").alias("n"),
                                   F.lit(j).alias("kind")) for j in range(len(KINDS))])
        sure = (counts.select("pattern", F.explode(share).alias("k"))
                .filter((F.col("k.c") >= confidence) & (F.col("k.n") >= support))
                .select("pattern", F.col("k.kind").alias("kind"), F.col("k.c").alias("c")))
        hits = (edges.filter(~F.col("seed")).join(sure, "pattern")
                .filter(F.col("kinds").bitwiseAND(_bit(F.col("kind"))) > 0)
                .groupBy("s").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"))).alias("best"))
                .select("s", (-F.col("best.k")).alias("kind")))
        # what was accepted keeps its kind
        new = stage(accepted.union(hits.join(accepted, "s", "left_anti")), "pii-accepted")
        unstage(accepted)
        accepted, before, n = new, n, new.count()
        if n == before:
            break
    unstage(edges)
    return accepted


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, confidence: float = 0.9,
             support: int = 5, prior: float = 0.5) -> DataFrame:
    """One row per input row: id, h (hash of the text), base and spans.

    ``base`` and ``spans`` are arrays of (start, kind, end), sorted; ``kind``
    is a position in ``KINDS``.  ``spans`` are the base spans and the
    discovered ones.

    Defined results: a null or empty text has no spans; rows with the same id
    and text get the same spans; an empty table gives an empty result; other
    columns are not read.
    """
    found = stage(locate(docs, id_col, text_col), "pii")
    accepted = discover(found, confidence=confidence, support=support, prior=prior)
    added = (found.select("id", "h", F.explode("cand").alias("x"))
             .join(accepted, F.col("x.s") == F.col("s"))
             .select("id", "h", F.col("x.start").alias("start"), "kind", F.col("x.end").alias("end")).distinct())
    ahead = Window.partitionBy("id", "h").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    added = (added.withColumn("reached", F.max("end").over(ahead))
             .filter(F.col("reached").isNull() | (F.col("reached") < F.col("end")))
             .groupBy("id", "h").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    a, b = found.alias("a"), added.alias("b")
    out = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return out.select(F.col("a.id").alias("id"), F.col("a.h").alias("h"), base.alias("base"),
                      F.sort_array(F.concat(base, F.coalesce("more", empty))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans merge."""
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], x["end"]).alias("pos"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]),
                                   F.get(name, x["kind"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; all columns and rows stay, null texts too."""
    spans = find_pii(docs, id_col, text_col, **settings).filter(F.size("spans") > 0).select(
        "id", "h", "spans").dropDuplicates(["id", "h"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("at"), F.col(text_col).alias("t"))
    joined = rows.join(spans, F.col("at").eqNullSafe(F.col("id"))
                       & (F.xxhash64(F.coalesce(F.col("t"), F.lit(""))) == F.col("h")), "left")
    clean = F.when(F.col("spans").isNull(), F.col("t")).otherwise(redacted(F.col("t"), F.col("spans")))
    return joined.select(F.col("row").withField(text_col, clean).alias("row")).select("row.*")
