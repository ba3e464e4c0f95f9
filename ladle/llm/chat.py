"""Chat formatting over typed content parts (DataFrame functions only).

A message has a role and an array of parts: text, image, audio or document.
The visitor walks the parts in order; text is written escaped, any other part
becomes a placeholder, and its reference and the number of tokens that it will
take are recorded.  A conversation is one string of turns

    <|im_start|>ROLE newline CONTENT <|im_end|> newline

with a loss mask: for each assistant turn the span of its text in the turn's
block, in code points.

Escaping is reversible.  Every control string begins with ``<|``; inside texts
a ``<`` followed by any number of backslashes and ``|`` gets one backslash
more, so no text holds ``<|``, and reading takes one away.  Roles escape
backslash and newline, which would end them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
# Tokens that a part takes when it does not say so itself.
DEFAULT_TOKENS: Mapping[str, int] = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    role = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(role, F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def text_part(text: Column) -> Column:
    """A message of a single text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def visit_parts(parts: Column, default_tokens: Mapping[str, int] = DEFAULT_TOKENS) -> tuple[Column, Column]:
    """(content, attachments) of a message: text and placeholders in order, and (type, ref, tokens) of each placeholder."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    names = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    usual = F.create_map(*[F.lit(x) for k, v in default_tokens.items() for x in (k, v)])
    content = F.array_join(F.transform(parts, lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit(""))))
                                       .otherwise(F.coalesce(names[p["type"]], F.lit(OTHER)))), "")
    attachments = F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"),
        F.coalesce(p["tokens"], usual[p["type"]].cast("bigint"), F.lit(1).cast("bigint")).alias("tokens")))
    return content, attachments


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         parts_col: str = "parts", *, loss_roles: tuple[str, ...] = ("assistant",),
                         default_tokens: Mapping[str, int] = DEFAULT_TOKENS) -> DataFrame:
    """One row per conversation: conv, formatted, loss, attachments, expanded_tokens.

    ``loss`` is an array of (turn, from, to): the turn's position and the span
    of its content inside its block; ``attachments`` an array of (turn,
    position, type, ref, tokens); ``expanded_tokens`` the sum of their tokens.
    Attachment placeholders of an assistant turn are under the mask with its text.

    Messages are ordered by turn, then role and content (ties and repeated
    rows stay, in that order); a null turn comes first.  A null text or parts
    is empty, a null role is the empty role, a null conversation is one
    conversation; an empty table gives an empty result; other columns are not
    read.  A conversation is one row by contract, so its rows meet in one task.
    """
    content, attachments = visit_parts(F.col(parts_col), default_tokens)
    rows = messages.select(F.col(conv_col).alias("conv"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("content"),
        attachments.alias("att")).alias("m"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("m")).alias("m"))
    head = lambda m: F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("m", lambda m: F.concat(head(m), m["content"], F.lit(END + "\n"))), "")
    trained = F.transform("m", lambda m, i: F.struct(
        i.alias("turn"), F.length(head(m)).alias("from"), (F.length(head(m)) + F.length(m["content"])).alias("to"),
        m["role"].isin(*loss_roles).alias("on")))
    loss = F.transform(F.filter(trained, lambda x: x["on"]), lambda x: F.struct(x["turn"].alias("turn"), x["from"].alias("from"),
                                                                               x["to"].alias("to")))
    found = F.flatten(F.transform("m", lambda m, i: F.transform(m["att"], lambda a, j: F.struct(
        i.alias("turn"), j.alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return turns.select("conv", formatted.alias("formatted"), loss.alias("loss"), found.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (array of role, text) and ``loss_text`` (the text under the mask) read back.

    Text is unescaped; placeholders stay as they are.
    """
    # a block of each turn, without the start string; the first piece is empty
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2**31 - 1)
    df = formatted.withColumn("_blocks", blocks)
    end = F.length(F.lit(END + "\n"))

    def turn(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(
            b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - end)).alias("text"))

    start = len(START)
    masked = F.transform("loss", lambda s: unescape(F.substring(
        F.get(F.col("_blocks"), s["turn"]), s["from"] - start + 1, s["to"] - s["from"])))
    return df.withColumn("turns", F.transform("_blocks", turn)).withColumn(
        "loss_text", F.array_join(masked, "")).drop("_blocks")
