"""Conversations as one string each, from typed content parts. Built-in expressions only.

A turn's content is an ordered array of parts ``struct<type, text, ref, units>``. Flattening
visits them in order: text is escaped, every other part becomes a placeholder that counts as
``units`` times the tokens of its type, and its reference is recorded. In the string, markers
are the only places where ``<``, ``[`` or ``]`` stand: inside texts, roles and types they and the
backslash are written as two-character codes, which can be read back exactly.

    <s>[user]text</s><s>[assistant]look: [image 0]</s>

NULL texts, roles, references and types are empty, a NULL array has no parts, NULL units are 1, unknown
types cost ``other_tokens`` per unit. Turns with equal numbers are ordered by role, then content;
a NULL turn number comes first; repeated rows are repeated turns. Rows with a NULL conversation id
form one conversation. An empty table gives no rows. One conversation is one output row, so its
turns meet in one task, as the result demands; different conversations spread.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each character that markers use, and how it is written inside texts.
CODES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))

#: Tokens that one unit of an attachment expands to: an image, a second of sound, a page.
TOKENS = {"image": 576, "audio": 25, "document": 1024}

PART = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    """No marker character is left; ``unescape`` gives the text back."""
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as the only part."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("double").alias("units"),
    )
    return F.array(part).cast(PART)


def part_tokens(part: Column, tokens: Mapping[str, int], other_tokens: int) -> Column:
    """Tokens of a placeholder after expansion; 0 for text, which a tokenizer counts."""
    cost = F.lit(other_tokens)
    for kind, per_unit in tokens.items():
        cost = F.when(part["type"] == kind, F.lit(per_unit)).otherwise(cost)
    expanded = F.ceil(F.coalesce(part["units"], F.lit(1.0)) * cost).cast("long")
    return F.when(part["type"] == "text", F.lit(0).cast("long")).otherwise(expanded)


def flatten_parts(
    parts: Column, tokens: Mapping[str, int] = TOKENS, other_tokens: int = 1
) -> Column:
    """``struct<content, attachments>`` of one turn: escaped text with placeholders in order."""
    empty = F.lit("")
    visited = F.transform(
        F.coalesce(parts, F.array().cast(PART)),
        lambda p, i: F.struct(
            F.when(p["type"] == "text", escape(F.coalesce(p["text"], empty)))
            .otherwise(
                F.concat(
                    F.lit("["), escape(F.coalesce(p["type"], empty)), F.lit(" "), i.cast("string"), F.lit("]")
                )
            )
            .alias("piece"),
            F.coalesce(p["type"], empty).alias("type"),
            F.coalesce(p["ref"], empty).alias("ref"),
            i.alias("part"),
            part_tokens(p, tokens, other_tokens).alias("tokens"),
        ),
    )
    return F.struct(
        F.array_join(F.transform(visited, lambda v: v["piece"]), "").alias("content"),
        F.transform(
            F.filter(visited, lambda v: v["type"] != "text"),
            lambda v: F.struct(v["type"], v["ref"], v["part"], v["tokens"]),
        ).alias("attachments"),
    )


def format_chat(
    turns: DataFrame,
    *,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    learn: str = "assistant",
    tokens: Mapping[str, int] = TOKENS,
    other_tokens: int = 1,
) -> DataFrame:
    """One row per conversation: ``id``, ``formatted``, ``loss_spans``, ``attachments`` and
    ``attachment_tokens``.

    A span is ``struct<start, length>`` in characters of ``formatted``, from 0, and covers the
    content of one turn of the role ``learn``. Other input columns are not used.
    """
    flat = turns.select(
        F.col(id).alias("id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        flatten_parts(F.col(parts), tokens, other_tokens).alias("flat"),
    ).select("id", F.struct("turn", "role", "flat.content", "flat.attachments").alias("said"))
    whole = flat.groupBy("id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    heads = whole.select(
        "id",
        "said",
        F.transform(
            "said",
            lambda s: F.struct(
                F.concat(F.lit("<s>["), escape(s["role"]), F.lit("]")).alias("head"),
                s["content"].alias("content"),
                (s["role"] == learn).alias("learn"),
            ),
        ).alias("pieces"),
    )
    tail = F.lit("</s>")
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )

    def visit(so_far: Column, piece: Column) -> Column:
        begin = so_far["at"] + F.length(piece["head"])
        size = F.length(piece["content"]).cast("long")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct(
            (begin + size + F.length(tail)).alias("at"),
            F.when(piece["learn"], F.array_append(so_far["spans"], span))
            .otherwise(so_far["spans"])
            .alias("spans"),
        )

    attachments = F.flatten(
        F.transform(
            "said",
            lambda s, n: F.transform(
                s["attachments"],
                lambda a: F.struct(
                    n.alias("turn_index"),
                    a["type"].alias("type"),
                    a["ref"].alias("ref"),
                    a["part"].alias("part"),
                    a["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return heads.select(
        F.col("id").alias(id),
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["head"], p["content"], tail)), ""
        ).alias("formatted"),
        F.aggregate("pieces", start, visit)["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(
            F.transform(attachments, lambda a: a["tokens"]),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        ).alias("attachment_tokens"),
    )


def read_chat(formatted: DataFrame, *, id: str = "conv_id") -> DataFrame:
    """``id``, ``turns`` (array of role and text) and ``loss_text``, out of ``format_chat``'s rows.

    Placeholders come back as they stand in the string.
    """
    segments = formatted.select(
        F.col(id).alias("id"),
        "formatted",
        "loss_spans",
        F.split("formatted", "</s>").alias("segments"),
    )
    turns = F.transform(
        F.filter("segments", lambda s: F.length(s) > 0),
        lambda s: F.struct(
            unescape(F.regexp_extract(s, r"(?s)^<s>\[([^\]]*)\]", 1)).alias("role"),
            unescape(F.regexp_extract(s, r"(?s)^<s>\[[^\]]*\](.*)$", 1)).alias("text"),
        ),
    )
    masked = F.transform(
        "loss_spans",
        lambda s: unescape(
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
    return segments.select(
        F.col("id").alias(id),
        "formatted",
        turns.alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
    )
