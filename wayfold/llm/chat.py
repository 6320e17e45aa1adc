"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an array of parts (type, text, ref, units). A visitor flattens the parts in order: text is escaped, an
image, audio or document part becomes a numbered placeholder, and its reference, number and expanded token count are
recorded. The template is

    ### ROLE: CONTENT</turn>

with a line feed after each turn. Inside roles and texts every ``\\ < #`` (and ``:`` in a role) is replaced by a backslash and a
letter, so no text can contain a mark of the template, and undoing the replacements gives back the exact text. Loss spans
are code point offsets of assistant contents in the formatted string.

Cases: null texts, roles and part lists are empty; a part of unknown type counts as text; turns with equal numbers are ordered by
role and content, null numbers first; rows repeated in full are turns of their own; a null conversation id is one
conversation; an empty table gives an empty table. A conversation is one value of the result, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import col

PART = "struct<type:string,text:string,ref:string,units:bigint>"
# Tokens that a placeholder stands for: a fixed number, and so many for each unit (image tile, audio second, document page).
EXPANDED = {"image": (85, 170), "audio": (2, 25), "document": (0, 600)}
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_END = "</turn>\n"


def text_parts(text: Column) -> Column:
    """The parts of a turn that has only a text."""
    nothing = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def escaped(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, safe in (*_ESCAPES, *((":", "\\c"),) * role):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescaped(text: Column) -> Column:
    for plain, safe in reversed((*_ESCAPES, (":", "\\c"))):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*EXPANDED), F.lit(False))


def _expanded_tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (fixed, each) in EXPANDED.items():
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)).cast("long")
        out = F.when(part["type"] == kind, F.lit(fixed) + F.lit(each) * units).otherwise(out)
    return out


def _visit(part: Column, number: Column) -> Column:
    placeholder = F.concat(F.lit("<"), part["type"], F.lit(" "), number.cast("string"), F.lit(">"))
    return F.when(_is_attachment(part), placeholder).otherwise(escaped(part["text"]))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text",
) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is the array of content parts; without it, the text column is the only part of a turn.
    """
    content = F.coalesce(parts if parts is not None else text_parts(col(text_col)), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"),
        F.transform(content, lambda p: F.coalesce(p, F.struct(F.lit("text").alias("type"), F.lit("").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")).cast(PART))).alias("parts"),
    )
    found = F.filter("parts", _is_attachment)
    rows = rows.withColumn("found", F.size(found))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("number", F.coalesce(F.sum("found").over(before), F.lit(0)).cast("long"))
    # The number of a part: attachments of earlier turns, and those before it in its own turn.
    numbered = F.transform(
        "parts", lambda p, i: _visit(p, F.col("number") + F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i + 1), _is_attachment))),
    )
    rows = rows.withColumn("content", F.array_join(numbered, ""))
    rows = rows.withColumn("head", F.concat(F.lit("### "), escaped(F.col("role"), True), F.lit(": ")))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(_END)))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)).cast("long"))
    first = F.col("start") + F.length("head")
    rows = rows.withColumn("span", F.when(F.col("role") == "assistant", F.struct(first.alias("start"), (first + F.length("content")).alias("end"))))
    kept = F.transform(
        found,
        lambda p, i: F.struct(
            (F.col("number") + i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded_tokens(p).alias("tokens"),
        ),
    )
    rows = rows.withColumn("kept", kept)
    grouped = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"), F.array_sort(F.flatten(F.collect_list("kept"))).alias("attachments"),
    )
    return grouped.select(
        "conv_id", "n_turns", F.array_join(F.col("pieces")["piece"], "").alias("formatted"), "loss_spans", "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string; placeholders stay as they are in a text."""
    pieces = F.filter(F.split(formatted, _END), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(5)), ": ", 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, ": ") + 2)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))
