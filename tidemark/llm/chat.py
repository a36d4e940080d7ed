"""Chat formatting: typed content parts flattened into one reversible template.

A turn's content is an ordered list of parts, each of type text, image, audio or document. A visitor (a CASE over
the type, applied with transform) turns text into escaped text and every other part into a placeholder, notes its
attachment reference and counts the tokens that the placeholder expands to.

Escaping: control strings all begin with `<|`. Inside texts every `<`, backslashes, `|` gets one backslash more, so
an escaped text never holds `<|`; taking one backslash away restores it. Roles also escape newlines.

Defined results: null texts, roles and parts count as empty; turns with equal numbers follow by role, then text;
repeated rows stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    empty = {f: F.lit(None).cast(t) for f, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(c.alias(f) for f, c in empty.items())))


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a placeholder stands for; text parts count none here (their tokens belong to the tokenizer)."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(patch))
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * page_tokens)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column) -> Column:
    """Escaped text, or the placeholder of an attachment; unknown types keep their name in the placeholder."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit("|>")))


def format_chat(turns: DataFrame, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 1024, trained_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, parts. One row per conversation.

    segments: the formatted turns in order (formatted is their concatenation); mask: for each turn in the loss, its
    place in segments and the code-point span of its body there; attachments: type, reference, turn and expanded
    tokens in order. A conversation is one value of the result, so its turns meet in one row.
    """
    body = F.array_join(F.transform("parts", visit), "")
    per_turn = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), F.coalesce(body, F.lit("")).alias("body"),
        F.transform(F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p["type"] != "text"), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.col("turn").alias("turn"), expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens"))).alias("attached"),
    )
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "attached")))
    held = per_turn.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.transform("rows", lambda r, i: F.struct(i.alias("segment"), F.length(r["head"]).alias("start"), (F.length(r["head"]) + F.length(r["body"])).alias("end"), (r["role"] == trained_role).alias("trained")))
    out = held.select(
        "conv_id",
        F.transform("rows", lambda r: F.concat(r["head"], r["body"], F.lit(END), F.lit("\n"))).alias("segments"),
        F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: s.dropFields("trained")).alias("mask"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    )
    return out.select("*", F.array_join("segments", "").alias("formatted"), F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_back(formatted: Column) -> Column:
    """role and text of each turn, parsed from the formatted string alone (texts hold no control string)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s != "")
    bare = F.transform(pieces, lambda s: F.substr(s, F.lit(len(START) + 1)))
    role = lambda s: F.regexp_replace(F.replace(F.regexp_replace(unescape(F.substring_index(s, "\n", 1)), r"\\\\", "\u0000"), F.lit("\\n"), F.lit("\n")), "\u0000", r"\\")
    return F.transform(bare, lambda s: F.struct(role(s).alias("role"), unescape(F.substr(s, F.instr(s, "\n") + 1)).alias("text")))


def masked_text(segments: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(F.element_at(segments, m["segment"] + 1), m["start"] + 1, m["end"] - m["start"]))), "")
