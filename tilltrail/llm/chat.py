"""Chat formatting with typed content parts, in DataFrame functions throughout.

A turn is a list of parts. Visiting them in order, text is escaped and kept, and an image, audio or
document part becomes a numbered placeholder whose attachment is recorded with the number of tokens
it will expand to. Turns are wrapped in control strings; the spans a loss is taken over are
recorded as offsets into the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"

# Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"

# What could be read as a control string: those above, placeholders and the usual ones of chat models.
_TAIL = r"(/?s>|/?INST\]|\|[A-Za-z0-9_:]*\|>)"
_ESCAPE = r"([<\[])(\\*)" + _TAIL
_UNESCAPE = r"([<\[])\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    """Put a backslash into each control string, after its first character; null becomes empty.

    Strings that already carry backslashes there get one more, so taking one away restores every text.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def text_parts(text: Column) -> Column:
    """A turn that is nothing but text, as parts."""
    kind = F.lit("text").alias("type")
    empty = [F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")]
    return F.array(F.struct(kind, text.alias("text"), *empty)).cast(PARTS)


def _expanded(part: Column) -> Column:
    """Tokens of an attachment; without a number of units it counts as one, an unknown type as none."""
    units = F.coalesce(part["units"], F.lit(1))
    rates = F.create_map(*[F.lit(x) for pair in TOKENS_PER_UNIT.items() for x in pair])
    return units * F.coalesce(F.try_element_at(rates, part["type"]), F.lit(0))


def _visited(parts: Column) -> Column:
    """What the parts put into the text, and the attachments among them.

    Text between two attachments is joined before it is escaped: a control string may be spread over several parts.
    """
    is_text = lambda part: F.coalesce(part["type"] == "text", F.lit(True))
    attached = F.filter(parts, lambda p: ~is_text(p))
    numbered = F.transform(parts, lambda p, i: F.struct(is_text(p).alias("text"), (i + 1).alias("at")))
    places = F.transform(F.filter(numbered, lambda p: ~p["text"]), lambda p: p["at"])
    bounds = F.concat(F.array(F.lit(0)), places, F.array(F.size(parts) + 1))

    def recorded(part: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("number"), part["type"].alias("type"), part["ref"].alias("ref"), _expanded(part).alias("tokens")
        )

    def stretch(start: Column, i: Column) -> Column:
        """The text from one attachment to the next, and that one's placeholder."""
        end = F.get(bounds, i + 1)
        between = F.slice(parts, start + 1, F.coalesce(end - start - 1, F.lit(0)))
        text = escape(F.array_join(F.transform(between, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
        kind = F.regexp_replace(F.coalesce(F.get(attached, i)["type"], F.lit("")), "[^A-Za-z0-9_]", "_")
        holder = F.concat(F.lit("<|"), kind, F.lit(":"), (i + 1).cast("string"), F.lit("|>"))
        return F.concat(text, F.when(i < F.size(attached), holder).otherwise(""))

    text = F.array_join(F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), stretch), "")
    return F.struct(text.alias("text"), F.transform(attached, recorded).alias("attachments"))


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_spans``, ``attachments``, ``expanded_tokens``: a row per conversation.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and either ``parts`` or ``text``. Turns go by
    number, equal numbers by role and text, a missing number first; a repeated turn is said twice.
    A null role or text is empty, rows without a conv_id are one conversation. ``loss_spans`` are
    offsets in characters, ``start`` and ``length``, of what the trained role says. An attachment is
    known by its turn's place and its number there. The text of a conversation is one value, so
    a conversation is as large as a value may be. Columns of other names are not read, so they cannot clash.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else text_parts(F.col("text"))
    parts = F.coalesce(parts, F.array().cast(PARTS))
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), _visited(parts).alias("said"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    segments = said.select(
        "conv_id",
        "turn",
        "role",
        F.col("said.attachments").alias("attachments"),
        F.concat(head, F.col("said.text"), F.lit(END)).alias("segment"),
        F.length(head).alias("head"),
        F.length("said.text").alias("length"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumns(
        {
            "place": F.row_number().over(order),
            "start": F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)) + F.col("head"),
        }
    )
    span = F.struct("place", "start", F.col("length").cast("long").alias("length"))
    trained = F.when(F.col("role") == trained_role, span)
    refs = F.when(F.size("attachments") > 0, F.struct("place", "attachments"))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("segments"),
        F.sort_array(F.collect_list(trained)).alias("spans"),
        F.sort_array(F.collect_list(refs)).alias("refs"),
    )
    fields = ("number", "type", "ref", "tokens")
    by_turn = F.transform(
        "refs",
        lambda r: F.transform(
            r["attachments"], lambda a: F.struct(r["place"].alias("place"), *[a[name].alias(name) for name in fields])
        ),
    )
    attachments = F.flatten(by_turn)
    return grouped.select(
        "conv_id",
        F.array_join(F.col("segments.segment"), "").alias("formatted"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias(
            "loss_spans"
        ),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs of ``role`` and ``text``, both unescaped."""
    split = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)

    def turn(piece: Column) -> Column:
        sides = F.split(piece, r"<\|text\|>", 2)
        return F.struct(
            unescape(sides[0]).alias("role"), unescape(F.split(sides[1], r"<\|end\|>", 2)[0]).alias("text")
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    def read(span: Column) -> Column:
        return unescape(F.substring(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int")))

    return F.array_join(F.transform(spans, read), "")


def format_digest(formatted: DataFrame) -> DataFrame:
    """What can be told from the formatted text alone: turns, loss text and their digests."""
    back = formatted.withColumns(
        {"_turns": read_turns(F.col("formatted")), "_loss": read_loss(F.col("formatted"), F.col("loss_spans"))}
    )
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )
