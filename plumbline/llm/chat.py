r"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conversation, sequence number, message number, kind, role and text. Kinds: ``message`` and
``edit`` set a message's text, ``delta`` appends to it, ``regenerate`` empties it (deltas that follow fill it again).
:func:`fold` partitions the log by conversation and message, finds the last event that sets the text and joins the
deltas after it; :func:`render` orders the messages, writes the template and keeps the places of the assistant's texts
as the loss mask; :func:`read_back` takes a formatted conversation apart again.

Template: ``<turn>role\n text </turn>\n`` without the blanks. Inside roles and texts a backslash is written ``\-`` and
``<`` is written ``\+``, so no control string can appear there and two plain replacements undo it. A role with a line
break keeps it: line breaks in roles are written ``\.``.

A formatted conversation is one string, so its parts meet in one row; windows within a conversation sort and stream.

Cases: null text or role counts as empty; a null conversation id is a conversation of its own; rows with equal turns
are separate turns ordered by role, then text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<turn>", "\n", "</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\-")), F.lit("<"), F.lit("\\+"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\+"), F.lit("<")), F.lit("\\-"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\."))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\."), F.lit("\n")))


def events_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A plain table of turns as a log with one ``message`` event per row."""
    plain = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = plain.withColumn("seq", F.row_number().over(order).cast("long"))
    return numbered.select("conv", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv, message, role (of the last event that has one), text.

    Messages of one event, the usual case, need no sort of their own: the window shares the partitioning by
    conversation, and only texts since the last event that sets them are gathered.
    """
    message = Window.partitionBy("conv", "message")
    sets = F.col("kind") != "delta"
    since = log.withColumn("_set", F.max(F.when(sets, F.col("seq"))).over(message))
    since = since.withColumn("_role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(message))
    live = since.where(F.col("_set").isNull() | (F.col("seq") >= F.col("_set")))
    part = F.struct("seq", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return live.groupBy("conv", "message").agg(
        F.coalesce(F.max("_role"), F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: conv, formatted, loss (array of start and length in code points, from 0, and the start of their turn)
    and spans: for every turn its entry of loss, or null."""
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(BREAK))
    body = escaped(F.col("text"))
    pieces = messages.select("conv", "message", "role", head.alias("head"), body.alias("body"))
    pieces = pieces.withColumn("long", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("begin", F.coalesce(F.sum("long").over(before), F.lit(0)))
    start = (F.col("begin") + F.length("head")).cast("long").alias("start")
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct(start, F.length("body").cast("long").alias("length"), F.col("begin").cast("long").alias("turn_start")))
    turns = placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("message", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span")))).alias("turns")
    )
    return turns.select(
        "conv",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.transform("turns", lambda t: t["span"]).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, turns (array of role and text), loss_text (what the mask covers, unescaped), formatted, loss.

    The output is split at the ends of turns once, and a span is cut from its own turn, so the work is linear in the text.
    """
    parts = F.filter(F.split(F.col("formatted"), CLOSE, -1), lambda p: p != "")
    broken = F.transform(parts, lambda p: F.struct(p.alias("p"), F.instr(p, BREAK).alias("at")))
    turns = F.transform(
        broken,
        lambda x: F.struct(
            unescaped_role(F.substring(x["p"], F.lit(len(OPEN) + 1), x["at"] - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(x["p"], x["at"] + 1, F.length(x["p"]))).alias("text"),
        ),
    )
    masked = F.zip_with(
        parts, "spans", lambda p, s: F.when(s.isNull(), "").otherwise(F.substring(p, (s["start"] - s["turn_start"]).cast("int") + 1, s["length"].cast("int")))
    )
    return formatted.select("conv", turns.alias("turns"), unescaped(F.array_join(masked, "")).alias("loss_text"), "formatted", "loss")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv, formatted and loss of every conversation of a plain table of turns."""
    return render(fold(events_of_turns(turns, conv_col, turn_col)))
