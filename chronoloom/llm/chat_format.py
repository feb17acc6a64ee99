"""Chat formatting: event-sourced reconstruction of conversations, rendered with a loss mask. DataFrame functions only.

A log holds events of conversations: ``delta`` appends text to a message, ``edit`` replaces what the message says so
far and ``regenerate`` starts it again (its text, if any, is the new beginning). Events are partitioned by conversation,
sorted by sequence and folded: the text of a message is the concatenation of its events from the last ``edit`` or
``regenerate`` on. Its role is the last one that any of its events names. A table of finished turns is read as the log
in which they were streamed: a draft, a regeneration and a delta each.

Template: each turn is ``<turn:ROLE>TEXT</turn>`` and a line feed. Inside texts and roles a backslash is written ``\\s``,
``<`` is written ``\\l`` and, in roles, ``>`` is written ``\\g``; so no text can hold a control string, and the writing is
undone exactly. The loss mask is the range of code points of every assistant text.

Edge cases: a null text or kind is an empty text, a delta; a null or empty role names none, and a message without any has an empty one. Ties in the sequence are ordered by role
and text. Conversations with a null id form one conversation of their own. Empty tables give empty results. Other
columns are ignored, very long texts kept whole. Turns that repeat a number, or a whole row, are messages of their own. A conversation is one output row, so its own length is the only thing that is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, HEAD_END, CLOSE = "<turn:", ">", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def fold_events(log: DataFrame, *first: str) -> DataFrame:
    """(conv_id, message, role, text) of a log (conv_id, message, seq, kind, role, text), and the smallest values of further columns."""
    own = [F.col(c).alias(f"_{c}") for c in first]
    log = log.select(*own, "conv_id", "message", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    message = Window.partitionBy("conv_id", "message")
    fresh = F.when(F.col("kind") != "delta", F.struct("seq", "role", "text"))
    named = F.when(F.col("role") != "", F.struct("seq", "role", "text"))
    log = log.withColumns({"_from": F.max(fresh).over(message), "_named": F.max(named).over(message)}).where("_from is null or struct(seq, role, text) >= _from")
    parts = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))
    return log.groupBy("conv_id", "message").agg(parts.alias("parts"), F.max("_named.role").alias("role"), *[F.min(f"_{c}").alias(c) for c in first]).select(
        *first, "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")
    )


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of turns (conv_id, turn, role, text).

    loss_spans: for each assistant turn its place in the conversation, the range of code points of its text inside the
    turn's piece, and the offset of the piece in the whole.
    """
    text, role = escape(F.coalesce("text", F.lit(""))), escape_role(F.coalesce("role", F.lit("")))
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"), F.concat(F.lit(OPEN), role, F.lit(HEAD_END)).alias("head"), text.alias("body"))
    piece = F.concat("head", "body", F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    turns = turns.withColumns({"piece": piece}).withColumns({
        "k": F.row_number().over(order),
        "offset": F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    mask = F.when(F.col("role") == "assistant", F.struct(F.col("k").alias("k"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"), F.length("head").alias("start"), (F.length("head") + F.length("body")).alias("end")))
    one = F.array_sort(F.collect_list(F.struct("k", "piece", mask.alias("mask"))))
    return turns.groupBy("conv_id").agg(one.alias("all")).select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["mask"]), lambda m: m.isNotNull()).alias("loss_spans"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the log of a server that streams them.

    Every turn is a message of three events: a draft (one dot), a regeneration that takes it back and says the first half, and a delta with the rest.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    events = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("delta").alias("kind"), F.lit(".").alias("said")),
        F.struct(F.lit(1).alias("seq"), F.lit("regenerate").alias("kind"), F.substring(text, F.lit(1), half).alias("said")),
        F.struct(F.lit(2).alias("seq"), F.lit("delta").alias("kind"), F.substring(text, half + 1, F.length(text)).alias("said")),
    )
    numbered = conversations.select("conv_id", F.monotonically_increasing_id().alias("message"), "turn", "role", events.alias("events"))
    return numbered.select("conv_id", "message", "turn", "role", F.explode("events").alias("e")).select("conv_id", "message", "turn", "e.seq", "e.kind", "role", F.col("e.said").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a table of turns (conv_id, turn, role, text), by way of their log.

    Conversations are partitioned once, by their id; folding, ordering and rendering then need no further shuffle.
    """
    return render(fold_events(log_of(conversations).repartition("conv_id"), "turn"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns (role, text) and the text under the loss mask, parsed from the output."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, HEAD_END)
        return F.struct(unescape_role(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, at + 1, F.length(p) - at)).alias("text"))

    out = formatted.withColumn("pieces", pieces)
    loss = F.transform("loss_spans", lambda m: unescape(F.substring(F.element_at("pieces", m["k"]), m["start"] + 1, m["end"] - m["start"])))
    return out.select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
