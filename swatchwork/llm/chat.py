"""Chat formatting from an event log, with DataFrame functions only.

Events of a conversation are ordered by sequence and folded into final messages: ``message`` opens
a message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it for new
deltas, ``delete`` removes it. Messages are rendered with a template whose marks cannot occur in
texts, because the mark characters are escaped there; the loss mask says for each turn how many
characters to skip and how many to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD_END, CLOSE = "<turn ", ">", "</turn>\n"
#: Kinds of events that set a message's text anew.
FRESH = ("message", "edit", "regenerate", "delete")


def escape(c: Column) -> Column:
    """No mark character is left; ``unescape`` gives the text back."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text`` of the final messages.

    ``events``: conv_id, seq, kind, message (its place in the conversation), role, text. Null texts
    are empty. A message keeps the role of its first event that names one. Deltas before the first
    fresh text count from an empty one. Of events with the same seq, kinds then texts decide, in
    alphabetical order.
    """
    held = events.select("conv_id", "message", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "text").rowsBetween(Window.unboundedPreceding, 0)
    round_ = F.sum(F.when(F.col("kind").isin(*FRESH), 1).otherwise(0)).over(by)
    parts = held.withColumn("round", round_)
    # Per message and round first, so that a long conversation is combined in pieces.
    piece = F.struct("seq", "kind", F.when(F.col("kind").isin("regenerate", "delete"), "").otherwise(F.col("text")).alias("text"))
    rounds = parts.groupBy("conv_id", "message", "round").agg(
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda e: e["text"]), "").alias("text"),
        F.max(F.when(F.col("kind") == "delete", 1).otherwise(0)).alias("gone"),
    )
    last = F.max(F.struct("round", "text", "gone"))
    found = rounds.groupBy("conv_id", "message").agg(F.min("named")["role"].alias("role"), last.alias("last"))
    return found.filter("last.gone = 0").select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.col("last.text").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, mask``: one text a conversation, and per turn ``(skip, learn, rest)``
    numbers of characters; only the texts of role ``learn`` are learned."""
    text, role = escape(F.col("text")), escape(F.col("role"))
    head = F.concat(F.lit(OPEN), role, F.lit(HEAD_END))
    taught = F.when(F.col("role") == learn, F.length(text)).otherwise(0)
    size = F.length(head) + F.length(text) + len(CLOSE)
    turn = messages.select("conv_id", "message", F.concat(head, text, F.lit(CLOSE)).alias("shown"), F.struct(F.length(head).alias("skip"), taught.alias("learn"), (size - F.length(head) - taught).alias("rest")).alias("span"))
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "shown", "span"))).alias("turns"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("mask"))


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted text: array of role and text, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    body = lambda p: F.substring(p, len(OPEN) + 1, F.length(p))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(body(p), HEAD_END, 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, HEAD_END, 1)) + 2, F.length(p))).alias("text")))


def learned(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    spans = F.transform(F.arrays_zip(pieces.alias("piece"), mask.alias("span")), lambda z: unescape(F.substring(z["piece"], z["span"]["skip"] + 1, z["span"]["learn"])))
    return F.array_join(spans, "")


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of turns as an event log: each row is one message, in order of turn, then role and
    text; a null role is empty."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows are equal but for these columns, so ties have one result whatever their order.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("message", place).select("conv_id", F.col("message").alias("seq"), F.lit("message").alias("kind"), "message", "role", "text")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` a conversation,
    read back from the formatted text.

    ``conversations``: conv_id, turn, role, text. Null roles and texts are empty, null turns come
    first, rows with a null conv_id form one conversation; repeated rows are turns of their own.
    Other columns are ignored. An empty table gives an empty result. A conversation is one output
    row, so its text has to fit in one row.
    """
    shown = render(fold_events(log_of_turns(conversations)))
    read = shown.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("mask")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
