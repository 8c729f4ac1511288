"""Event-sourced chat formatting with DataFrame functions only.

A log holds events of conversations: `message` (a whole message), `delta` (text appended to a message), `edit` (replaces a
message's text) and `regenerate` (empties a message; deltas follow). Events of a message fold by sequence number to its
final text; messages stand where they began; the conversation is rendered with turn marks. Control strings inside texts
are escaped reversibly, so the rendered string can be parsed back exactly.

Folding groups by message first, then by conversation, so that a long event stream is reduced before messages meet. What meets in one task is one conversation's final text, which is one output value.

Defined results: a null text is empty; a null role is empty; a null conversation id is a conversation of its own; a null
message id is a message of its own for each event; an unknown or null event counts as a message; events of a message that
has not begun begin it; of one message, events that are equal in every column are one event that was delivered again, and
of equal sequence numbers deltas come last, then by role and text (so a delta with its reset's number follows the reset);
messages that begin at equal sequence numbers are ordered by role, then text; an empty log gives no conversation; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN_END = END + "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): final messages of a log (conv_id, seq, role, text[, event, message_id])."""
    given = set(events.columns)
    event = F.coalesce("event", F.lit("message")) if "event" in given else F.lit("message")
    message = F.col("message_id") if "message_id" in given else F.lit(None).cast("long")
    text = F.when(event == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    e = events.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (event == "delta").alias("delta"), message.alias("message_id"))
    e = e.withColumn("_own", F.when(F.col("message_id").isNull(), F.monotonically_increasing_id()))
    parts = F.array_sort(F.collect_set(F.struct("seq", "delta", "role", "text")))
    m = e.groupBy("conv_id", "message_id", "_own").agg(parts.alias("_parts"))
    resets = F.filter(F.transform("_parts", lambda p, i: F.when(~p["delta"], i)), lambda i: i.isNotNull())
    live = F.slice("_parts", F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.size("_parts"))
    first = F.element_at("_parts", 1)
    return m.select("conv_id", first["seq"].alias("seq"), first["role"].alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))


def events_of(messages: DataFrame) -> DataFrame:
    """A log of (conv_id, seq, role, text) rows as it may have come: messages of `assistant` are begun, broken off after half
    of their text, regenerated and streamed in two deltas; others are sent in half and edited to their whole text. Each row
    is a message of its own, also where rows repeat."""
    order = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    m = messages.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("_text"), F.row_number().over(order).cast("long").alias("message_id"))
    half = (F.length("_text") / 2).cast("int")
    front, rest = F.substring("_text", F.lit(1), half), F.substring("_text", half + 1, F.length("_text"))
    said = lambda k, event, text: F.struct((F.col("message_id") * 8 + k).alias("seq"), F.lit(event).alias("event"), text.alias("text"))
    streamed = F.array(said(0, "message", F.lit("")), said(1, "delta", front), said(2, "regenerate", F.lit("")), said(3, "delta", front), said(4, "delta", rest))
    edited = F.array(said(0, "message", front), said(1, "edit", F.col("_text")))
    e = m.select("conv_id", "role", "message_id", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("_e"))
    return e.select("conv_id", "message_id", "role", "_e.seq", "_e.event", "_e.text")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the chat string and its loss mask, spans (start, length) in code points.

    A span holds the escaped text of one message of trained_role, without marks.
    """
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    m = messages.withColumn("_head", head).withColumn("_body", body).withColumn("_size", F.length("_head") + F.length("_body") + len(TURN_END))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    m = m.withColumn("n", F.row_number().over(order)).withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("n", F.concat("_head", "_body", F.lit(TURN_END)).alias("turn"), (F.col("role") == trained_role).alias("trained"), (F.col("_end") - F.col("_size") + F.length("_head")).alias("start"), F.length("_body").alias("length"))
    c = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(span)).alias("_m"))
    text = F.array_join(F.transform("_m", lambda x: x["turn"]), "")
    loss = F.transform(F.filter("_m", lambda x: x["trained"]), lambda x: F.struct(x["start"].cast("int").alias("start"), x["length"].alias("length")))
    return c.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered string."""
    pieces = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), 1, F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
