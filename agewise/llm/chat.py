"""Chat formatting: event logs of conversations folded into messages, rendered by a template and read back; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.llm.common import need

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates give a meaning, the marks of this one first. None holds a backslash.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Kinds of events that begin a message anew, and those of them that take back all later messages.
BEGINS, CUTS = ("start", "edit", "regenerate"), ("edit", "regenerate")
#: Code points of a streamed delta of :func:`log_of_turns`.
STREAMED = 200


def _broken(control: str) -> str:
    return f"{control[0]}\\{control[1:]}"


def escape(text: Column) -> Column:
    """``text`` without an intact control string: backslashes are doubled, and each control string gets one after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(_broken(c)))
    return out


def unescape(text: Column) -> Column:
    """What :func:`escape` was given. Own backslashes stand in pairs, so a single one inside a control string is never a text's own."""
    for c in reversed(CONTROLS):
        text = F.replace(text, F.lit(_broken(c)), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def log_of_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The events (conv_id, seq, kind, message, role, text) by which a chat server would have logged finished turns.

    What an assistant says comes in deltas: a draft that is given up, a regeneration, and the answer. Others' messages are begun
    empty and edited once. Turns are numbered by ``turn_col``, null first; equal turns by role and text, equal rows each on their own.
    Null roles and texts are empty.
    """
    need(turns, [conv_col, turn_col, role_col, text_col])
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("t"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order))

    def event(step: Column, kind: str, text: Column | str) -> Column:
        return F.struct(step.cast("int").alias("step"), F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text"))

    deltas = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STREAMED}}}"), F.lit(0))
    streamed = F.transform(
        F.array(deltas),
        lambda d: F.concat(
            F.array(event(F.lit(0), "start", ""), event(F.lit(1), "delta", F.coalesce(F.get(d, F.lit(0)), F.lit(""))), event(F.lit(2), "regenerate", "")),
            F.transform(d, lambda x, i: event(i + 3, "delta", x)),
        ),
    )[0]
    sent = F.array(event(F.lit(0), "start", ""), event(F.lit(1), "edit", F.col("text")))
    each = rows.select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(sent)).alias("e"))
    return each.select("conv_id", F.struct("message", "e.step").alias("seq"), "e.kind", "message", "role", "e.text")


def fold_events(log: DataFrame, *, conv_col: str = "conv_id", seq_col: str = "seq", message_col: str = "message") -> DataFrame:
    """(conv_id, message, role, text, alive): the messages that a log of events leaves, by conversation and place.

    ``log`` has a conversation, ``seq`` (any type with an order), ``kind``, ``message`` (the place of a message in its conversation, any
    type with an order), role and text. *start*, *edit* and *regenerate* begin a message anew with their text; the last two also take
    back every later message as it stands, which stays away unless it is begun again. *delta* adds its text to its message. So a
    message is alive if it was begun after the last edit or regeneration of an earlier one, and its text is that of its last beginning
    and of the deltas since. A role that an event lacks is the message's last one.

    An event that comes twice counts once, equal ``seq`` go by text; a null ``seq`` is the first. Other kinds, and deltas before any
    beginning, do nothing. Null ids and places are ones of their own; null roles and texts are empty. A message without a beginning isn't
    alive. Other columns are not read.

    Deltas meet by conversation and message, so only finished messages are gathered by conversation.
    """
    need(log, [conv_col, seq_col, "kind", message_col, "role", "text"])
    e = log.select(F.col(conv_col).alias("conv_id"), F.col(seq_col).alias("seq"), "kind", F.col(message_col).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    begins = F.col("kind").isin(*BEGINS)
    place = F.struct("seq")
    each = e.groupBy("conv_id", "message").agg(
        F.max(F.when(begins, F.struct("seq", "text"))).alias("begun"),
        F.max(F.when(F.col("kind").isin(*CUTS), place)).alias("cut"),
        F.max(F.when(begins & F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
        F.collect_set(F.when(F.col("kind") == "delta", F.struct("seq", "text"))).alias("deltas"),
    )
    since = F.array_sort(F.filter("deltas", lambda d: F.struct(d["seq"]) > F.struct("begun.seq")))
    text = F.concat("begun.text", F.array_join(F.transform(since, lambda d: d["text"]), ""))
    earlier = F.max("cut").over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    alive = F.col("begun").isNotNull() & (earlier.isNull() | (F.struct("begun.seq") > earlier))
    return each.select("conv_id", "message", F.coalesce("named.role", F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), alive.alias("alive"))


def render_chats(messages: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turns) of the living messages of :func:`fold_events`: a row for each conversation, also one that has none left.

    A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` with role and text escaped. ``turns`` tells of each where it begins (``at``), where
    its text begins and ends (code points of ``formatted``, end excluded), and whether that text is under the loss mask.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    parts = messages.select("conv_id", "message", "alive", (F.col("role") == loss_role).alias("loss"), F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), text.alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.when(F.col("alive"), size)).over(before), F.lit(0))
    parts = parts.withColumn("at", at).withColumn("start", F.col("at") + F.char_length("head"))
    turn = F.struct("at", "start", (F.col("start") + F.char_length("body")).alias("end"), "loss")
    piece = F.struct("message", F.concat("head", "body", F.lit(END)).alias("piece"), turn.alias("turn"))
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("alive"), piece))).alias("p"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.transform("p", lambda x: x["turn"]).alias("turns"))


def format_chats(log: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, formatted, turns): :func:`fold_events`, then :func:`render_chats`. A conversation is one value of the result, so it
    has to fit a string; an empty log gives no rows."""
    return render_chats(fold_events(log, **columns))


def _pieces(formatted: Column) -> Column:
    cut = F.split(formatted, re.escape(END), -1)
    return F.transform(F.array(cut), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))[0]


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation tells."""
    halves = F.transform(_pieces(formatted), lambda p: F.split(p, re.escape(SEP), 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0].substr(F.lit(len(START) + 1), F.char_length(h[0]))).alias("role"), unescape(h[1]).alias("text")))


def read_loss(formatted: Column, turns: Column) -> Column:
    """The array of texts under the loss mask. Each is cut from its own turn, so the work grows with the length alone."""
    texts = F.zip_with(_pieces(formatted), turns, lambda p, t: F.when(t["loss"], p.substr((t["start"] - t["at"] + 1).cast("int"), (t["end"] - t["start"]).cast("int"))))
    return F.transform(F.filter(texts, lambda x: x.isNotNull()), unescape)
