"""Chat formatting: event logs are folded to messages, rendered with a template, and read back.

All of it is DataFrame functions. One shuffle deals the log by conversation; every later step
finds its rows where they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a streamed piece of text in the log that is derived from finished turns.
PIECE = 256
#: The event kinds that start a message's text anew.
ANEW = ("edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """Control strings of a chat format.

    A conversation is ``begin``, its turns, ``finish``; a turn is ``start``, the role,
    ``middle``, the text, ``stop``. ``others`` are further control strings that a model
    knows. Inside roles and texts, each control string gets a backslash after its first character
    (one more than it has there); taking one away gives the text back.
    """

    begin: str = "<s>"
    finish: str = "</s>"
    start: str = "<|start|>"
    middle: str = "<|message|>"
    stop: str = "<|end|>"
    others: tuple[str, ...] = ("[INST]", "[/INST]")

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or set(c[1:]) & (firsts | {"\\"}) or "\\" in firsts:
                raise ValueError(f"control string {c!r}: first characters of control strings and backslashes may stand at its start only")
            if any(o != c and o.startswith(c) for o in self.controls):
                raise ValueError(f"control string {c!r} is the beginning of another one")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.finish, self.start, self.middle, self.stop, *self.others)

    def escape(self, text: Column) -> Column:
        for c in sorted(set(self.controls)):
            text = F.regexp_replace(text, f"({re.escape(c[0])}\\\\*)({re.escape(c[1:])})", r"$1\\$2")
        return text

    def unescape(self, text: Column) -> Column:
        for c in sorted(set(self.controls)):
            text = F.regexp_replace(text, f"({re.escape(c[0])}\\\\*)\\\\({re.escape(c[1:])})", "$1$2")
        return text


def log(conversations: DataFrame) -> DataFrame:
    """(conv_id, message, seq, kind, role, text): finished turns as the events that led to them.

    Messages are numbered by ``turn`` (NULL first, ties by role, then text). Each is opened with its
    role, gets the beginning of its text as a draft, which an edit (or, of an assistant, a
    regeneration) discards, and then the text in pieces. NULL role or text counts as empty.
    The rows with NULL conv_id are one conversation. The log is dealt by conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("conv_id", "role", F.row_number().over(order).cast("long").alias("message"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    events = F.expr(
        """concat(
            array(named_struct('kind', 'open', 'role', role, 'text', '')),
            if(size(pieces) > 0, array(
                named_struct('kind', 'delta', 'role', CAST(NULL AS STRING), 'text', pieces[0]),
                named_struct('kind', if(role = 'assistant', 'regenerate', 'edit'), 'role', CAST(NULL AS STRING), 'text', '')), array()),
            transform(pieces, p -> named_struct('kind', 'delta', 'role', CAST(NULL AS STRING), 'text', p)))"""
    )
    dealt = rows.select("conv_id", "message", F.posexplode(events).alias("at", "event"))
    return dealt.select("conv_id", "message", F.expr("(message << 32) + at").alias("seq"), "event.kind", "event.role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): final messages of ``events(conv_id, message, seq, kind, role, text)``.

    Events are folded in the order of ``seq`` (NULL first, ties by kind, role, text). An ``edit``
    or ``regenerate`` discards the message's text so far; its own text and those of all
    other events are appended. The last role given is the message's. NULL texts append nothing, a
    message without a role has an empty one. No events give no messages.
    """
    each = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
    anew = ", ".join(f"'{k}'" for k in ANEW)
    each = each.withColumn("since", F.expr(f"coalesce(array_max(transform(events, (e, i) -> if(e.kind IN ({anew}), i, 0))), 0)"))
    return each.select(
        "conv_id",
        "message",
        F.expr("coalesce(get(filter(events.role, r -> r IS NOT NULL), size(filter(events.role, r -> r IS NOT NULL)) - 1), '')").alias("role"),
        F.expr("array_join(slice(events.text, since + 1, size(events)), '')").alias("text"),
    )


def render(messages: DataFrame, template: Template | None = None, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): each conversation of ``messages(conv_id, message, role, text)`` as one text.

    ``loss`` lists the texts of role ``learned``: ``start`` and ``length`` in characters of
    ``formatted``, and the same place as characters ``within`` the turn number ``turn`` (from 0).
    Messages are ordered by ``message``, then role and text. A conversation becomes one value,
    so it is put together in one task; a text is handled as a row of its own until then.
    """
    t = template or Template()
    turns = messages.select("conv_id", "message", "role", t.escape(F.col("role")).alias("who"), t.escape(F.coalesce("text", F.lit(""))).alias("what"))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "what")
    head = F.concat(F.lit(t.start), "who", F.lit(t.middle))
    turns = turns.select("conv_id", (F.row_number().over(order) - 1).alias("turn"), "role", head.alias("head"), "what")
    size = (F.char_length("head") + F.char_length("what") + len(t.stop)).cast("long")
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size + len(t.begin)
    turns = turns.select(
        "conv_id",
        "turn",
        F.concat("head", "what", F.lit(t.stop)).alias("piece"),
        F.when(F.col("role") == learned, F.struct("turn", (before + F.char_length("head")).alias("start"), F.char_length("head").alias("within"), F.char_length("what").alias("length"))).alias("span"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list("span")).alias("loss"))
    return whole.select("conv_id", F.concat(F.lit(t.begin), F.array_join("pieces.piece", ""), F.lit(t.finish)).alias("formatted"), "loss")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, turns, learned): roles and texts that ``render`` wrote, and the texts under the mask.

    Turns are found by their control strings alone; the masked texts are cut out by the mask.
    """
    t = template or Template()
    turn = f"(?s){re.escape(t.start)}(.*?){re.escape(t.middle)}(.*?){re.escape(t.stop)}"
    every, who, what = (F.regexp_extract_all("formatted", F.lit(turn), F.lit(k)) for k in range(3))
    parts = formatted.select("conv_id", "formatted", "loss", every.alias("every"), who.alias("who"), what.alias("what"))
    return parts.select(
        "conv_id",
        "formatted",
        F.arrays_zip(
            F.transform("who", t.unescape).alias("role"),
            F.transform("what", t.unescape).alias("text"),
        ).alias("turns"),
        F.transform("loss", lambda s: t.unescape(F.substring(F.get("every", s["turn"]), s["within"] + 1, s["length"]))).alias("learned"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` found, a row for each conversation."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_texts(conversations: DataFrame) -> DataFrame:
    """The conversations and one of two turns, number -7, whose texts are control strings of a chat format."""
    told = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text")
    )
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(more)
