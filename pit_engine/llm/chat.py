"""Event-sourced conversations: fold an event log into messages, then render.

An event log has one row per event: conv_id, seq, slot, op, role, text, with op
  message     opens the slot with a role and a first text
  delta       streams more text to the slot
  edit        replaces the slot's text
  regenerate  drops the slot's text and every later slot; deltas that follow
              stream the new text
The log is partitioned by conversation and sorted by sequence number. Only the
events after the last one that resets their slot survive, so the fold is a few
maxima and one ordered concatenation per slot, never a running string.

Rendering marks each turn and escapes control strings inside texts reversibly:
a backslash is put before each control string; reading removes it again. A
marker that the template writes itself never follows a backslash.

Defined cases
  null role, null text   empty strings
  null conv_id           one conversation of its own
  equal seq              ordered by op (message, edit, regenerate, delta), then text
  repeated rows          each is a message of its own (``row_events``)
  empty log              no rows
  extra columns          not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings that steer a model or this template, as a regular expression.
CONTROL = r"<\|(?:turn|text|end)\|>|</?s>|\[/?INST\]|<</?SYS>>"
TURN, TEXT, END = "<|turn|>", "\n<|text|>", "\n<|end|>\n"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Put one more backslash before each control string."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+(?:{CONTROL}))", "$1")


def row_events(conversations: DataFrame) -> DataFrame:
    """The event log of a table with a finished text per row: each row opens a slot and streams its text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", F.row_number().over(order).cast("bigint").alias("slot"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    event = lambda k, op, text: F.struct((2 * F.col("slot") + k).alias("seq"), F.lit(op).alias("op"), text.alias("text"))
    both = F.explode(F.array(event(0, "message", F.lit("")), event(1, "delta", F.col("text")))).alias("e")
    return rows.select("conv_id", "slot", "role", both).select("conv_id", "e.seq", "slot", "e.op", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, slot, role, text."""
    rank = F.when(F.col("op") == "message", 0).when(F.col("op") == "edit", 1).when(F.col("op") == "regenerate", 2).otherwise(3)
    one = F.struct(F.col("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    slots = events.groupBy("conv_id", "slot").agg(
        F.sort_array(F.collect_list(one)).alias("log"),
        F.max(F.when(F.col("op").isin(*RESETS), F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max_by("role", F.when(F.col("op") == "message", F.col("seq"))).alias("role"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.max("regenerated").over(earlier)
    live = F.filter("log", lambda e: (F.col("reset").isNull() | (e["seq"] >= F.col("reset"))) & (F.col("dropped").isNull() | (e["seq"] > F.col("dropped"))))
    kept = slots.withColumn("dropped", dropped).withColumn("log", live).where(F.size("log") > 0)
    return kept.select("conv_id", "slot", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("log.text"), "").alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: the rendered conversations and their loss mask.

    loss has a struct (turn, start, end) for each text to learn: code points of
    the turn's part of ``formatted``, counted from after its turn marker.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    before = F.length(role) + len(TEXT)
    turn = F.struct(
        F.col("slot"),
        F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("part"),
        F.when(F.col("role") == learn_role, F.struct(before.alias("start"), (before + F.length(text)).alias("end"))).alias("span"),
    )
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["span"]["start"].alias("start"), t["span"]["end"].alias("end")))
    return turns.select("conv_id", F.concat(F.lit("<s>"), F.array_join("turns.part", "")).alias("formatted"), F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), learned: all parsed from ``formatted`` and ``loss``."""
    parts = F.split("formatted", r"(?<!\\)<\|turn\|>", -1)
    cut = rendered.select("conv_id", "formatted", "loss", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("parts"))

    def turn(part: Column) -> Column:
        sides = F.split(part, r"\n<\|text\|>", 2)
        text = F.substring(sides[1], F.lit(1), F.length(sides[1]) - len(END))
        return F.struct(unescape(sides[0]).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring(F.get("parts", s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return cut.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), F.array_join(masked, "").alias("learned"))
