"""Chat formatting from an event log, with DataFrame functions only.

The log has one row per event: conversation, sequence number, message, kind, role and text.

* ``open``        starts a message; its place in the conversation is the sequence of its first ``open``
* ``delta``       appends text to the message
* ``edit``        replaces the message's text; later deltas append to it
* ``regenerate``  empties the message and drops the messages opened between its opening and this event,
  which answered the text that is gone

Folding goes in two steps, message by message and then conversation by conversation, over one exchange by
conversation: all events of a conversation meet in one task, as its formatted text does in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, at, role, text) of a log (conv_id, seq, message, kind, role, text).

    Events delivered more than once (equal in all six columns) count once. Null text is empty, null role is
    the empty role, rows without a kind are ignored, and a message that never opened is dropped. Events of one
    message with equal seq are taken in the order open, regenerate, edit, delta and then by text.
    """
    order = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    events = (
        log.where(F.col("kind").isin("open", "delta", "edit", "regenerate"))
        .select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("step", F.struct(F.col("seq").alias("seq"), order.alias("rank")))
    )
    of_message = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("step"))).over(of_message)
    live = events.withColumn("reset", reset).withColumn(
        "part",
        F.when(
            F.col("kind").isin("delta", "edit") & (F.col("reset").isNull() | (F.col("step") >= F.col("reset"))),
            F.struct("step", "text"),
        ),
    )
    opened = F.col("kind") == "open"
    messages = live.groupBy("conv_id", "message").agg(
        F.min(F.when(opened, F.col("seq"))).alias("at"),
        F.max(F.when(opened, F.lit(1))).alias("opened"),
        F.min_by("role", F.when(opened, F.struct("seq", F.coalesce("role", F.lit(""))))).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]), "").alias("text"),
    ).where(F.col("opened") == 1)
    earlier = Window.partitionBy("conv_id").orderBy("at", "message").rowsBetween(Window.unboundedPreceding, -1)
    kept = messages.withColumn("cut", F.max("again").over(earlier))
    return kept.where(F.col("cut").isNull() | (F.col("at") > F.col("cut"))).select(
        "conv_id", "at", "message", F.coalesce("role", F.lit("")).alias("role"), "text"
    )


def escape(text: Column) -> Column:
    """Text without control strings: a backslash becomes two, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role on one line: as a text, with a line break as backslash and ``n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Left to right: pairs of backslashes stay for ``unescape``; one that is left over before ``n`` is a line break."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (from and to of each turn's trained part within the turn).

    A turn is ``<|im_start|>role``, a line break, the escaped text, ``<|im_end|>`` and a line break. Only texts
    of the role ``assistant`` are trained on. Messages at the same place are ordered by message, role, text.
    A conversation is one value, so it must fit a row.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id",
        F.struct(
            "at",
            "message",
            F.concat(head, body, F.lit(END + "\n")).alias("turn"),
            F.when(
                F.col("role") == "assistant",
                F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end")),
            ).alias("loss"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("ts", lambda t: t["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role and text) and the trained texts of each formatted conversation, taken from it alone."""
    turns = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), 1, F.size("loss"))
    cut = formatted.select("conv_id", "formatted", "loss", turns.alias("turns"))
    head = lambda t: F.substring_index(t, "\n", 1)
    parsed = F.transform(
        "turns",
        lambda t: F.struct(
            unescape_role(F.substr(head(t), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(t, F.length(head(t)) + 2)).alias("text"),
        ),
    )
    trained = F.transform(
        F.filter(F.arrays_zip("turns", "loss"), lambda z: z["loss"].isNotNull()),
        lambda z: unescape(F.substr(z["turns"], z["loss"]["start"] + 1, z["loss"]["end"] - z["loss"]["start"])),
    )
    return cut.select("conv_id", "formatted", parsed.alias("turns"), trained.alias("trained"))
