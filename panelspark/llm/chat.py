"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it are
context, and its text alone is trainable. Turns after the last assistant turn
(or a conversation without one) make one more row, without a target, so that
the output holds every turn.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each turn. In
roles and texts a backslash is doubled and one is put after the first
character of every control string, so no control string can come from data;
dropping each backslash and keeping the character after it gives the data back.

Defined cases: a null text or role is empty; a null conversation id is a
conversation of its own; turns with the same number are put by role, then text
(null numbers first); repeated rows are turns of their own; an empty table
gives an empty result; other columns are ignored. The expansion repeats the
context for every reply, so the output of one conversation grows with the
square of its turns: that is the method's nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Control strings of common chat templates, told by what follows their first character.
_CONTROL = r"(?i)(<)(?=\||/?s>|</?SYS>>|(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>)|(\[)(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1$2\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(turn["role"]), F.lit(TEXT), escaped(turn["text"]), F.lit(END))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example, last, text, loss_start, loss_end``.

    ``text`` is the formatted example; characters ``loss_start`` to ``loss_end``
    (exclusive, in code points) are the trainable reply; both are null in a row
    without a target. ``last`` marks the row that holds all turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform("turns", formatted_turn)
    convs = convs.select("conv_id", "turns", pieces.alias("pieces"), F.size("turns").alias("n"))
    replies = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at(F.col("turns"), i)["role"] == "assistant")
    ends = F.array_distinct(F.concat(replies, F.array("n")))
    one = convs.select("conv_id", "turns", "pieces", "n", F.posexplode(ends).alias("example", "at"))
    own = F.element_at("turns", F.col("at"))
    text = F.array_join(F.slice("pieces", F.lit(1), F.col("at")), "")
    out = one.select("conv_id", "example", (F.col("at") == F.col("n")).alias("last"), text.alias("text"), F.when(own["role"] == "assistant", F.char_length(escaped(own["text"]))).alias("long"))
    loss_end = F.char_length("text") - len(END)
    return out.select("conv_id", "example", "last", "text", F.when(F.col("long").isNotNull(), loss_end - F.col("long")).alias("loss_start"), F.when(F.col("long").isNotNull(), loss_end).alias("loss_end"))


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of ``role, text``."""
    body = F.filter(F.split(text, r"<\|turn\|>", -1), lambda p: p != "")
    parts = F.transform(body, lambda p: F.split(F.substring(p, F.lit(1), F.char_length(p) - len(END)), r"<\|text\|>", -1))
    return F.transform(parts, lambda p: F.struct(unescaped(F.element_at(p, 1)).alias("role"), unescaped(F.element_at(p, 2)).alias("text")))


def digest_examples(examples: DataFrame) -> DataFrame:
    """Read the conversations back from the examples, and digest them."""
    reply = unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = F.when(F.col("last"), parsed_turns(F.col("text")))
    rows = examples.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), reply.alias("reply"), read.alias("turns"))
    by_conv = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.first("turns", ignorenulls=True).alias("turns"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by_conv.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
