"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context, and only that reply is under the
loss mask. Turns after the last reply (or a conversation without one) make a last example with an empty mask, so that no
turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that open or close turns here or in other templates; inside texts a backslash follows their first character.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    """``text`` without any control string; every backslash in the result starts an escaped character."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text), rows by turn.

    Returns conv_id, example (number of the last turn it holds), formatted, loss_start (from 0, null without a reply),
    loss_length (code points of ``formatted``). Null roles and texts count as empty, equal turn numbers are ordered by
    role and text, repeated rows are turns of their own, a null conv_id is one conversation, extra columns are ignored,
    an empty table gives no rows. One conversation is held by one task: it has to be formatted as a whole.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (
        conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    # Each text is escaped once; examples are put together from the turns as shown, and places from their lengths.
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("reply"), F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")
    )).alias("parts"))
    shown = parts.select(
        "conv_id",
        F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))).alias("shown"),
        F.transform("parts", lambda p: F.struct(p["reply"].alias("reply"), F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"))).alias("sizes"),
    )
    n = F.size("sizes")
    is_reply = lambda i: F.element_at("sizes", i)["reply"]
    examples = F.filter(F.sequence(F.lit(1), n), lambda i: is_reply(i) | ((i == n) & ~is_reply(i)))
    rows = shown.select("conv_id", "shown", "sizes", F.explode(examples).alias("example"))
    target = F.element_at("sizes", F.col("example"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("example") - 1), F.lit(0), lambda sum_, t: sum_ + t["head"] + t["body"] + len(END))
    return rows.select(
        "conv_id",
        "example",
        F.array_join(F.slice("shown", F.lit(1), F.col("example")), "").alias("formatted"),
        F.when(target["reply"], before + target["head"]).alias("loss_start"),
        F.when(target["reply"], target["body"]).otherwise(0).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    shown = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(
        F.slice(shown, F.lit(1), F.size(shown) - 1),
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, TEXT, 1), len(START) + 1, 1 << 30)).alias("role"),
            unescape(F.regexp_extract(t, r"(?s)<\|text\|>(.*)$", 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask (empty without one)."""
    return F.coalesce(unescape(F.substr(formatted, start + 1, length)), F.lit(""))
