"""Chat formatting with DataFrame expressions only.

The rows of a conversation are collected as structs, sorted by turn, adjacent turns of
one role are merged by array functions (each turn against the one before it, linear in the
turns), and the pieces are concatenated:

    <|im_start|> role <|im_mid|> text (<|im_sep|> text)* <|im_end|> ...

``<|im_sep|>`` keeps the turns of a merged block apart.  Texts and roles are escaped so
that no control string can occur in them: a backslash is doubled, and one is put behind
the first character of every string of ``CONTROL``.  ``parsed`` reads a formatted string
back; the loss mask covers the texts of ``assistant`` blocks.

Defined results: a null text or role is empty; rows are ordered by (turn, role, text)
with null turns first, so ties and repeated rows are kept in a fixed order; rows
with a null conversation id form one conversation; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

START, MID, SEP, END = "<|im_start|>", "<|im_mid|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this template and of the common public ones; all begin with < or [.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escaped(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        t = F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return t


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv_id and ``formatted``, one row per conversation."""
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    turns = conversations.select(col(id_col).alias("conv_id"), F.struct(
        col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # every turn beside the one before it: a block goes on where the roles are equal
    before = F.concat(F.array(F.lit(None)), F.slice("turns", 1, F.size("turns") - 1))

    def piece(t: Column, b: Column) -> Column:
        text = escaped(t["text"])
        opened = F.concat(F.lit(START), escaped(t["role"]), F.lit(MID), text)
        return (F.when(b.isNull(), opened).when(b["role"] == t["role"], F.concat(F.lit(SEP), text))
                .otherwise(F.concat(F.lit(END), opened)))

    pieces = F.zip_with(F.col("turns"), F.col("before"), piece)
    return sorted_turns.select("conv_id", "turns", before.alias("before")).select(
        "conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"))


def parsed(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, and ``blocks``: array of (role, texts), read from the string."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda b: b != "")

    def block(b: Column) -> Column:
        at = F.split(F.substring(b, len(START) + 1, 2147483647), r"<\|im_mid\|>", 2)
        return F.struct(unescaped(at[0]).alias("role"),
                        F.transform(F.split(at[1], r"<\|im_sep\|>", -1), unescaped).alias("texts"))

    return formatted.select("conv_id", "formatted", F.transform(blocks, block).alias("blocks"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask."""
    turn_text = F.array_join(F.flatten(F.transform("blocks", lambda b: F.transform(
        b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n"))))), "")
    loss = F.array_join(F.flatten(F.transform(F.filter("blocks", lambda b: b["role"] == "assistant"), lambda b: b["texts"])), "")
    r = read.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                    F.expr("aggregate(blocks, 0L, (a, b) -> a + size(b.texts))").alias("n_turns"),
                    turn_text.alias("turn_text"), loss.alias("loss"))
    sha = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256)
    return r.select("conv_id", "n_turns", sha("turn_text").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                    sha("loss").alias("loss_sha256"), "formatted_chars")
