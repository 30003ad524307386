"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Loggers that store a conversation after every turn leave many prefixes of the same conversation.
Every turn has two 64-bit hashes of its position, role and text; their running exclusive-or is
the hash of each prefix (in whatever order sums are taken, so windows and aggregates agree). A
conversation whose whole hash is a proper prefix of a longer one is dropped by an anti-join, of
equal conversations the smallest id stays, and the rest is rendered turn by turn.

Scale: texts are shuffled once, by conversation, to order the turns; prefixes are told by hashes, and
a first turn that many conversations share is one row after partial aggregation. A chat is one
value, so the turns of one conversation meet in one task, where sorting them may spill.

Cases: turns are ordered by turn, then role, then text; a null role or text counts as empty;
repeated rows are turns of their own; rows of a null conversation are left out; further columns
are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import plain_columns

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, role, text): turns with their place. Both uses of it share one shuffle of the texts."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", F.row_number().over(order).alias("n"), "role", "text")


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same of the conversations in (conv_id, n, role, text) that stay."""
    salted = placed.select("conv_id", "n", F.xxhash64("n", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role", "n").alias("h2"))
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rolled = salted.select("conv_id", "n", F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"))
    whole = rolled.where("n = n_turns").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    prefixes = rolled.where("n < n_turns").select("n", "p1", "p2").distinct()
    return whole.join(prefixes, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_same")


def clean(text: Column) -> Column:
    """Template signs in a message are taken apart, so that no message can forge a turn."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))


def render(placed: DataFrame, system: str | None = None) -> DataFrame:
    """conv_id and its turns as one text."""
    piece = F.concat(F.lit(OPEN), clean(F.col("role")), F.lit("\n"), clean(F.col("text")), F.lit(CLOSE + "\n"))
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", piece.alias("piece")))).alias("parts"))
    head = F.lit("" if system is None else f"{OPEN}system\n{system}{CLOSE}\n")
    return rows.select("conv_id", F.concat(head, F.array_join(F.transform("parts", lambda p: p["piece"]), "")).alias("chat"))


def format_chats(conversations: DataFrame, system: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_same (equal conversations, itself among them) and chat."""
    turns = plain_columns(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null").na.fill("", ["role", "text"])
    placed = numbered(turns)
    stay = maximal(placed)
    return stay.join(render(placed.join(stay.select("conv_id"), "conv_id", "left_semi"), system), "conv_id")
