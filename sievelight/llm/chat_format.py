"""Chat formatting with relational expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one
role share a block; pieces are concatenated. The template is

    <|im_start|>ROLE\n TEXT [<|im_sep|> TEXT ...] <|im_end|>\n

(without the spaces), where ``<|im_sep|>`` parts the merged turns, so reading back
gives the turns as they were. Inside texts and roles every ``<|`` is written
``<||``, hence no text can hold a control string; a line break in a role is
written ``<|nl|>``. The loss mask is a list of (start, end) code point spans: one
for each assistant text, without control strings.

Defined cases: null text or role counts as empty; turns sort by number, nulls
first, ties by role and text, and repeated rows are repeated turns; a null
conv_id is a conversation; extra columns are ignored; an empty table gives an
empty result. A conversation becomes one string, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

START, SEP, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _regex(literal: str) -> str:
    return literal.replace("|", r"\|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,end>> for every conversation."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    grouped = turns.select("conv_id", F.struct(F.col("turn"), some("role").alias("role"), some("text").alias("text")).alias("t"))
    sorted_turns = grouped.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    t, last = F.col("turns"), F.size("turns") - 1

    def piece(x, i):
        opens = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
        closes = (i == last) | (F.get(t, i + 1)["role"] != x["role"])
        role = F.replace(escaped(x["role"]), F.lit("\n"), F.lit(BREAK))
        head = F.when(opens, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(SEP))
        return F.struct(
            head.alias("head"), escaped(x["text"]).alias("text"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"), (x["role"] == LEARNT_ROLE).alias("learnt")
        )

    pieces = sorted_turns.select("conv_id", F.transform(t, piece).alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"]))
    placed = F.filter(F.arrays_zip("pieces", carried(sizes, lambda a, x: a + x).alias("at")), lambda z: z["pieces"]["learnt"])
    begin = lambda z: z["at"] + F.length(z["pieces"]["head"])
    spans = F.transform(placed, lambda z: F.struct(begin(z).alias("start"), (begin(z) + F.length(z["pieces"]["text"])).alias("end")))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return pieces.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    blocks = F.filter(F.split(formatted, _regex(START), -1), lambda b: b != "")

    def turns(block):
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(
            F.split(body, _regex(SEP), -1), lambda x: F.struct(unescaped(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says, read back: turns and text under the loss mask."""
    back = formatted.select("conv_id", "formatted", "loss_spans", turns_of(F.col("formatted")).alias("turns"))
    written = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"), loss.alias("loss"), "formatted")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
