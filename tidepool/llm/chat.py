"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text),
so repeated turn numbers have a defined order; a null text or role is empty; a
null conv_id is a conversation of its own. Adjacent turns of one role become one
block; a separator keeps the turns inside it apart:

    <|im_start|>role\\n text [<|im_sep|>text ...] <|im_end|>\\n

Control strings inside texts and roles are escaped by one backslash between
"<" and "|" (one more where some are there already), so no "<|" of a text
survives and unescaping restores every text. A role's "%" and newline are
percent-coded, since a newline ends the role.

The result holds one string per conversation, so one conversation has to fit
into one row (2 GB); that limit comes from the output, not from the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _blocks(turns: Column) -> Column:
    """Array of (role, texts): runs of adjacent turns with one role."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (turns[i - 1]["role"] != turns[F.greatest(i - 2, F.lit(0))]["role"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(turns) + 1))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(turns[a - 1]["role"].alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")),
    )


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): ``loss_spans`` has the start (from 0) and end, in code points of
    ``formatted``, of the escaped text of every assistant turn. Other columns are left out."""
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    blocks = collected.select("conv_id", _blocks(F.col("turns")).alias("blocks")).select(
        "conv_id",
        F.transform(
            "blocks",
            lambda b: F.struct(
                F.concat(F.lit(START), _role_out(b["role"]), F.lit("\n")).alias("head"),
                (b["role"] == "assistant").alias("loss"),
                F.transform(b["texts"], escape).alias("texts"),
            ),
        ).alias("blocks"),
    )
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], SEP), F.lit(END + "\n"))), "")
    piece = "struct<skip:int,chars:int,loss:boolean>"
    # every turn as the characters before its text, those of its text, and whether it counts
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.char_length(b["head"]) + len(END) + 1).otherwise(len(SEP)).alias("skip"), F.char_length(x).alias("chars"), b["loss"].alias("loss")
                ).cast(piece),
            ),
        )
    )
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(-len(END) - 1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["skip"] + p["chars"]).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["skip"]).alias("start"), (acc["at"] + p["skip"] + p["chars"]).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return blocks.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), the original turns, from a formatted conversation."""
    bodies = F.transform(F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != ""), lambda x: F.substring_index(x, END, 1))
    return F.flatten(
        F.transform(
            bodies,
            lambda x: F.transform(
                F.split(F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.char_length(x)), r"<\|im_sep\|>"),
                lambda y: F.struct(_role_in(F.substring_index(x, "\n", 1)).alias("role"), unescape(y).alias("text")),
            ),
        )
    )


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract of the query asks for, read back from the formatted conversations."""
    turns, loss = read_back(F.col("formatted")), under_loss(F.col("formatted"), F.col("loss_spans"))
    return formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
