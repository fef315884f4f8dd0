"""Chat formatting from every participant's point of view.

A dialogue is rendered once for each participant: that speaker's turns become
the assistant's and are marked for training, all others speak as named users,
and system turns stay what they are.  Dialogues of more than ``TURNS`` turns
are rendered in consecutive parts, whose texts concatenate to the whole; so a
dialogue of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.joins import attach
from veilframe.operators.ranking import rank_within
from veilframe.shared import written

TURNS = 256
SYSTEM = "system"
NOBODY = "unknown"


def _in_mark(role: Column) -> Column:
    """A role as it may stand in a mark: it neither ends it nor starts another."""
    return F.replace(F.regexp_replace(role, r"[\r\n]", " "), F.lit("|"), F.lit("¦"))


def _segment(turn: Column, speaker: Column) -> Column:
    who = turn["role"]
    head = (
        F.when(who == SYSTEM, F.lit("<|system|>"))
        .when(who == speaker, F.lit("<|assistant|>"))
        .otherwise(F.concat(F.lit("<|user:"), _in_mark(who), F.lit("|>")))
    )
    return F.concat(head, F.lit("\n"), turn["text"], F.lit("<|end|>\n"))


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    broadcast_limit: int = 8 << 20,
) -> DataFrame:
    """``(conv_id, speaker, part, n_turns, text, mask)``: one row for each
    participant of a dialogue and part of it.

    ``mask`` holds the spans ``(start, end)`` of ``text``, in code points, that
    the speaker said, end marks included.  Turns are ordered by number, role and text,
    nulls first; equal rows are turns of their own.  A null or empty role
    speaks as ``unknown``, a null text is empty, turns of a null id are one
    dialogue.  ``<|`` inside a text is written ``< |``; inside the mark of a
    turn, ``|`` in a role is written ``¦`` and a line end as a blank.  A dialogue without
    participants (system turns only) has no row; an empty table gives none.
    """
    said = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(F.coalesce(F.col(role_col), F.lit("")) == "", NOBODY).otherwise(F.col(role_col)).alias("role"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    order = [F.col("turn"), F.col("role"), F.col("text")]
    ranked = rank_within(said, ["conv"], order, "place")
    part = F.floor((F.col("place") - 1) / TURNS).cast("int")
    parts = ranked.groupBy("conv", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    who = said.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("speaker")).distinct()
    # A dialogue with many parts is salted, if its speakers are not broadcast.
    seen = attach(parts, written(who, "speakers"), ["conv"], "inner", broadcast_limit=broadcast_limit)
    segments = F.transform("turns", lambda t: _segment(t, F.col("speaker")))
    own = F.transform("turns", lambda t: t["role"] == F.col("speaker"))
    rendered = seen.withColumn("segments", segments).withColumn("own", own)
    head = len("<|assistant|>\n")
    walked = F.aggregate(
        F.arrays_zip("segments", "own"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda done, x: F.struct(
            (done["at"] + F.length(x["segments"])).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + head).alias("start"),
                            # All but the newline after the end mark.
                            (done["at"] + F.length(x["segments"]) - 1).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return rendered.select(
        F.col("conv").alias(conv_col),
        "speaker",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join("segments", "").alias("text"),
        walked.alias("mask"),
    )
