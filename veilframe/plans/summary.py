"""What a run did: one row of counts, and its timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.operators.joins import attach
from veilframe.operators.routing import INLINE, routes_from
from veilframe.operators.segments import count_column, counts_by_kind, distinct_segments
from veilframe.options import HYBRID, LOW_LEVEL, RIPGREP, Options
from veilframe.shared import names, written
from veilframe.sources.text import file_heads, opts_out, quarantine

SUCCESS, NOTHING_TO_DO = "SUCCESS", "IGNORED"


def run_summary(
    df: DataFrame, key: str | Sequence[str], col: str, order: Sequence[str], options: Options
) -> DataFrame:
    """One row: files seen, opted out, not text, untouched and rewritten, lines in
    quarantine, distinct segments per kind (summed over files), status.

    Segments are those of the profile that the strategy rewrites a file by.  A
    failed run has no summary: it raises.
    """
    keys = names(key)
    heads = written(
        file_heads(df, keys, col, order).withColumn("aside", opts_out(F.col("first_line"), options.ignore_hint)), "heads"
    )
    readable, _ = quarantine(without(df, heads, keys, options), col)
    return summary_of(heads, segment_counts(readable, keys, col, options), options)


def without(df: DataFrame, heads: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """The rows of files that are not set ``aside``."""
    return attach(df, heads.where("aside").select(*keys), keys, "left_anti", broadcast_limit=o.broadcast_limit_bytes)


def summary_of(heads: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """The summary from the heads of all files, with ``aside``, and the segment
    counts of the others; stacked and added up in one aggregate."""
    counts = [count_column(d.kind) for d in options.loose]
    zero = F.lit(0).cast("bigint")
    aside = F.coalesce("aside", F.lit(False))
    not_text = F.col("not_text") if "not_text" in heads.columns else F.lit(False)
    measures = ["files_seen", "opted_out", "not_text", "untouched", "rewritten", "quarantined_lines", *counts]

    def stacked(rows: DataFrame, **given) -> DataFrame:
        return rows.select(*[given.get(m, zero).cast("bigint").alias(m) for m in measures])

    touched = (F.col("total_segments") > 0).cast("bigint")
    files = stacked(
        heads,
        files_seen=F.lit(1),
        opted_out=aside & ~not_text,
        not_text=not_text,
        untouched=~aside,
        quarantined_lines=F.when(~aside, F.col("n_unreadable")).otherwise(0),
    )
    segments = stacked(found, untouched=-touched, rewritten=touched, **{c: F.col(c) for c in counts})
    totals = files.unionByName(segments).agg(*[F.coalesce(F.sum(m), zero).alias(m) for m in measures])
    status = F.when(F.col("files_seen") > F.col("opted_out") + F.col("not_text"), SUCCESS).otherwise(NOTHING_TO_DO)
    return totals.withColumn("status", status)


def segment_counts(
    lines: DataFrame, keys: list[str], col: str, o: Options, segments: DataFrame | None = None
) -> DataFrame:
    """``(key…, n_<kind>…, total_segments)`` by the profile each file is
    rewritten by: for HYBRID the loose one, and the strict one for files that
    are scrubbed in line.  ``segments`` are the loose ones, if they are there."""

    def by(profile: list[Detector], rows: DataFrame) -> DataFrame:
        return counts_by_kind(distinct_segments(rows, keys, col, profile), keys, profile)

    if o.strategy != HYBRID:
        loose = o.strategy in (LOW_LEVEL, RIPGREP)
        if loose and segments is not None:
            return counts_by_kind(segments, keys, o.loose)
        return by(o.loose if loose else o.strict, lines)
    if segments is None:
        segments = distinct_segments(lines, keys, col, o.loose)
    routes = written(routes_from(segments, keys, o.loose, o.threshold), "routes")
    dense = routes.where(F.col("route") == INLINE).select(*keys)
    in_line = attach(lines, dense, keys, "left_semi", broadcast_limit=o.broadcast_limit_bytes)
    others = routes.where(F.col("route") != INLINE).drop("route")
    return others.unionByName(by(o.strict, in_line).select(*others.columns))


@dataclass(frozen=True)
class Timing:
    """Wall time of an action and the rows and bytes that went through it."""

    seconds: float
    rows: int
    text_bytes: int


def observed(df: DataFrame, col: str, seen: Observation) -> DataFrame:
    """The frame, with its rows and text bytes counted as they pass."""
    return df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.col(col)).cast("bigint")), F.lit(0)).alias("text_bytes"),
    )


def timed(action: Callable[[Observation], None]) -> Timing:
    """Run an action and measure it.  It must put its ``observed`` right at the
    write: what lies below a range partitioning runs twice, for the sample."""
    seen = Observation()
    start = time.monotonic()
    action(seen)
    seconds = time.monotonic() - start
    return Timing(seconds, seen.get["rows"], seen.get["text_bytes"])
