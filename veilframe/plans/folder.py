"""A whole run over a text folder: scan, set aside, mask, write, summarise."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.joins import attach
from veilframe.operators.routing import coin_route
from veilframe.operators.segments import count_column
from veilframe.options import HYBRID, HYBRID_SPLIT, IN_PLACE, LOW_LEVEL, SAM, SIP, Options
from veilframe.plans.strategies import hybrid_with_route, pseudonymize, route_segments
from veilframe.plans.summary import Timing, observed, segment_counts, summary_of, timed, without
from veilframe.shared import spread_out, temporary_tables, written
from veilframe.sources.sinks import PATH_COLUMN, SINK_COLUMN, placed, recover_in_place, replace_in_place, write_mirrored
from veilframe.sources.text import LINE_ORDER, file_heads, opts_out, quarantine, scan_text, unread_files


@dataclass(frozen=True)
class FolderRun:
    """Results of a run.

    ``quarantined`` says where lines are that could not be read (file, part,
    block, line, reason), without their content; ``unread`` lists the files
    that Spark does not read; ``kept_original`` is set for in-place runs that
    keep it.
    """

    summary: DataFrame
    quarantined: DataFrame
    timing: Timing | None = None
    kept_original: str | None = None
    unread: list[str] = field(default_factory=list)


def run_folder(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    options: Options | None = None,
    fmt: str = "text",
    quarantine_path: str | None = None,
) -> FolderRun:
    """Mask the text files below ``input_path``.

    Files that opted out, and files with NUL characters, which are no text, are
    left out of a new output folder, and so are files that Spark does not read.
    Unreadable lines of other files are listed in ``quarantine_path`` (default:
    next to the output); lines read, written and listed are compared.

    Without ``output_path`` the folder is rewritten in place.  All those files,
    and those in which nothing is found, then are not touched, and unreadable
    lines stop the run, so that nothing gets lost.

    HYBRID_SPLIT writes below ``sink=…``, chosen by the coin of each file.
    Tables written on the way hold plain lines and segments; they are deleted
    at the end, also of a failed run.
    """
    options = options or Options()
    with temporary_tables(spark):
        return _run(spark, input_path, output_path, options, fmt, quarantine_path)


def _run(spark, input_path, output_path, options, fmt, quarantine_path) -> FolderRun:
    key = [PATH_COLUMN]
    if output_path is None:
        recover_in_place(spark, input_path)
    lines = spread_out(scan_text(spark, input_path))
    opted_out = F.coalesce(opts_out(F.col("first_line"), options.ignore_hint), F.lit(False))
    heads = file_heads(lines, key, "value", LINE_ORDER, F.collect_set("source").alias("sources"))
    heads = heads.withColumn("not_text", F.col("is_binary") & ~opted_out).withColumn("aside", opted_out | F.col("is_binary"))
    heads = written(heads, "heads")
    totals = heads.where("not aside").agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in ("n_lines", "n_unreadable")])
    n_kept, n_bad = totals.first()
    if n_bad and output_path is None:
        raise RuntimeError(f"{n_bad} lines of {input_path} cannot be read, nothing was changed")
    kept = without(lines, heads, key, options)
    readable, bad = quarantine(kept)
    segments = route_segments(readable, key, "value", options) if options.strategy == HYBRID else None
    counts = written(segment_counts(readable, key, "value", options, segments), "counts")
    schema = ", ".join(_SUMMARY + [f"{count_column(d.kind)} bigint" for d in options.loose] + ["status string"])
    summary = spark.createDataFrame(summary_of(heads, counts, options).collect(), schema)  # one row
    unread = unread_files(spark, input_path)
    places = bad.select(PATH_COLUMN, *LINE_ORDER, "reason")
    if not n_bad:
        places = spark.createDataFrame([], places.schema)
    is_placed = fmt == "text" and options.strategy not in (LOW_LEVEL, HYBRID)

    def masked_rows(rows: DataFrame) -> DataFrame:
        # Dealing lines out by order samples what is below: it is done before
        # row-wise masking, and for the others on their written result.
        rows = placed(rows) if is_placed else rows
        if segments is None:
            # Spark has split the files already; a line is no large cell.
            by_row = options.strategy in (SAM, SIP, HYBRID_SPLIT)
            masked = pseudonymize(rows, PATH_COLUMN, "value", replace(options, strategy=IN_PLACE) if by_row else options)
        else:
            masked = hybrid_with_route(rows, key, "value", "value", options, segments).drop("_route")
        if options.strategy == HYBRID_SPLIT:
            masked = masked.withColumn(SINK_COLUMN, coin_route(PATH_COLUMN, options.salt))
        return masked if is_placed or fmt != "text" else written(masked, "masked")

    if output_path is not None:
        quarantine_path = quarantine_path or f"{output_path.rstrip('/')}.quarantine"
        places.write.parquet(quarantine_path)
        masked = masked_rows(readable)
        timing = timed(
            lambda seen: write_mirrored(
                masked, output_path, fmt=fmt, at_write=lambda rows: observed(rows, "value", seen), is_placed=is_placed
            )
        )
        if timing.rows + n_bad != n_kept:
            raise RuntimeError(f"{n_kept} lines read but {timing.rows} written and {n_bad} unreadable")
        return FolderRun(summary, spark.read.schema(places.schema).parquet(quarantine_path), timing, unread=unread)

    # Only files in which something was found are replaced.
    found = counts.where(F.col("total_segments") > 0).select(*key)
    touched = {r[PATH_COLUMN]: (r["n_lines"], r["sources"]) for r in heads.join(found, key).toLocalIterator()}
    readable = attach(readable, found, key, "left_semi", broadcast_limit=options.broadcast_limit_bytes)
    original = None

    def swap(seen: Observation) -> None:
        nonlocal original
        original = replace_in_place(
            spark,
            input_path,
            lambda _: masked_rows(readable),
            remove_original=options.remove_original,
            at_write=lambda rows: observed(rows, "value", seen),
            is_placed=is_placed,
            files=touched,
        )

    timing = timed(swap) if touched else Timing(0.0, 0, 0)
    return FolderRun(summary, places, timing, original, unread)


_SUMMARY = [f"{n} bigint" for n in ("files_seen", "opted_out", "not_text", "untouched", "rewritten", "quarantined_lines")]
