"""Distinct segments per file and kind, their cleaning, order and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.functions.matching import clean_segment, matches
from veilframe.operators.ranking import rank_within
from veilframe.shared import names


def distinct_segments(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    detectors: list[Detector],
    *,
    keep_empty: bool = False,
    clean: bool = False,
) -> DataFrame:
    """``(key…, kind, segment)``, each once.

    Repeats are dropped within the row first, then by partial aggregation
    before the shuffle.  ``keep_empty`` adds one row with null kind and segment
    per key that has rows without a match, so that no key gets lost.  ``clean``
    gives the ``cleaned`` segments at once, with one shuffle instead of two.
    """
    keys = names(key)

    def tagged(d: Detector) -> Column:
        found = matches(F.col(col), d)
        if clean:
            found = F.filter(F.transform(found, clean_segment), lambda m: m != "")
        return F.transform(
            F.array_distinct(found),
            lambda m: F.struct(F.lit(d.kind).alias("kind"), m.alias("segment")),
        )

    explode = F.explode_outer if keep_empty else F.explode
    return (
        df.select(*keys, explode(F.flatten(F.array(*[tagged(d) for d in detectors]))).alias("s"))
        .select(*keys, F.col("s.kind").alias("kind"), F.col("s.segment").alias("segment"))
        .distinct()
    )


def cleaned(segments: DataFrame) -> DataFrame:
    """Segments without trailing quotes and surrounding blanks; what becomes
    empty is dropped and what becomes equal is merged."""
    return (
        segments.withColumn("segment", clean_segment(F.col("segment")))
        .where(F.col("segment") != "")
        .distinct()
    )


def priority_of(kind: Column, detectors: list[Detector]) -> Column:
    """Rewriting priority of a kind column; constant per detector."""
    chain = F
    for d in detectors:
        chain = chain.when(kind == d.kind, F.lit(d.priority))
    return chain


def longest_first(segments: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Adds ``rank``: longest segment first within key and kind, then by text."""
    order = [F.desc("_length"), F.asc("segment")]
    with_length = segments.withColumn("_length", F.length("segment"))
    return rank_within(with_length, [*names(key), "kind"], order, "rank").drop("_length")


def by_precedence(
    segments: DataFrame, key: str | Sequence[str], detectors: list[Detector]
) -> DataFrame:
    """Adds ``rank``: the rewriting order within a key, that is kind priority,
    then longest first, then text."""
    prepared = segments.withColumn("_priority", priority_of(F.col("kind"), detectors)).withColumn(
        "_length", F.length("segment")
    )
    order = [F.asc("_priority"), F.desc("_length"), F.asc("segment")]
    return rank_within(prepared, names(key), order, "rank").drop("_priority", "_length")


def count_column(kind: str) -> str:
    """Name of the count column of a kind: ``n_file_dir`` for ``FILE-DIR``."""
    return "n_" + kind.lower().replace("-", "_")


def counts_by_kind(
    segments: DataFrame, key: str | Sequence[str], detectors: list[Detector]
) -> DataFrame:
    """Distinct segments per key, by kind and in total.

    ``segments`` is already distinct, so these are plain conditional counts:
    each task reduces a hot key to one row before the shuffle.
    """
    per_kind = [
        F.count(F.when(F.col("kind") == d.kind, F.col("segment"))).alias(count_column(d.kind))
        for d in detectors
    ]
    return segments.groupBy(*names(key)).agg(*per_kind, F.count("segment").alias("total_segments"))
