"""Which files get which treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.operators.parts import is_large
from veilframe.operators.segments import counts_by_kind, distinct_segments
from veilframe.shared import names

IGNORED, DICTIONARY, INLINE = "ignored", "dictionary", "inline"


def density_route(total_segments: Column, threshold: int) -> Column:
    """Nothing found: leave alone; few distinct segments: dictionary rewrite;
    ``threshold`` or more: in-line scrub."""
    return (
        F.when(total_segments == 0, F.lit(IGNORED))
        .when(total_segments >= F.lit(threshold), F.lit(INLINE))
        .otherwise(F.lit(DICTIONARY))
    )


def density_routes(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    detectors: list[Detector],
    threshold: int,
) -> DataFrame:
    """``(key…, n_<kind>…, total_segments, route)``, one row per key.

    Distinct segments are counted as found, before any cleaning.
    """
    segments = distinct_segments(df, key, col, detectors, keep_empty=True)
    return routes_from(segments, key, detectors, threshold)


def routes_from(
    segments: DataFrame, key: str | Sequence[str], detectors: list[Detector], threshold: int
) -> DataFrame:
    """The same from distinct segments that were kept with empty keys."""
    counts = counts_by_kind(segments, key, detectors)
    return counts.withColumn("route", density_route(F.col("total_segments"), threshold))


def coin_route(key: str | Sequence[str], salt: str) -> Column:
    """A repeatable coin flip per key: ``split_merge`` or ``split_in_place``."""
    text = F.concat(F.lit(salt), F.concat_ws("\x1f", *[F.col(k).cast("string") for k in names(key)]))
    heads = F.substring(F.md5(text.cast("binary")), 1, 1) < "8"
    return F.when(heads, F.lit("split_merge")).otherwise(F.lit("split_in_place"))


def size_route(text: Column, min_split_bytes: int) -> Column:
    """``split`` for large texts, ``whole`` for the rest."""
    return F.when(is_large(text, min_split_bytes), F.lit("split")).otherwise(F.lit("whole"))
