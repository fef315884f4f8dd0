"""Finding segments: one scan for all kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.functions.matching import has_any_match, matches
from veilframe.shared import names


def detect(
    df: DataFrame, key: str | Sequence[str], col: str, detectors: list[Detector]
) -> DataFrame:
    """Every match of every detector: ``(key…, kind, pos, segment)``.

    ``pos`` counts the matches of a kind within the row.  The detectors share
    one scan: their matches sit in one array per row, which is then inlined.
    """
    found = F.array(
        *[
            F.struct(F.lit(d.kind).alias("kind"), matches(F.col(col), d).alias("found"))
            for d in detectors
        ]
    )
    keys = names(key)
    return (
        df.select(*keys, F.inline(found))
        .where(F.size("found") > 0)
        .select(*keys, "kind", F.posexplode("found").alias("pos", "segment"))
    )


def sensitive_rows(df: DataFrame, col: str, detectors: list[Detector]) -> DataFrame:
    """The rows in which any detector finds something."""
    return df.where(has_any_match(F.col(col), detectors))
