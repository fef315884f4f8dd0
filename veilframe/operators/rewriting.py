"""Row-wise rewrites: in-line scrub and constant mask.  Both are map-only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.functions.matching import masked, tokenised
from veilframe.functions.tokens import TokenRule


def scrub(
    df: DataFrame, col: str, detectors: list[Detector], tokens: TokenRule, out: str | None = None
) -> DataFrame:
    """Replace every match in ``col`` by its token (into ``out`` when given)."""
    return df.withColumn(out or col, tokenised(F.col(col), detectors, tokens))


def mask_kinds(
    df: DataFrame, col: str, detectors: list[Detector], out: str | None = None
) -> DataFrame:
    """Replace every match by the fixed label of its kind; nothing to link by."""
    return df.withColumn(out or col, masked(F.col(col), detectors))
