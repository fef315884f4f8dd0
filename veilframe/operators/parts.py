"""Large cells: ordered parts of whole lines, and their merge.

Parts are cut at newlines only, as a match never crosses one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.detectors import Detector
from veilframe.functions.matching import tokenised
from veilframe.functions.tokens import TokenRule
from veilframe.shared import names

ROW_ID = "row_id"
# Below this size one task scrubs a cell in seconds, so it stays in its row.
DEALT_BYTES = 32 << 20


def is_large(text: Column, min_split_bytes: int) -> Column:
    """Size routing: is the text large enough to be split?"""
    return F.octet_length(text) > F.lit(min_split_bytes)


def parts_of(text: Column, num_parts: int, min_split_bytes: int) -> Column:
    """The text as an array of up to ``num_parts`` blocks of lines; a text that
    is not large is one part.  Line ``i`` of ``n`` goes to part
    ``floor(i * num_parts / n)``, so parts without a line do not occur."""
    lines = F.split(text, "\n", -1)

    def cut(all_lines: Column) -> Column:
        total = F.size(all_lines).cast("bigint")

        def first_line(part: Column) -> Column:
            return F.floor((part * total + F.lit(num_parts - 1)) / F.lit(num_parts)).cast("int")

        def block(part: Column) -> Column:
            start = first_line(part)
            return F.slice(all_lines, start + 1, first_line(part + 1) - start)

        blocks = F.transform(F.sequence(F.lit(0), F.lit(num_parts - 1)), block)
        return F.transform(
            F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.array_join(b, "\n")
        )

    # transform over a one-element array binds the split lines to a name.
    blocks = F.element_at(F.transform(F.array(lines), cut), 1)
    return F.when(is_large(text, min_split_bytes), blocks).otherwise(F.array(text))


def joined_parts(parts: Column) -> Column:
    """Inverse of ``parts_of``; null stays null."""
    return F.when(F.get(parts, F.lit(0)).isNotNull(), F.array_join(parts, "\n"))


def split_rows(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    num_parts: int,
    min_split_bytes: int,
) -> DataFrame:
    """One row per part: ``(row_id, key…, part_no, value)``.

    ``row_id`` tells the input rows apart, as keys may repeat; it is stable
    when ``df`` comes straight from a file scan.
    """
    # Numbered before exploding: the id must be the same for all parts of a row.
    parts = parts_of(F.col(col), num_parts, min_split_bytes)
    numbered = df.select(F.monotonically_increasing_id().alias(ROW_ID), *names(key), parts.alias("_parts"))
    return numbered.select(ROW_ID, *names(key), F.posexplode("_parts").alias("part_no", "value"))


def merge_rows(
    parts: DataFrame, key: str | Sequence[str], value: str = "value", out: str = "text"
) -> DataFrame:
    """Parts back into ``(key…, out)``, in part order.

    Grouped by input row, so a group never holds more than one original cell,
    however often its key occurs.
    """
    keys = names(key)
    ordered = F.array_sort(F.collect_list(F.struct("part_no", F.col(value).alias("value"))))
    return (
        parts.groupBy(ROW_ID, *keys)
        .agg(ordered.alias("_parts"))
        .select(*keys, joined_parts(F.col("_parts.value")).alias(out))
    )


def scrub_in_parts(
    df: DataFrame,
    col: str,
    detectors: list[Detector],
    tokens: TokenRule,
    out: str,
    num_parts: int,
    min_split_bytes: int,
) -> DataFrame:
    """Scrub cells where they are, and very large ones part by part.

    The parts of cells beyond ``min_split_bytes``, 32 MB at least, become rows
    that are dealt out over all tasks, scrubbed there, and merged by row, so
    that one huge cell keeps more than one task busy; only they are shuffled.
    The table is read once for either kind.  On a stream, which cannot be
    regrouped, every cell is scrubbed in its row.
    """
    text, min_split_bytes = F.col(col), max(min_split_bytes, DEALT_BYTES)
    small = df if df.isStreaming else df.where(~F.coalesce(is_large(text, min_split_bytes), F.lit(False)))
    small = small.withColumn(out, tokenised(text, detectors, tokens))
    if df.isStreaming:
        return small
    others = [F.col(f"`{c}`") for c in df.columns if c != out]
    # Numbered before exploding; what is beside the text travels with part 0.
    cells = df.where(is_large(text, min_split_bytes)).select(
        F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0), *others).alias("rest"), parts_of(text, num_parts, min_split_bytes).alias("parts")
    )
    pieces = cells.select("row", "rest", F.posexplode("parts").alias("part", "value"))
    pieces = pieces.select("row", "part", "value", F.when(F.col("part") == 0, F.col("rest")).alias("rest")).repartition("row", "part")
    scrubbed = pieces.withColumn("value", tokenised(F.col("value"), detectors, tokens))
    merged = scrubbed.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("part", "value"))).alias("parts"), F.first("rest", ignorenulls=True).alias("rest")
    )
    whole = [joined_parts(F.col("parts.value")).alias(c) if c == out else F.col("rest")[c].alias(c) for c in small.columns]
    return small.unionByName(merged.select(*whole))
