"""The strategy facade: one call, seven compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.matching import tokenised
from veilframe.operators.dictionary import entries, rewrite_by_entries, rewrite_with_dictionary
from veilframe.operators.joins import attach
from veilframe.operators.parts import scrub_in_parts
from veilframe.operators.rewriting import mask_kinds, scrub
from veilframe.operators.routing import DICTIONARY, INLINE, routes_from
from veilframe.operators.segments import cleaned, distinct_segments
from veilframe.options import (
    HYBRID,
    HYBRID_SPLIT,
    IN_PLACE,
    LOW_LEVEL,
    RIPGREP,
    SAM,
    SIP,
    Options,
)
from veilframe.shared import names, written


def pseudonymize(
    df: DataFrame,
    key: str | Sequence[str],
    col: str,
    options: Options | None = None,
    out: str | None = None,
) -> DataFrame:
    """``df`` with ``col`` masked (into ``out`` when given).

    ``key`` names the file of a row: dictionaries and routes are per key.
    IN_PLACE, SAM, SIP and HYBRID_SPLIT give equal tables.  IN_PLACE and
    RIPGREP are map-only; the split ones deal the parts of large cells out over
    all tasks; LOW_LEVEL and HYBRID first collect the segments per key.
    """
    options = options or Options()
    target = out or col
    run = {
        IN_PLACE: _in_place,
        SAM: _split,
        SIP: _split,
        LOW_LEVEL: _low_level,
        HYBRID: _hybrid,
        HYBRID_SPLIT: _hybrid_split,
        RIPGREP: _constant_mask,
    }[options.strategy]
    return run(df, names(key), col, target, options)


def _in_place(df: DataFrame, keys: list[str], col: str, out: str, o: Options) -> DataFrame:
    return scrub(df, col, o.strict, o.tokens, out)


def _split(df: DataFrame, keys: list[str], col: str, out: str, o: Options) -> DataFrame:
    return scrub_in_parts(df, col, o.strict, o.tokens, out, o.num_parts, o.min_split_bytes)


def _constant_mask(df: DataFrame, keys: list[str], col: str, out: str, o: Options) -> DataFrame:
    return mask_kinds(df, col, o.loose, out)


def _low_level(df: DataFrame, keys: list[str], col: str, out: str, o: Options) -> DataFrame:
    return rewrite_with_dictionary(
        df,
        keys,
        col,
        o.loose,
        o.tokens,
        out,
        max_inline_entries=o.max_inline_entries,
        broadcast_limit=o.broadcast_limit_bytes,
    )


def hybrid_with_route(
    df: DataFrame, keys: list[str], col: str, out: str, o: Options, segments: DataFrame | None = None
) -> DataFrame:
    """HYBRID, with the route of each row kept as ``_route``; ``segments`` are
    the written ``route_segments``, if they are there already.

    Route and dictionary of a key ride on one join; each row is then rewritten
    by the one branch its route names.
    """
    if segments is None:
        segments = route_segments(df, keys, col, o)
    routes = written(
        routes_from(segments, keys, o.loose, o.threshold).select(*keys, F.col("route").alias("_route")), "routes"
    )
    sparse = _segments_below(segments, keys, routes, o)
    routed = rewrite_by_entries(
        df,
        keys,
        col,
        written(entries(cleaned(sparse), o.loose, o.tokens), "entries"),
        "_by_dictionary",
        max_inline_entries=o.max_inline_entries,
        broadcast_limit=o.broadcast_limit_bytes,
        carry=routes,
        when=F.col("_route") == DICTIONARY,
    )
    by_route = (
        F.when(F.col("_route") == INLINE, tokenised(F.col(col), o.strict, o.tokens))
        .when(F.col("_route") == DICTIONARY, F.col("_by_dictionary"))
        .otherwise(F.col(col))
    )
    return routed.withColumn(out, by_route).drop("_by_dictionary")


def route_segments(df: DataFrame, keys: list[str], col: str, o: Options) -> DataFrame:
    """Distinct loose segments, with a row for every key, written."""
    return written(distinct_segments(df, keys, col, o.loose, keep_empty=True), "segments")


def _segments_below(
    segments: DataFrame, keys: list[str], routes: DataFrame, o: Options
) -> DataFrame:
    few = routes.where(F.col("_route") == DICTIONARY).select(*keys)
    found = segments.where(F.col("kind").isNotNull())
    return attach(found, few, keys, "left_semi", broadcast_limit=o.broadcast_limit_bytes)


def _hybrid(df: DataFrame, keys: list[str], col: str, out: str, o: Options) -> DataFrame:
    return hybrid_with_route(df, keys, col, out, o).drop("_route")


def _hybrid_split(df: DataFrame, keys: list[str], col: str, out: str, o: Options) -> DataFrame:
    """Both sides of the coin scrub in parts; they differ in the sink only,
    for which ``coin_route`` says which rows go where."""
    return _split(df, keys, col, out, o)
