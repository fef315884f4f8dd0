"""SimHash near-duplicates by meeting in the middle of a Hamming ball.

Two fingerprints differ in at most 2r bits exactly if some value differs from
each of them in at most r.  So every distinct fingerprint emits all values
within r bits, fingerprints that emit one value meet in a shuffle on it, and a
candidate pair is verified by counting differing bits.  A value is emitted by
at most as many fingerprints as lie in its ball (65 for r = 1), whatever the
number of copies, so no meeting is large; and as links only have to connect,
each meeting links its members to its smallest one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.components import connect
from veilframe.llm.text import LOWER, WORDS, map_named, raw, tokens
from veilframe.shared import written

WIDTH = 3
RADIUS = 2


def fingerprints_of(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """A fingerprint per text.

    Words are runs without blanks, lower-cased A-Z; shingles are ``width``
    words joined by one space, repeats included; a shorter text is one shingle
    and a text without words has fingerprint zero.  A bit is set if it is set
    in over half of the shingles' XXH64 (seed 42).
    """
    data, offsets = raw(texts)
    found = tokens(data, offsets, WORDS, LOWER)
    # The words again, one blank after each, so that a shingle is one slice.
    size = found.end - found.start
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, found.start, 1)
    np.add.at(keep, found.end, -1)
    inside = np.cumsum(keep[:-1]) > 0
    last = np.cumsum(size + 1) - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    blank = np.zeros(len(joined), bool)
    blank[last] = True
    joined[~blank] = LOWER[data[inside]]
    first = last - size
    n_words = np.bincount(found.text, minlength=len(texts))
    ends = np.cumsum(n_words)
    result = np.zeros(len(texts), np.uint64)
    view = memoryview(joined.tobytes())
    digest = xxhash.xxh64_intdigest
    for i in np.flatnonzero(n_words):
        lo, hi = ends[i] - n_words[i], ends[i]
        if hi - lo < width:
            bounds = [(int(first[lo]), int(last[hi - 1]))]
        else:
            bounds = zip(first[lo : hi - width + 1].tolist(), last[lo + width - 1 : hi].tolist(), strict=True)
        hashes = np.array([digest(view[a:b], 42) for a, b in bounds], np.uint64)
        ones = np.zeros(64, np.int64)
        for part in range(0, len(hashes), 65536):
            bits = np.unpackbits(hashes[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        result[i] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return result


def with_fingerprint(df: DataFrame, text_col: str, rows: list[str], width: int = WIDTH) -> DataFrame:
    """``(row, fingerprint)``: the fingerprint's bits as a signed long."""
    return map_named(
        df,
        text_col,
        rows,
        [T.StructField("fingerprint", T.LongType())],
        lambda texts: [pa.array(fingerprints_of(texts, width).view(np.int64))],
    )


def _ball(radius: int) -> list[int]:
    """All masks with up to ``radius`` of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(src, dst)`` that connect all distinct fingerprints within
    ``radius`` (even) differing bits; ``fingerprints`` has one column, distinct."""
    if radius % 2:
        raise ValueError(f"radius must be even, got {radius}")
    fp = F.col("fingerprint")
    masks = F.array(*[F.lit(m).cast("bigint") for m in _ball(radius // 2)])
    emitted = fingerprints.select("fingerprint", F.explode(masks).alias("mask")).select(
        "fingerprint", fp.bitwiseXOR(F.col("mask")).alias("variant")
    )
    # At most one ball of fingerprints meets at a variant.
    met = emitted.groupBy("variant").agg(F.collect_list("fingerprint").alias("met")).where(F.size("met") > 1)
    pairs = met.select(F.array_min("met").alias("src"), F.explode("met").alias("dst")).where("src <> dst")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    return pairs.distinct().where(near)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Fingerprints link at ``radius`` or fewer differing bits; the component is
    the smallest id reachable.  Null and empty texts have fingerprint zero and
    are linked like any other; rows with equal ids or texts all stay; a null id
    stays null and never names a component that has another id; an empty table
    gives an empty result.
    """
    marked = with_fingerprint(df, text_col, [id_col], width)
    marked = written(marked.select(F.col(f"row.`{id_col}`").alias("id"), "fingerprint"), "fingerprints")
    return _grouped(marked, radius, F.min("id"), "component_id").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _grouped(marked: DataFrame, radius: int, pick: Column, name: str) -> DataFrame:
    """``marked`` with ``pick`` over each component's rows as column ``name``.

    ``pick`` is taken per fingerprint first, so copies cost one row each in the
    first partial aggregation only.
    """
    each = written(marked.groupBy("fingerprint").agg(pick.alias(name)), "distinct-fingerprints")
    roots = connect(links(each.select("fingerprint"), radius))
    linked = written(each.join(roots, F.col("fingerprint") == F.col("node"), "left"), "linked")
    root = F.coalesce("root", "fingerprint")
    best = linked.where("root is not null").groupBy("root").agg(F.min(name).alias("_best"))
    per_fingerprint = linked.withColumn("_key", root).join(
        best.withColumnRenamed("root", "_root"), F.col("_key") == F.col("_root"), "left"
    )
    per_fingerprint = written(
        per_fingerprint.select(F.col("fingerprint").alias("_fp"), F.coalesce("_best", name).alias(name)), "classes"
    )
    return marked.join(per_fingerprint, F.col("fingerprint") == F.col("_fp"), "left").drop("_fp")


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, radius: int = RADIUS
) -> DataFrame:
    """The input rows without near-duplicates: of each component the row with
    the smallest id stays (a null id last; of equal rows one)."""
    marked = with_fingerprint(df, text_col, df.columns, width)
    # Numbered once, at the write: later reads see the same numbers.
    marked = written(marked.withColumn("number", F.monotonically_increasing_id()), "numbered")
    last = F.col(f"row.`{id_col}`").isNull()
    narrow = marked.select(
        "number", "fingerprint", F.struct(last, F.col(f"row.`{id_col}`").alias("id"), "number").alias("place")
    )
    best = _grouped(narrow, radius, F.min("place"), "best").where("place = best").select(F.col("number").alias("_n"))
    return marked.join(best, F.col("number") == F.col("_n"), "left_semi").select("row.*")
