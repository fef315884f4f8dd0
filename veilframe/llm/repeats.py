"""Removal of byte strings that occur elsewhere, by refining buckets of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  As in bucket-pointer refinement, suffixes first fall into buckets by
their q-gram, and a bucket is then split by sorting on the identifiers of what
lies at other offsets; the new identifiers key the next round, which works on
its undecided members only.  Three things make that a Spark job:

* Only sampled suffixes are sorted.  Every window of ``length`` bytes picks the
  smallest of its q-grams, the leftmost of equal ones; equal windows pick the
  same one at the same offset, so an *anchor* stands for a run of windows.
* A row is an anchor with a range of offsets.  What all windows of the range
  have in common is its bucket; a bucket of one holds no repeat and is left.
  Rows whose windows together are the same string repeat as a whole, and one of
  them goes on as a witness for the others.  What is neither is cut into
  smaller ranges, whose buckets are the old identifier refined by the added
  bytes, down to single windows, where both strings are the window.
* Members are counted by partial aggregation and found again by a join in which
  keys that would fill a task are broadcast (fewer than there are partitions),
  so a bucket with a third of all suffixes is never in one place.

Strings are known by 64 bits for the bucket and 64 for the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.text import CHUNK_BYTES, in_small_batches, map_named, mix, raw, slices
from veilframe.shared import dropped, written

LENGTH = 200
GRAM = 32
_PLACES = np.uint64(24)
_AT = np.uint64((1 << 24) - 1)
# A longer text is searched in pieces that overlap by a window, so that a place
# fits into the low bits of a key.
PIECE = 4 << 20
_BASE = 0x5851F42D4C957F2D
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, np.uint64(base))
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


def _picked(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(anchor, first window, last window)`` for all windows of the texts that
    ``data`` holds one after another, at most ``PIECE`` bytes and a window."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, n), out=sums[1:])
    keys = mix((sums[gram:] - sums[:-gram]) * _powers(pow(_BASE, -1, 1 << 64), n - gram + 1))
    keys = (keys >> _PLACES << _PLACES) | np.arange(len(keys), dtype=np.uint64)
    # The least key of each run of ``width``: ends of one block, start of the next.
    blocks = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    windows = n - length + 1
    anchor = (np.minimum(onward[:windows], upto[width - 1 : width - 1 + windows]) & _AT).astype(np.int64)
    last = np.repeat(offsets[1:], np.diff(offsets))[:windows] - length
    start = np.flatnonzero(np.arange(windows) <= last)
    if not len(start):
        return none, none, none
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return anchor[at], start[at], start[np.append(at[1:], len(start)) - 1]


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """:func:`_picked` for texts of any size."""
    if len(data) <= PIECE:
        return _picked(data, offsets, length, gram)
    parts = []
    for lo in range(0, len(data), PIECE):
        hi = min(lo + PIECE + length - 1, len(data))
        inside = np.clip(offsets, lo, hi) - lo
        parts.append([x + lo for x in _picked(data[lo:hi], np.unique(np.append(inside, (0, hi - lo))), length, gram)])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def _digests(view: memoryview, start: np.ndarray, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    triples = zip(start.tolist(), end.tolist(), seeds.tolist(), strict=True)
    return np.array([digest(view[a:b], seed) for a, b, seed in triples], np.uint64)


def _marked(df: DataFrame, text_col: str, rows: list[str], length: int, gram: int) -> DataFrame:
    """The rows with their packed text and, as lists, their anchors: place,
    first and last offset of a window before it, bucket and whole."""

    def work(texts: pa.Array) -> list:
        data, offsets = raw(texts)
        anchor, first, last = anchors_of(data, offsets, length, gram)
        view = memoryview(data.tobytes())
        owner = np.searchsorted(offsets, anchor, side="right") - 1
        bucket = _digests(view, anchor, anchor + gram, np.zeros(len(anchor), np.int64))
        whole = _digests(view, first, last + length, anchor - first)
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = [anchor - offsets[owner], anchor - last, anchor - first, bucket, whole]
        return [pa.array(packed, pa.binary()), *(_lists(c, owner, len(texts)) for c in columns)]

    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("at", "low", "high", "bucket", "whole")]
    return map_named(df, text_col, rows, [T.StructField("packed", T.BinaryType()), *lists], work)


def _several(rows: DataFrame, key: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """``key`` and the number ``n`` of its rows; ``more`` are further aggregates."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in (more or {}).items()))


def _among(rows: DataFrame, keys: DataFrame, key: list[str], total: int) -> DataFrame:
    """The rows whose key is among the distinct ``keys``, which have their number ``n``.

    A key with more than one in P of the ``total`` rows (P shuffle partitions,
    so there are fewer than P) is broadcast, so its rows stay where they are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("n") * parts > total
    in_hot = keys.where(hot).select(*key)
    found = rows.join(F.broadcast(in_hot), key, "left_semi")
    others = rows.join(F.broadcast(in_hot), key, "left_anti")
    return found.select(*rows.columns).union(others.join(keys.where(~hot).select(*key), key, "left_semi").select(*rows.columns))


_ROW = ["bucket", "whole", "number", "at", "low", "high", "done"]


def _decided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows in buckets: the windows found to repeat, and the undecided rows."""
    one = F.min(F.struct(*_ROW[2:])).alias("one")
    alike = written(_several(rows, ["bucket", "whole"], {"one": one}), "alike")
    repeated = _among(rows.where("not done"), alike.where("n > 1"), ["bucket", "whole"], rows.count())
    open_buckets = _several(alike, ["bucket"]).where("n > 1")
    going = alike.select("bucket", "one.number", "one.at", "one.low", "one.high", (F.col("one.done") | (F.col("n") > 1)).alias("done"))
    runs = written(repeated.select("number", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low")).alias("last")), "runs")
    return runs, written(_among(going, open_buckets, ["bucket"], alike.count()), "open")


def _contexts(going: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """The rows with the bytes that their windows cover."""
    asked = going.groupBy("number").agg(F.collect_list(F.struct("bucket", "at", "low", "high", "done")).alias("asked"))
    both = asked.withColumnRenamed("number", "_number").join(marked.select("number", "packed"), F.col("_number") == F.col("number"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            numbers, packed, asked = (batch.column(n) for n in range(3))
            for lo, hi in slices(packed, CHUNK_BYTES // 4):
                rows = asked.slice(lo, hi - lo).flatten()
                sizes = np.diff(asked.offsets.to_numpy())[lo:hi]
                at, low, high = (rows.field(n).to_numpy() for n in (1, 2, 3))
                ends = (at - low + length).tolist()
                bounds = zip((at - high).tolist(), ends, strict=True)
                cut = []
                for n, size in zip(range(lo, hi), sizes.tolist(), strict=True):
                    text = memoryview(unpack(packed[n].as_py()))
                    cut.extend(bytes(text[a:b]) for a, b in islice(bounds, size))
                number = pa.array(np.repeat(numbers.to_numpy()[lo:hi], sizes))
                yield pa.RecordBatch.from_arrays(
                    [number, *rows.flatten(), pa.array(cut, pa.binary())],
                    names=["number", "bucket", "at", "low", "high", "done", "bytes"],
                )

    schema = "number long, bucket long, at long, low long, high long, done boolean, bytes binary"
    return in_small_batches(both.select("number", "packed", "asked")).mapInArrow(run, schema)


def _cells(contexts: DataFrame, outer: int, size: int, length: int) -> DataFrame:
    """Rows cut into ranges of at most ``size`` offsets on a grid; ``low`` and
    ``high`` lie in one cell of the ``outer`` grid.

    The bucket is the old one refined by the bytes that a smaller cell's windows
    have in common besides those of the outer cell.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, bucket, at, low, high, done = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(6))
            n_cells = high // size - low // size + 1
            row = np.repeat(np.arange(len(at)), n_cells)
            cell = np.arange(len(row)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells) + (low // size)[row]
            left, right = np.maximum(cell * size, low[row]), np.minimum(cell * size + size - 1, high[row])
            # Places in the row's bytes, which begin at its highest offset.
            data, starts = raw(batch.column(6).cast(pa.large_binary()))
            view = memoryview(data.tobytes())
            base = starts[row] + high[row]
            old = low[row] // outer * outer
            core = (base - cell * size, base - (cell * size + size - 1) + length)
            outer_core = (base - old, base - (old + outer - 1) + length)
            before = _digests(view, core[0], np.maximum(outer_core[0], core[0]), bucket[row].view(np.uint64))
            refined = _digests(view, np.minimum(outer_core[1], core[1]), core[1], before)
            whole = _digests(view, base - right, base - left + length, right - left)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (refined.view(np.int64), whole.view(np.int64), number[row], at[row], left, right, done[row])], names=_ROW
            )

    schema = "bucket long, whole long, number long, at long, low long, high long, done boolean"
    return in_small_batches(contexts.select("number", "bucket", "at", "low", "high", "done", "bytes")).mapInArrow(run, schema)


def _repeats(marked: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Windows ``(number, start, last)`` that repeat: all that start at
    ``start`` to ``last``."""
    width = length - gram + 1
    size = max(int(width**0.5), 1)
    zipped = F.arrays_zip("bucket", "whole", "at", "low", "high")
    rows = marked.select("number", F.inline(zipped)).select(*_ROW[:-1], F.lit(False).alias("done"))
    total = marked.agg(F.sum(F.size("at"))).first()[0] or 0
    shared = written(_several(rows.select("bucket"), ["bucket"]).where("n > 1"), "shared")
    rows = written(_among(rows, shared, ["bucket"], total), "rows")
    found = []
    runs, going = _decided(rows)
    found.append(runs)
    dropped(rows, shared)
    contexts = written(_contexts(going, marked, length), "contexts")
    cells = written(_cells(contexts, width, size, length), "cells")
    runs, going = _decided(cells)
    found.append(runs)
    dropped(cells)
    key = ["number", "at"]
    texts = contexts.select(*key, F.col("low").alias("c_low"), F.col("high").alias("c_high"), "bytes")
    inside = F.col("low").between(F.col("c_low"), F.col("c_high"))
    cut = F.substring("bytes", F.col("c_high") - F.col("high") + 1, F.col("high") - F.col("low") + length)
    windows = going.join(texts, key).where(inside).select(*key, "bucket", "low", "high", "done", cut.alias("bytes"))
    windows = written(_cells(windows, size, 1, length), "windows")
    # A bucket of one window's range holds equal windows: its whole string.
    keyed = ["bucket", "whole"]
    last = _among(windows.where("not done"), written(_several(windows, keyed).where("n > 1"), "equal"), keyed, windows.count())
    found.append(written(last.select("number", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low")).alias("last")), "runs"))
    dropped(contexts, windows)
    return found


def _cut(joined: DataFrame, length: int) -> DataFrame:
    schema = T.StructType(
        [
            joined.schema["row"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def spans_of(runs: pa.ListScalar, n: int) -> tuple[np.ndarray, np.ndarray]:
        change = np.zeros(n + 1, np.int64)
        if runs.is_valid:
            np.add.at(change, runs.values.field(0).to_numpy(), 1)
            np.add.at(change, runs.values.field(1).to_numpy() + length, -1)
        inside = np.cumsum(change) > 0
        edge = np.diff(np.concatenate(([0], inside[:-1].astype(np.int8), [0])))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo, hi in slices(batch.column(1), CHUNK_BYTES // 4):
                sizes, starts, ends, kept = [], [], [], []
                for n in range(lo, hi):
                    text = unpack(batch.column(1)[n].as_py())
                    start, end = spans_of(batch.column(2)[n], len(text))
                    cuts = zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)
                    kept.append(b"".join(text[a:b] for a, b in cuts))
                    sizes.append(len(text))
                    starts.append(start)
                    ends.append(end)
                bounds = [pa.array(np.concatenate(x)) for x in (starts, ends)]
                offsets = np.cumsum([0, *map(len, starts)])
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(bounds, fields=list(span)))
                found = [pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *found], names=schema.names)

    return in_small_batches(joined.select("row", "packed", "runs")).mapInArrow(run, schema)


def without_repeats(
    df: DataFrame, rows: list[str] | None = None, text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """For every row: the struct ``row`` of the columns ``rows`` (all by
    default), ``n_bytes``, the removed ``spans`` (start, end), which neither
    touch nor overlap, and the ``kept`` bytes.

    Texts are UTF-8 bytes, so a cut may fall inside a character.  Null counts as
    empty; a text shorter than ``length`` stays; equal rows repeat each other
    and lose all their bytes if they are long enough; an empty table gives an
    empty result.
    """
    if not 1 <= gram <= length:
        raise ValueError(f"a q-gram has 1 to {length} bytes, got {gram}")
    spark = df.sparkSession
    # Numbered once, at the write: later reads see the same numbers.
    marked = _marked(df, text_col, rows or df.columns, length, gram)
    marked = written(marked.withColumn("number", F.monotonically_increasing_id()), "marked")
    found = _repeats(marked, length, gram)
    runs = found[0].union(found[1]).union(found[2])
    runs = runs.groupBy(F.col("number").alias("_number")).agg(F.collect_list(F.struct("start", "last")).alias("runs"))
    joined = marked.select("row", "packed", "number").join(runs, F.col("number") == F.col("_number"), "left")
    result = written(_cut(joined, length), "kept")
    dropped(marked, *found)
    # Shuffle files go when the driver's garbage is collected.
    spark.sparkContext._jvm.System.gc()
    return result


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a digest of what :func:`without_repeats` leaves of each text."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda sum_, s: sum_ + s["end"] - s["start"])
    return without_repeats(df, [id_col], text_col).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
