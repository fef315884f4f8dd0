"""Texts of an Arrow batch as one byte array, and their tokens as hashes.

Everything here is array arithmetic on a bounded slice of a batch.  A token is
known by a 64-bit hash of its bytes; two different tokens of a corpus share one
with a chance of about V*V / 2**65 for V distinct tokens.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BLANK = (0x20, *range(0x09, 0x0E))

# Token kinds by byte; 0 is between tokens, and a change of kind ends a token.
WORDS = np.ones(256, np.uint8)
WORDS[list(_BLANK)] = 0
LINES = np.ones(256, np.uint8)
LINES[0x0A] = 0
WORD_OR_SIGN = WORDS * 2
WORD_OR_SIGN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
LETTERS = (WORD_OR_SIGN == 1).astype(np.uint8)

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)


class Tokens(NamedTuple):
    """Tokens in order: hash, number of the text, first byte, byte after."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each starts (one more at the end); a
    null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(data: np.ndarray, offsets: np.ndarray, kinds=WORDS, fold=LOWER) -> Tokens:
    """Runs of bytes of one kind, never across texts, hashed after folding."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Tokens(none.astype(np.uint64), none, none, none)
    kind = kinds[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    inside = kind != 0
    start = np.flatnonzero(edge[:-1] & inside)
    end = np.flatnonzero(edge[1:] & inside) + 1
    if not len(start):
        return Tokens(start.astype(np.uint64), start, start, end)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    powers = np.full(size.max(), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = _BYTE_VALUES[fold[data[inside]]] * powers[place]
    hashes = mix(np.add.reduceat(values, first) + size.astype(np.uint64))
    return Tokens(hashes, np.searchsorted(offsets, start, side="right") - 1, start, end)


def pairs(left: np.ndarray, right: np.ndarray, salt: int = 1) -> np.ndarray:
    """Hashes of ordered pairs."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value per byte over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for row, size in enumerate(sizes):
        if row > lo and held + size > limit:
            yield lo, row
            lo, held = row, 0
        held += int(size)
    if lo < len(sizes):
        yield lo, len(sizes)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame, with the session's Arrow batches held to a few megabytes.

    Texts differ in size by orders of magnitude, and each batch is held several
    times over on its way.  A limit that was set by hand below that stays.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?[0-9]+)([kmgtp]?)b?", conf.get(_BATCH_SETTING).strip().lower()).groups()
    held = int(number) << (10 * "bkmgtp".index(unit or "b"))
    if not 0 < held <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def give_back() -> None:
    """Return memory that a finished task has freed to the system: workers are
    kept for later tasks, whose slices differ in size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(
    df: DataFrame,
    text: Column,
    rows: list[Column],
    fields: list[T.StructField],
    work: Callable[[pa.Array], list],
    limit: int = CHUNK_BYTES,
    place: int | None = None,
) -> DataFrame:
    """``rows`` of the frame as struct ``row``, beside what ``work`` returns
    for slices of ``text``: one array per field, one value per text.

    The struct keeps names of the input apart from those of the result.  If the
    text is one of the rows, ``place`` says which, and it is not sent twice.
    """
    narrow = df.select(F.struct(*rows).alias("row"), *([text.cast("string").alias("text")] if place is None else []))
    schema = T.StructType([narrow.schema["row"], *fields])
    names = ["row", *(f.name for f in fields)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(0)
            texts = batch.column(1) if place is None else kept.field(place)
            for lo, hi in slices(texts, limit):
                found = work(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([kept.slice(lo, hi - lo), *found], names=names)
        give_back()

    return in_small_batches(narrow).mapInArrow(run, schema)


def map_named(
    df: DataFrame,
    text_col: str,
    rows: list[str],
    fields: list[T.StructField],
    work: Callable[[pa.Array], list],
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """:func:`map_texts` for columns by name."""
    quoted = {c: F.col(f"`{c}`") for c in {*rows, text_col}}
    is_row = text_col in rows and dict(df.dtypes)[text_col] == "string"
    place = rows.index(text_col) if is_row else None
    return map_texts(df, quoted[text_col], [quoted[c] for c in rows], fields, work, limit, place)
