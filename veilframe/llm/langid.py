"""Language identification of mixed-language text.

The script of a word narrows its candidate languages to those that use the
script; hashed byte trigrams score the word for each of them; and the Viterbi
path over a text's words, with a penalty for switching, labels spans.  The
text's language is the one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.splits import held_out
from veilframe.llm.text import AS_IS, CHUNK_BYTES, LETTERS, in_small_batches, map_named, raw, slices, tokens

BUCKETS = 1 << 16
SWITCH = 8.0
# A language takes 256 KB of every task's model.
LANGUAGES = 200
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# Unicode ranges of scripts (first and last code point); code
# points of no range count as script 1, "other"; 0 is no letter.
SCRIPTS = {
    "none": [(0x0, 0x40), (0x2000, 0x2BFF), (0x3000, 0x303F), (0xFE00, 0xFE0F), (0xE000, 0xF8FF)],
    "other": [],
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}


def _blocks() -> np.ndarray:
    """Script by 64-code-point block of the first plane."""
    table = np.ones(1024, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            table[first >> 6 : (last >> 6) + 1] = number
    table[0] = 0
    return table


_BLOCKS = _blocks()


@dataclass(frozen=True)
class Model:
    """``score[bucket, language]`` in logs, ``allowed[script, language]``."""

    languages: list[str]
    score: np.ndarray
    allowed: np.ndarray


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case."""
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[latin] += 32
    return low


def scripts_at(data: np.ndarray) -> np.ndarray:
    """Script of the code point that starts at each byte; 0 inside one."""
    script = np.zeros(len(data), np.uint8)
    script[((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)] = list(SCRIPTS).index("latin")
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    script[two] = _BLOCKS[data[two] & 0x1F]
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    three = three[three + 1 < len(data)]
    script[three] = _BLOCKS[((data[three] & 0x0F).astype(np.int64) << 6) | (data[three + 1] & 0x3F)]
    four = np.flatnonzero(data >= 0xF0)
    four = four[four + 1 < len(data)]
    script[four] = np.where(data[four + 1] >= 0xA0, list(SCRIPTS).index("han"), 0)
    return script


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words with a letter: text, first byte, byte after, script, and the
    hashed trigrams of their bytes (a zero byte at either end), word by word."""
    found = tokens(data, offsets, LETTERS, AS_IS)
    script = scripts_at(data)
    size = found.end - found.start
    if not len(size):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(found.start - first, size)
    low = folded(data)
    here = low[at].astype(np.uint32)
    before, after = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first], after[first + size - 1] = 0, 0
    grams = ((before | (here << 8) | (after << 16)) * np.uint32(2654435769)) >> np.uint32(16)
    kind = np.maximum.reduceat(script[at], first)
    letter = kind > 0
    return found.text[letter], found.start[letter], found.end[letter], kind[letter], grams[np.repeat(letter, size)], size[letter]


def counted(texts: pa.Array, codes: np.ndarray, n_codes: int) -> np.ndarray:
    """Trigrams, then words by script, per language code: (codes, BUCKETS + scripts)."""
    width = BUCKETS + len(SCRIPTS)
    text, _, _, kind, grams, size = words_of(*raw(texts))
    found = np.bincount(np.repeat(codes[text], size) * width + grams, minlength=n_codes * width)
    found += np.bincount(codes[text] * width + BUCKETS + kind, minlength=n_codes * width)
    return found.reshape(n_codes, width)


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, languages: int = LANGUAGES) -> Model:
    """Counts over all rows that may be learned from, summed per task, then
    over tasks: one row per language and bucket at most.

    The language column is data and may hold any number of stray values, so
    only the ``languages`` values with the most rows are learned.
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    common = known.groupBy(F.col(lang_col).alias("_lang")).count().orderBy(F.desc("count"), "_lang").limit(languages)
    common = [r["_lang"] for r in common.collect()]
    known = known.where(F.col(lang_col).isin(common))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).dictionary_encode()
            codes, own = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            for lo, hi in slices(texts):
                found = counted(texts.slice(lo, hi - lo), codes[lo:hi].astype(np.int64), len(own))
                for lang, row in zip(own, found, strict=True):
                    sums[lang] = sums[lang] + row if lang in sums else row
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"]
            )

    partial = in_small_batches(known.select(text_col, lang_col)).mapInArrow(count, "lang string, bucket long, n long")
    # At most LANGUAGES times buckets, however large the corpus.
    found = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    place = pc.index_in(found["lang"].combine_chunks(), pa.array(names, pa.string())).to_numpy()
    table[place, found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams, kinds = table[:, :BUCKETS] + 0.1, table[:, BUCKETS:]
    score = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    share = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    allowed = share.T >= SCRIPT_SHARE
    # A script that no language uses says nothing about candidates.
    allowed[~allowed.any(axis=1)] = True
    return Model(names, np.ascontiguousarray(score), allowed)


def best_path(score: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; texts lie one after another, ``counts``
    words each.  One step handles the n-th word of all texts that have one."""
    n_labels = score.shape[1]
    labels = np.zeros(len(score), np.int16)
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    came = np.full(score.shape, -1, np.int16)  # label before, if it changed
    ahead = np.zeros((len(size), n_labels))
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        if t:
            total = ahead[:k]
            top = total.argmax(axis=1)
            jump = total[np.arange(k), top] - switch
            moved = jump[:, None] > total
            came[at] = np.where(moved, top[:, None], -1)
            ahead[:k] = np.where(moved, jump[:, None], total) + score[at]
        else:
            ahead[:k] = score[at]
    now = ahead.argmax(axis=1)  # a finished text's row is not touched again
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        here = now[:k]
        labels[at] = here
        back = came[at, here]
        now[:k] = np.where(back >= 0, back, here)
    return labels


def identify(texts: pa.Array, model: Model, switch: float) -> list:
    """Language, score and spans of each text."""
    n_langs = len(model.languages)
    has_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    weight = np.zeros((len(texts), max(n_langs, 1)))
    span_rows: list[np.ndarray] = []
    parts = []
    for lo, hi in slices(texts, max(CHUNK_BYTES * 4 // max(n_langs, 4), 1 << 16)):
        data, offsets = raw(texts.slice(lo, hi - lo))
        text, start, end, kind, grams, size = words_of(data, offsets)
        if len(size) and n_langs:
            total = np.add.reduceat(model.score[grams], np.cumsum(size) - size, axis=0)
            total = np.where(model.allowed[kind], total, np.float32(-1e6))
            # In code points, as a reader of the text counts.
            point = np.cumsum((data & 0xC0) != 0x80)
            base = point[np.minimum(offsets[text], len(data) - 1)]
            parts.append((text + lo, point[start] - base, point[end - 1] + 1 - base, size, total))
    if parts:
        text, start, end, size, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        label = best_path(total, np.bincount(text, minlength=len(texts)), switch)
        weight += np.bincount(text * n_langs + label, weights=size, minlength=weight.size).reshape(weight.shape)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
        begin = np.flatnonzero(new)
        close = np.append(begin[1:], len(text)) - 1
        span_rows = [text[begin], start[begin], end[close], label[begin]]
    languages = pa.array([*model.languages, UNKNOWN], pa.string())
    known = has_letter & (n_langs > 0)
    best = np.where(known, weight.argmax(axis=1), n_langs)
    share = weight.max(axis=1) / np.maximum(weight.sum(axis=1), 1)
    # Letters, but none in a word that could be scored: any language, as likely.
    share = np.where(known & (weight.sum(axis=1) == 0), 1 / max(n_langs, 1), np.where(known, share, 0.0))
    if not span_rows:
        span_rows = [np.zeros(0, np.int64)] * 4
    bounds = np.searchsorted(span_rows[0], np.arange(len(texts) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(span_rows[1].astype(np.int32)), pa.array(span_rows[2].astype(np.int32)), languages.take(pa.array(span_rows[3].astype(np.int32)))],
        names=["start", "end", "lang"],
    )
    return [languages.take(pa.array(best)), pa.array(share), pa.ListArray.from_arrays(pa.array(bounds), spans)]


_SPAN = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("lang", T.StringType())
FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
]


def label(df: DataFrame, model: Model, rows: list[str], text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``row`` (the named columns), ``lang_pred``, ``score`` (the language's
    share of letters in words) and ``spans`` (code points, language).

    ``und`` with score 0 and no spans for null texts, texts without a letter,
    and if nothing was learned.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.score, model.allowed))
    # The path takes as many steps as the longest text has words, so a slice
    # is large; its scores take one number per word and language.
    limit = max((4 << 20) * 4 // max(len(model.languages), 4), 1 << 19)

    def work(texts: pa.Array) -> list:
        return identify(texts, Model(*shared.value), switch)

    return map_named(df, text_col, rows, FIELDS, work, limit)


def predict(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, learned from the
    rows that are not held out and have one of the 200 most frequent languages.

    Rows with equal ids or texts are labelled one by one; a null id is not
    held out; see :func:`label` for texts without a language.
    """
    found = label(df, train(df, id_col, text_col, lang_col), [id_col], text_col)
    return found.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        held_out(F.col(f"row.`{id_col}`"), 3, 1).alias("held_out"),
        "lang_pred",
        "score",
        "spans",
    )


def in_one_language(
    df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows whose text has a language with at least the share ``least`` of
    its letters; null texts and texts without a letter go.  If no language was
    learned, as no row that may be learned from has one, every row with a
    letter stays."""
    model = train(df, id_col, text_col, lang_col)
    if not model.languages:
        return df.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    found = label(df, model, df.columns, text_col)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
