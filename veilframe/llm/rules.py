"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (2) or abstains (0) on a text.  Expectation
maximisation over the counts of vote patterns of all texts estimates how often
each rule gives each vote on good and on bad texts, and the posterior
probability of being good replaces the demand that all rules pass.  There are
3**rules patterns at most, so what the driver sees has a fixed bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.text import AS_IS, LINES, LOWER, WORDS, map_texts, pairs, per_text, raw, tokens
from veilframe.shared import written

MIN_WORDS = 50
KEEP_FROM = 0.5
# Frequent function words of some languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au dans de des du en est et la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine für im ist mit sich und von zu "
    "asi con del el ella es las los no por se su una y"
).split()

_STATS = (
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_words",
    "n_lines",
    "n_stop",
    "n_upper",
    "n_letters",
    "n_marks",
    "n_distinct",
)


def _hashed(words: list[str]) -> np.ndarray:
    return np.sort(tokens(*raw(pa.array(words)), WORDS, LOWER).hash)


_STOP_HASHES = _hashed(STOP_WORDS)


def _flags(values: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(values)] = 1
    return table


_SYMBOLS = _flags(b"#*$%&|<>")
_MARKS = _flags(b"!?")
_UPPER = _flags(bytes(range(0x41, 0x5B)))
_LETTER = _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
# The first byte of a code point, if it is no blank.
_POINT = (WORDS * ((AS_IS & 0xC0) != 0x80)).astype(np.int8)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it a first occurrence."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    alone = new & np.append(new[1:], True)[: len(keys)]
    twice, first = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order], first[order] = ~alone, new
    return twice, first


def stats_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the rules look at, per text."""
    data, offsets = raw(texts)
    n = len(texts)
    words = tokens(data, offsets, WORDS, AS_IS)
    folded = tokens(data, offsets, WORDS, LOWER)
    own = words.text.astype(np.uint64)
    by_text = lambda at, flags=None: np.bincount(at if flags is None else at[flags], minlength=n)

    h, at = words.hash, words.text
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        window = pairs(pairs(h[:-2], h[1:-1], 3), h[2:], 5)
        begin = np.flatnonzero(at[2:] == at[:-2])
        twice = begin[_repeats(pairs(window[begin], own[begin], 7))[0]]
        for step in range(3):
            covered[twice + step] = True

    lines = tokens(data, offsets, LINES, AS_IS)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(WORDS[data], out=inside[1:])
    full = inside[lines.end] > inside[lines.start]
    line_text = lines.text[full]
    again = ~_repeats(pairs(lines.hash[full], line_text.astype(np.uint64), 9))[1]

    stop = np.minimum(np.searchsorted(_STOP_HASHES, folded.hash), len(_STOP_HASHES) - 1)
    first = _repeats(pairs(folded.hash, folded.text.astype(np.uint64), 15))[1]
    return {
        "word_chars": per_text(_POINT[data], offsets),
        "n_symbols": per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": by_text(line_text, again),
        "n_repeat_words": by_text(at, covered),
        "n_words": by_text(at),
        "n_lines": by_text(line_text),
        "n_stop": by_text(folded.text, _STOP_HASHES[stop] == folded.hash),
        "n_upper": per_text(_UPPER[data], offsets),
        "n_letters": per_text(_LETTER[data], offsets),
        "n_marks": per_text(_MARKS[data], offsets),
        "n_distinct": by_text(folded.text, first),
    }


def votes() -> dict[str, Column]:
    """The rules, over the counts of :func:`stats_of`."""
    c = F.col
    share = lambda part, whole: c(part) / F.greatest(c(whole), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(c("n_words") == 0, 2).when(bad, 2).when(good, 1).otherwise(0)

    def upto(value: Column, good: float, bad: float) -> Column:
        """Good up to the first bound, bad above the second."""
        return rule(value <= good, value > bad)

    length = share("word_chars", "n_words")
    stop = share("n_stop", "n_words")
    return {
        "word_length": rule(length.between(3, 9), (length < 2) | (length > 14)),
        "symbols": upto(share("n_symbols", "n_words"), 0.02, 0.1),
        "repeated_lines": F.when(c("n_lines") < 2, 0).otherwise(upto(share("n_dup_lines", "n_lines"), 0.1, 0.4)),
        "repeated_windows": F.when(c("n_words") < 6, 0).otherwise(upto(share("n_repeat_words", "n_words"), 0.1, 0.35)),
        "function_words": rule(stop >= 0.08, (stop < 0.02) & (c("n_words") >= 10)),
        "capitals": F.when(c("n_letters") < 20, 0).otherwise(upto(share("n_upper", "n_letters"), 0.2, 0.5)),
        "marks": upto(share("n_marks", "n_words"), 0.1, 0.3),
        "few_distinct": F.when(c("n_words") < 20, 0).otherwise(
            upto(1 - share("n_distinct", "n_words"), 0.7, 0.9)
        ),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """The share of good texts, and for bad and good ones (axis 0) how often
    each rule (axis 1) gives each vote (axis 2).

    Starts from rules that are right far more often than not.
    """
    seen = np.stack([(patterns == v) * counts[:, None] for v in range(3)], axis=2).sum(axis=0) + 1.0
    base = seen / seen.sum(axis=1, keepdims=True)
    lean = np.array([[1.0, 0.2, 4.0], [1.0, 1.0, 0.2]])
    given = base[None] * lean[:, None, :]
    given /= given.sum(axis=2, keepdims=True)
    good = 0.8
    for _ in range(rounds):
        p = posterior(patterns, good, given)
        good = float(np.clip((p @ counts + 4) / (counts.sum() + 5), 0.01, 0.99))
        weight = np.stack([(1 - p) * counts, p * counts])
        updated = np.stack([np.stack([w @ (patterns == v) for v in range(3)], axis=1) for w in weight])
        # A few votes' worth of the start, so that a class never runs empty.
        updated = updated + 5 * base[None] * lean[:, None, :]
        given = updated / updated.sum(axis=2, keepdims=True)
    return good, given


def posterior(patterns: np.ndarray, good: float, given: np.ndarray) -> np.ndarray:
    each = np.arange(patterns.shape[1])
    logs = np.log(np.maximum(given, 1e-9))
    likelihood = np.stack([logs[k][each, patterns].sum(axis=1) for k in range(2)])
    odds = np.log(good) - np.log1p(-good) + likelihood[1] - likelihood[0]
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -35, 35)))


def measured(df: DataFrame, rows: list[Column], text: Column) -> DataFrame:
    """``row``, the counts, and the votes as one number ``pattern`` in base 3."""
    fields = [T.StructField(name, T.LongType()) for name in _STATS]

    def work(texts: pa.Array) -> list:
        found = stats_of(texts)
        return [pa.array(found[name].astype(np.int64)) for name in _STATS]

    found = map_texts(df, text, rows, fields, work)
    rules = votes()
    number = F.lit(0)
    for vote in rules.values():
        number = number * 3 + vote
    return found.withColumn("pattern", number.cast("int"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row: id, the counts, ``quality`` (posterior), ``base_failed``, ``kept``.

    Words are counted over whole texts; null and empty texts have none, fail
    the base and are not kept; rows with equal or null ids are judged one by
    one; an empty table gives an empty result.
    """
    found = written(measured(df, [F.col(id_col).alias("id")], F.col(text_col)), "rule-counts")
    seen = found.groupBy("pattern").count().toArrow()
    numbers = seen["pattern"].to_numpy()
    n_rules = len(votes())
    patterns = (numbers[:, None] // 3 ** np.arange(n_rules - 1, -1, -1)) % 3
    if len(numbers):
        good, given = estimate(patterns, seen["count"].to_numpy().astype(float))
        p = posterior(patterns, good, given)
    else:
        p = np.zeros(0)
    # At most 3**rules rows.
    table = df.sparkSession.createDataFrame(
        list(zip(numbers.tolist(), p.tolist(), strict=True)), "_pattern int, quality double"
    )
    repeat = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    judged = found.join(F.broadcast(table), F.col("pattern") == F.col("_pattern"), "left")
    judged = judged.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeat)
    return judged.select(
        F.col("row.id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= keep_from)).alias("kept"),
        "quality",
    )
