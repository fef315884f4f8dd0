"""A log-bilinear language model, trained by noise-contrastive estimation.

The logit of a word after a context is a bilinear form of their vectors plus a
bias.  Outputs are the most frequent words, the end of a text, and classes of
the other words by their last two bytes; within a class a word has its add-one
share of the class, an unseen word the share of a count of zero.  So all known
words, and the unseen ones of each class, share a probability of one.

Contexts are the units before a word, so the corpus enters training through
the counts of neighbouring units and of words.  Both are taken over all
training texts by Spark; the unit counts have a fixed bound, and NCE on them
uses the exact expectation over the noise instead of samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.splits import held_out
from veilframe.llm.text import LOWER, WORDS, Tokens, in_small_batches, map_texts, mix, raw, slices, tokens
from veilframe.shared import written


@dataclass(frozen=True)
class Settings:
    """``head_words`` bounds the words whose counts are sent to every task; the
    counts of the others are joined."""

    unit_words: int = 1024
    classes: int = 128
    head_words: int = 1 << 18
    size: int = 32
    noise: int = 20
    steps: int = 200
    rate: float = 0.05
    seed: int = 7
    held_modulus: int = 7
    held_remainder: int = 2


END = np.uint64(0x1F83D9ABFB41BD6B)  # stands for the end of a text
_FLUSH = 4_000_000


class Model(NamedTuple):
    """What every task gets; all of bounded size.  Words are known by their
    hash, in order; ``unit`` is -1 for words of a class."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    n_words: int
    class_sums: np.ndarray
    total: int
    distinct: int
    end_count: int
    contexts: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray


def classes_of(data: np.ndarray, found: Tokens, n: int) -> np.ndarray:
    """Class of each word by its last two bytes."""
    last = LOWER[data[found.end - 1]].astype(np.uint64)
    before = np.where(found.end - found.start > 1, LOWER[data[found.end - 2]], 0).astype(np.uint64)
    return (mix(last | (before << np.uint64(8))) % np.uint64(n)).astype(np.int64)


def _placed(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word among the sorted hashes, -1 if absent."""
    if not len(hashes):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[at] == words, at, -1)


def count_words(train: DataFrame, s: Settings) -> DataFrame:
    """``(hash, class, n)`` of all words of the column ``text``; a task sums
    millions of words before it sends rows on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                data, offsets = raw(texts.slice(lo, hi - lo))
                found = tokens(data, offsets, WORDS, LOWER)
                held.append((found.hash, classes_of(data, found, s.classes)))
                n_held += len(found.hash)
                if n_held >= _FLUSH:
                    yield summed(held)
                    held, n_held = [], 0
        if held:
            yield summed(held)

    def summed(held: list) -> pa.RecordBatch:
        hashes, classes = (np.concatenate(x) for x in zip(*held, strict=True))
        unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(unique.view(np.int64)), pa.array(classes[first].astype(np.int32)), pa.array(n)], names=["hash", "class", "n"]
        )

    partial = in_small_batches(train).mapInArrow(run, "hash long, class int, n long")
    return partial.groupBy("hash").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


def unit_sequence(units: np.ndarray, text: np.ndarray, n_texts: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and outputs of all positions: the words, then one end each."""
    n = np.bincount(text, minlength=n_texts)
    outputs = np.empty(len(units) + n_texts, np.int64)
    ends = np.cumsum(n + 1) - 1
    is_end = np.zeros(len(outputs), bool)
    is_end[ends] = True
    outputs[~is_end], outputs[is_end] = units, end
    contexts = np.empty_like(outputs)
    contexts[1:] = outputs[:-1]
    contexts[ends - n] = start
    return contexts, outputs


def count_units(train: DataFrame, hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Counts of (context, output) pairs of units, contexts with the start of a
    text instead of its end; one bounded matrix per task, summed by Spark."""
    n_words = len(hashes)
    n_out = n_words + s.classes + 1
    shared = train.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_out * n_out, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                data, offsets = raw(texts.slice(lo, hi - lo))
                found = tokens(data, offsets, WORDS, LOWER)
                at = _placed(shared.value, found.hash)
                units = np.where(at >= 0, at, n_words + classes_of(data, found, s.classes)) if len(at) else at
                contexts, outputs = unit_sequence(units, found.text, hi - lo, n_out - 1, n_out - 1)
                total += np.bincount(contexts * n_out + outputs, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = in_small_batches(train).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_out * n_out)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return counts.reshape(n_out, n_out)


def nce(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors (already through the bilinear matrix), output vectors
    and biases.

    The loss tells each observed pair from ``noise`` words drawn from the unit
    frequencies, by the logit less the log of their rate; its gradient in the
    logits is exact.  Adam steps.
    """
    n = counts.shape[0]
    rng = np.random.default_rng(s.seed)
    total = max(counts.sum(), 1.0)
    data = (counts / total).astype(np.float32)
    marginal = (counts.sum(axis=0) + 1.0) / (total + n)
    row = data.sum(axis=1, keepdims=True)
    rate = (s.noise * marginal).astype(np.float32)
    params = [
        rng.normal(0, 0.1, (n, s.size)).astype(np.float32),
        np.eye(s.size, dtype=np.float32),
        rng.normal(0, 0.1, (n, s.size)).astype(np.float32),
        np.log(marginal).astype(np.float32),
    ]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    expected = row * rate[None, :]
    for step in range(1, s.steps + 1):
        r, c, q, b = params
        context = r @ c
        # sigma(delta): the chance that a pair is data, not noise.
        real = 1.0 / (1.0 + rate[None, :] * np.exp(-np.clip(context @ q.T + b, -30, 30)))
        # d loss / d logit = noise * sigma(delta) - data * (1 - sigma(delta))
        g = (expected + data) * real - data
        back = g @ q
        grads = [back @ c.T, r.T @ back, g.T @ context, g.sum(axis=0)]
        pace = s.rate * min(1.0, 2.0 * (1 - step / (s.steps + 1)))
        for p, d, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return params[0] @ params[1], params[2], params[3]


def log_probabilities(model: Model) -> np.ndarray:
    """log10 P(output | context) of all units: one batched product, normalised
    over the outputs."""
    logits = (model.contexts @ model.outputs.T + model.bias).astype(np.float64)
    logits -= logits.max(axis=1, keepdims=True)
    return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)


def train_model(counts: DataFrame, texts: DataFrame, n_texts: int, s: Settings) -> Model:
    """From the word counts (written) and the training texts."""
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pylist()
    head = counts.orderBy(F.desc("n"), "hash").limit(s.head_words).toArrow()
    hashes, n = head["hash"].to_numpy().view(np.uint64), head["n"].to_numpy()
    classes = head["class"].to_numpy()
    n_units = min(s.unit_words, len(hashes))
    unit_hashes = np.sort(hashes[:n_units])
    sums = np.ones(s.classes)
    for r in by_class:
        sums[r["class"]] += r["n"] + r["v"]
    np.subtract.at(sums, classes[:n_units], n[:n_units] + 1.0)
    order = np.argsort(hashes)
    units = _placed(unit_hashes, hashes)
    r, q, b = nce(count_units(texts, unit_hashes, s), s)
    return Model(
        hashes[order],
        n[order],
        units[order],
        n_units,
        sums,
        sum(x["n"] for x in by_class) + n_texts,
        sum(x["v"] for x in by_class) + (n_texts > 0),
        n_texts,
        r,
        q,
        b,
    )


def scores_of(texts: pa.Array, model: Model, logs: np.ndarray, n_classes: int) -> list:
    """Tokens, known ones, both scores as far as counts are at hand, and the
    hashes of the words whose counts are not."""
    data, offsets = raw(texts)
    found = tokens(data, offsets, WORDS, LOWER)
    at = _placed(model.hashes, found.hash)
    own = classes_of(data, found, n_classes) if len(at) else at
    unit = np.where(at >= 0, model.units[at], -1) if len(model.hashes) else np.full(len(at), -1)
    share = np.where(at >= 0, np.log10(model.counts[at] + 1.0), 0.0) if len(model.hashes) else np.zeros(len(at))
    n_out = len(model.bias)
    contexts, outputs = unit_sequence(np.where(unit >= 0, unit, model.n_words + own), found.text, len(texts), n_out - 1, n_out - 1)
    n_words = np.bincount(found.text, minlength=len(texts))
    step = logs[contexts, outputs]
    score = np.add.reduceat(step, np.cumsum(n_words + 1) - n_words - 1) if len(texts) else np.zeros(0)
    inside = np.where(unit >= 0, 0.0, share - np.log10(model.class_sums[own])) if len(at) else share
    score = score + np.bincount(found.text, weights=inside, minlength=len(texts))
    whole = np.log10(model.total + model.distinct + 1.0)
    base = np.bincount(found.text, weights=share, minlength=len(texts)) + np.log10(model.end_count + 1.0) - (n_words + 1) * whole
    known = np.bincount(found.text, weights=at >= 0, minlength=len(texts)) + (model.end_count > 0)
    tail = at < 0 if model.distinct > len(model.hashes) + 1 else np.zeros(len(at), bool)
    bounds = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(np.bincount(found.text[tail], minlength=len(texts)), out=bounds[1:])
    rest = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.hash[tail].view(np.int64)))
    return [pa.array(n_words + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rest]


_FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rest", T.ArrayType(T.LongType())),
]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)`` for every row; scores are log10 probabilities of whole texts.

    A null text is empty and has one token, its end.  Rows with equal ids or
    texts are counted and scored one by one; a null id is not held out.  Without training
    texts the counts are zero: the base gives each token probability one, and
    the untrained model still shares one over its units.
    """
    s = settings or Settings()
    out = held_out(F.col(id_col), s.held_modulus, s.held_remainder)
    train = df.where(~out).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_texts = train.count()
    counts = written(count_words(train, s), "word-counts")
    model = train_model(counts, train, n_texts, s)
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))
    logs: list[np.ndarray] = []

    def work(texts: pa.Array) -> list:
        sent = Model(*shared.value)
        if not logs:
            logs.append(log_probabilities(sent))
        return scores_of(texts, sent, logs[0], s.classes)

    scored = map_texts(df, F.col(text_col), [F.col(id_col).alias("id")], _FIELDS, work)
    # Numbered once, at the write: later reads see the same numbers.
    scored = written(scored.withColumn("number", F.monotonically_increasing_id()), "scored")
    rare = scored.select("number", F.explode("rest").alias("hash"))
    found = rare.join(counts.select("hash", "n"), "hash")
    more = found.groupBy("number").agg(F.sum(F.log10(F.col("n") + 1)).alias("_more"), F.count("*").alias("_known"))
    whole = scored.drop("rest").join(more, "number", "left")
    more_score = F.coalesce("_more", F.lit(0.0))
    return whole.select(
        F.col("row.id").alias(id_col),
        held_out(F.col("row.id"), s.held_modulus, s.held_remainder).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more_score).alias("base_score"),
        (F.col("score") + more_score).alias("score"),
    )
