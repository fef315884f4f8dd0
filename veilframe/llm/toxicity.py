"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are the words of a text, pairs of neighbours and pairs with one word
between (skip-grams), hashed to a fixed number of coordinates and counted once
per text.  FTRL-proximal gives each coordinate its own learning rate, and its
L1 term leaves most weights at exactly zero: what is sent to all tasks is
bounded by the number of coordinates, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.splits import held_out, labelled_sample, sampled_texts
from veilframe.llm.text import LETTERS, LOWER, map_texts, mix, pairs, raw, tokens


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows learned from, and
    ``sample_features`` what they hold together (four bytes each, in one task):
    rows are taken whole, in order of their hash, while they fit.  A row of
    label 1, the rarer one, counts ``positive_weight`` times."""

    sample_rows: int = 20_000
    sample_features: int = 1 << 25
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    epochs: int = 5
    positive_weight: float = 3.0
    threshold: float = 0.7


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, coordinate) pairs, ordered by text."""
    found = tokens(*raw(texts), LETTERS, LOWER)
    h, at = found.hash, found.text
    parts = [(at, mix(h))]
    for gap, salt in ((1, 11), (2, 13)):
        same = at[gap:] == at[:-gap]
        parts.append((at[gap:][same], pairs(h[:-gap][same], h[gap:][same], salt)))
    places = np.concatenate([p for _, p in parts]) >> np.uint64(64 - bits)
    numbers = np.concatenate([a for a, _ in parts]).astype(np.uint64)
    both = np.unique((numbers << np.uint64(bits)) | places)
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights per coordinate, the intercept last (it carries no L1 term)."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, s.l1)
    l1[-1] = 0.0

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1[at]) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= l1[at], 0.0, w)

    for _ in range(s.epochs):
        for row, label in zip(rows, labels, strict=True):
            at = np.append(row, size - 1)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * (s.positive_weight if label else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    return weights(np.arange(size))


def train(df: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights.

    Features of the bounded sample are made where its texts lie; FTRL, which
    goes through them in order of their hash, runs in one task.
    """
    sample = labelled_sample(labels, "toxic", settings.sample_rows, ~held_out(F.col(id_col), 3, 1), id_col)
    texts = sampled_texts(df, sample, id_col, text_col)

    def coordinates(slice_: pa.Array) -> list:
        at, places = features(slice_, settings.bits)
        ends = np.searchsorted(at, np.arange(len(slice_) + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(places.astype(np.int32)))]

    kind = T.ArrayType(T.IntegerType())
    made = map_texts(texts, F.col("text"), [F.col("id"), F.col("label")], [T.StructField("places", kind)], coordinates)
    ordered = made.select(
        F.xxhash64("row.id").alias("h"), F.col("row.id").alias("id"), F.col("row.label").cast("int").alias("label"), "places"
    )
    ordered = ordered.repartition(1).sortWithinPartitions("h", "id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks, held = [], [], 0
        for batch in batches:
            lists = batch.column(3)
            values, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            for a, b, mark in zip(ends, ends[1:], batch.column(2).to_pylist(), strict=False):
                if held + b - a <= settings.sample_features:
                    held += b - a
                    rows.append(values[a:b])
                    marks.append(mark)
        found = ftrl(rows, np.array(marks, float), settings)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["place", "weight"])

    table = ordered.mapInArrow(learn, "place long, weight double").toArrow()
    return table["place"].to_numpy(), table["weight"].to_numpy()


def scores_of(texts: pa.Array, dense: np.ndarray, bits: int) -> np.ndarray:
    """Probability of label 1 for each text; ``dense`` ends with the intercept."""
    at, places = features(texts, bits)
    total = np.bincount(at, weights=dense[places], minlength=len(texts)) + dense[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Null and empty texts get the score of no features; rows with equal ids or
    texts are scored one by one; a null id is never learned from, nor is one
    whose checksum holds it out; without labels every score is 0.5.
    """
    settings = settings or Settings()
    places, weights = train(df, labels, settings, id_col, text_col)
    # Sent as they are, few; spread out where they are used, once in a task.
    shared = df.sparkSession.sparkContext.broadcast((places.astype(np.int32), weights))
    spread: list[np.ndarray] = []

    def work(texts: pa.Array) -> list:
        if not spread:
            at, weight = shared.value
            spread.append(np.zeros((1 << settings.bits) + 1))
            spread[0][at] = weight
        return [pa.array(scores_of(texts, spread[0], settings.bits))]

    fields = [T.StructField("score", T.DoubleType())]
    scored = map_texts(df, F.col(text_col), [F.col(id_col).alias("id")], fields, work)
    return scored.select(
        F.col("row.id").alias(id_col),
        held_out(F.col("row.id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
