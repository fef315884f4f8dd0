"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target texts (labelled good)
and one of all raw texts, give each document the log ratio of its likelihoods
as weight.  Gumbel noise, scaled by a temperature, on the weights and the k
largest sums are a sample of k documents without replacement, in proportion to
the ratio of likelihoods to the power of one over the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.splits import labelled_sample, sampled_texts
from veilframe.llm.text import LOWER, WORD_OR_SIGN, in_small_batches, map_named, mix, pairs, raw, slices, tokens
from veilframe.shared import written


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled target texts learned from; the raw
    model is learned from all documents.  ``k`` is the number of documents to
    sample; by default as many as lie above the weight that best parts the
    good from the bad rows of the labelled sample, each weighed by a model of
    the other half of it.  ``temperature`` scales the noise against the weights."""

    sample_rows: int = 20_000
    buckets: int = 1 << 16
    prior: float = 30.0
    temperature: float = 0.25
    k: int | None = None
    seed: int = 42


_AGAIN = np.uint64(0x243F6A8885A308D3)  # stands for "the token before, again"


def ngrams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each token, and of each pair of neighbours.

    Tokens are runs of letters and digits or runs of signs, lower-cased A-Z; a
    token that repeats the one before is replaced by one common mark.
    """
    found = tokens(*raw(texts), WORD_OR_SIGN, LOWER)
    h, at = found.hash.copy(), found.text
    same = at[1:] == at[:-1]
    h[1:][same & (found.hash[1:] == found.hash[:-1])] = _AGAIN
    n = np.uint64(buckets)
    return at, (mix(h) % n).astype(np.int64), at[1:][same], (pairs(h[:-1][same], h[1:][same], 17) % n).astype(np.int64)


def count(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all n-grams of the column ``text``, shape (2, buckets): one
    bounded array per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * buckets, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                _, one, _, two = ngrams(batch.column(0).slice(lo, hi - lo), buckets)
                total[:buckets] += np.bincount(one, minlength=buckets)
                total[buckets:] += np.bincount(two, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = in_small_batches(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(2 * buckets)
    result[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return result.reshape(2, buckets)


def log_ratio(target: np.ndarray, everything: np.ndarray, prior: float) -> np.ndarray:
    """log P(bucket | target) / P(bucket | raw), for each order of n-grams.

    The target model is the raw one times a ratio of observed to expected
    counts, drawn to one where few are expected, and normalised.
    """
    if not target.any():
        return np.zeros_like(everything)
    raw_p = (everything + 1.0) / (everything.sum(axis=1, keepdims=True) + everything.shape[1])
    expected = target.sum(axis=1, keepdims=True) * raw_p
    ratio = (target + prior) / (expected + prior)
    return np.log(ratio / (raw_p * ratio).sum(axis=1, keepdims=True))


def cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that best parts good rows (from there on) from bad ones: most
    of both on their side, in the middle of the gap; 0 if one kind is missing."""
    if good.all() or not good.any():
        return 0.0
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    below = np.append(0, np.cumsum(~good)) / (~good).sum() - np.append(0, np.cumsum(good)) / good.sum()
    below[1:-1][weights[1:] == weights[:-1]] = -1  # equal weights stay together
    edges = np.concatenate([[weights[0] - 2], weights, [weights[-1] + 2]])
    best = np.flatnonzero(below == below.max())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def half(id_col: Column) -> Column:
    """0 or 1 by a hash of the id."""
    return F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2))


def train(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> list[np.ndarray]:
    """The table of log ratios, and those learned from either half of the
    target texts alone."""
    good = labelled_sample(labels.where("quality = 1"), "quality", s.sample_rows, F.lit(True), id_col)
    texts = sampled_texts(docs, good, id_col, text_col)
    halves = [count(texts.where(half(F.col("id")) == n).select("text"), s.buckets) for n in (0, 1)]
    everything = count(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), s.buckets)
    return [log_ratio(target, everything, s.prior) for target in (halves[0] + halves[1], *halves)]


def with_weight(docs: DataFrame, table: np.ndarray, rows: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (the named columns) and ``log_weight``; an empty text weighs 0."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(texts: pa.Array) -> list:
        ratio = shared.value
        at1, one, at2, two = ngrams(texts, ratio.shape[1])
        weight = np.zeros(len(texts))
        weight += np.bincount(at1, weights=ratio[0][one], minlength=len(texts))
        weight += np.bincount(at2, weights=ratio[1][two], minlength=len(texts))
        return [pa.array(weight)]

    return map_named(docs, text_col, rows, [T.StructField("log_weight", T.DoubleType())], work)


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, bins: int = 1024) -> float | None:
    """The k-th largest of the one column of a written frame.

    Counts per bin narrow the range down to values of one bin, until these are
    equal or few; neither the rows nor their order pass the driver.
    """
    name = values.columns[0]
    x = F.col(f"`{name}`")
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return None
    k = max(1, min(k, n))
    inside = values.where(x.isNotNull())
    while low < high and n > bins:
        width = (high - low) / bins
        at = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if r["n"] >= k:
                break
            k -= r["n"]
        low, high, n = r["a"], r["b"], r["n"]
        inside = inside.where(x.between(low, high))
    if low == high:
        return low
    return sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]


def threshold(weights: DataFrame, held_out: DataFrame | None, s: Settings) -> float | None:
    """From which perturbed weight on documents are sampled; ``weights`` is
    written and has ``log_weight`` and ``perturbed``, ``held_out`` the weight
    and label of labelled rows by models that did not see them."""
    k = s.k
    if k is None:
        seen = held_out.toArrow()
        least = cut(seen["log_weight"].to_numpy(), seen["label"].to_numpy() == 1)
        k = weights.where(F.col("log_weight") >= least).count()
    return kth_largest(weights.select("perturbed"), k) if k else None


def held_out_weights(docs: DataFrame, labels: DataFrame, halves: list[np.ndarray], id_col: str, text_col: str, s: Settings) -> DataFrame:
    """``(id, label, log_weight)`` of the labelled sample, each half weighed by
    the table learned from the other."""
    sample = labelled_sample(labels, "quality", s.sample_rows, F.lit(True), id_col)
    texts = sampled_texts(docs, sample, id_col, text_col)
    one, two = (with_weight(texts.where(half(F.col("id")) == 1 - n), halves[n], ["id", "label"]) for n in (0, 1))
    return one.union(two).select("row.id", "row.label", "log_weight")


def _sampled(docs: DataFrame, labels: DataFrame, rows: list[str], id_col: str, text_col: str, s: Settings) -> DataFrame:
    table, *halves = train(docs, labels, s, id_col, text_col)
    noise = gumbel(F.col(f"row.`{id_col}`"), s.seed) * s.temperature

    def weighted(columns: list[str]) -> DataFrame:
        return with_weight(docs, table, columns, text_col).withColumn("perturbed", F.col("log_weight") + noise)

    narrow = written(weighted([id_col]).select(F.col(f"row.`{id_col}`").alias("id"), "log_weight", "perturbed"), "weights")
    least = threshold(narrow, held_out_weights(docs, labels, halves, id_col, text_col, s) if s.k is None else None, s)
    if rows == [id_col]:
        whole = narrow.select(F.struct(F.col("id").alias(id_col)).alias("row"), "log_weight", "perturbed")
    else:
        # Weighed again rather than written with the texts.
        whole = weighted(rows)
    return whole.where(F.lit(False) if least is None else F.col("perturbed") >= least)


def select_ids(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """``(doc_id, log_weight)`` of the sampled documents.

    Null and empty texts weigh 0, neither for nor against the target.  Equal
    texts weigh the same, with noise by id; rows that tie for the last place are all
    sampled.  Labels of null ids are not used; without usable labels all
    weights are 0 and all documents are sampled.
    """
    found = _sampled(docs, labels, [id_col], id_col, text_col, settings or Settings())
    return found.select(F.col(f"row.`{id_col}`").alias(id_col), "log_weight")


def select_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """The rows of the sampled documents, with the columns of ``docs``."""
    return _sampled(docs, labels, docs.columns, id_col, text_col, settings or Settings()).select("row.*")
