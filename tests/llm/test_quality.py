"""Importance resampling: weights, selection of the k largest, labelled rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import quality
from veilframe.llm.queries import op1_quality, table


@pytest.mark.parametrize("k", [1, 2, 17, 3_000, 6_000, 9_999])
def test_kth_largest(spark, k):
    draw = random.Random(k)
    values = [draw.choice([0.0, 1.5, draw.gauss(0, 1), draw.gauss(0, 1e6)]) for _ in range(6_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert quality.kth_largest(df, k, bins=64) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert quality.kth_largest(df.where("x is null"), k) is None


def test_weights_are_the_ratio_of_the_models():
    target, everything = np.array([[8.0, 0, 2], [3, 0, 3]]), np.array([[10.0, 10, 10], [6, 6, 6]])
    ratio = quality.log_ratio(target, everything, 1.0)
    raw = (everything + 1) / (everything.sum(axis=1, keepdims=True) + 3)
    model = np.exp(ratio) * raw
    assert np.allclose(model.sum(axis=1), 1)
    assert (np.argsort(-model, axis=1)[:, 0] == [0, 0]).all()
    assert np.allclose(quality.log_ratio(target * 0, everything, 1.0), 0)


def test_cut():
    w, good = np.array([5.0, 1, 9, -3, -7]), np.array([True, True, True, False, False])
    assert quality.cut(w, good) == -1
    assert quality.cut(w, np.ones(5, bool)) == quality.cut(w, ~good & False) == 0
    assert quality.cut(np.array([2.0, 2, 2]), np.array([True, False, True])) in (1, 3)


def test_repeats_share_one_feature():
    one = quality.ngrams(pa.array(["ab ab ab", "cd cd cd", ""]), 1 << 16)
    assert one[0].tolist() == [0, 0, 0, 1, 1, 1]
    assert one[1][1] == one[1][2] == one[1][4] == one[1][5]
    assert one[3][1] == one[3][3]


def test_gumbel_is_gumbel(spark):
    rows = spark.range(20_000).select(quality.gumbel(F.col("id"), 1).alias("g")).toPandas()["g"]
    assert abs(rows.mean() - 0.5772) < 0.05
    assert abs(rows.std() - 1.2825) < 0.05


def test_awkward_rows(awkward, no_docs, labels):
    for found in (quality.select_ids(awkward, labels), quality.select_rows(awkward, labels)):
        assert 0 < found.count() <= awkward.count()
    assert quality.select_rows(awkward, labels).columns == awkward.columns
    ids = lambda df: sorted((repr(r.doc_id) for r in df.collect()))
    assert ids(quality.select_ids(awkward, labels)) == ids(quality.select_rows(awkward, labels))
    assert quality.select_ids(no_docs, labels).collect() == []
    assert quality.select_rows(no_docs, labels).collect() == []
    # Nothing to learn from: all weigh the same.
    assert quality.select_ids(awkward, labels.limit(0)).count() == awkward.count()


def test_k(awkward, labels):
    for k in (0, 1, 4):
        assert quality.select_ids(awkward.where("doc_id is not null"), labels, settings=quality.Settings(k=k)).count() in (k, k + 1)


def test_labelled_rows_are_parted(spark):
    path = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in op1_quality(spark, path).collect()}
    rows = table(spark, path, "labels").where("quality is not null").collect()
    share = lambda q: np.mean([r.doc_id in kept for r in rows if r.quality == q])
    assert share(1) > 0.95
    assert share(0) < 0.05


def grams(text):
    """Tokens and pairs of a text, a repeated token as a mark."""
    words = re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+|[^\sA-Za-z0-9_\u0080-\U0010ffff]+", text or "")
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    marked = [None if n and w == words[n - 1] else w for n, w in enumerate(words)]
    return marked, list(zip(marked, marked[1:]))


def test_counts_and_weights_by_brute_force(spark, make_docs, monkeypatch):
    """Every n-gram has a bucket of its own here; counts, ratios and sums of
    both models are made again, text by text."""
    draw = random.Random(2)
    vocabulary = ["The", "the", "cat", "42", "!!", "é", "a_b", "-"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 25))) for _ in range(40)] + ["", None]
    docs = make_docs(list(enumerate(texts)))
    good = {n for n in range(40) if n % 3 == 0}
    labels = spark.createDataFrame([(n, int(n in good), 0) for n in range(40)], "doc_id bigint, quality int, toxic int")
    s = quality.Settings(buckets=1 << 20, prior=2.0)
    table, *halves = quality.train(docs, labels, s)
    weights = {r.row.doc_id: r.log_weight for r in quality.with_weight(docs, table, ["doc_id"]).collect()}
    everything, target = [Counter(), Counter()], [Counter(), Counter()]
    for n, text in enumerate(texts):
        for order, found in enumerate(grams(text)):
            everything[order].update(found)
            if n in good:
                target[order].update(found)
    ratio = []
    for e, t in zip(everything, target, strict=True):
        total, wanted = sum(e.values()) + s.buckets, sum(t.values())
        raw = {g: (n + 1) / total for g, n in e.items()}
        drawn = {g: (t[g] + s.prior) / (wanted * raw[g] + s.prior) for g in e}
        unseen = (s.buckets - len(e)) / total * s.prior / (wanted / total + s.prior)
        norm = sum(raw[g] * drawn[g] for g in e) + unseen
        ratio.append({g: math.log(drawn[g] / norm) for g in e})
    for n, text in enumerate(texts):
        want = sum(ratio[order][g] for order, found in enumerate(grams(text)) for g in found)
        assert weights[n] == pytest.approx(want, abs=1e-6), text
    # Each half of the labelled rows is weighed by the other half's model.
    held = {r.id: r.log_weight for r in quality.held_out_weights(docs, labels, halves, "doc_id", "text", s).collect()}
    of = {r.id: r.half for r in spark.range(40).select("id", quality.half(F.col("id")).alias("half")).collect()}
    assert held.keys() == set(range(40)) and {0, 1} == set(of.values())
    for n in (0, 1):
        own = {r.row.doc_id: r.log_weight for r in quality.with_weight(docs, halves[1 - n], ["doc_id"]).collect()}
        assert all(held[i] == pytest.approx(own[i]) for i in held if of[i] == n)


def test_held_out_good_rows_stay(spark):
    """Labels of a third of the rows are not shown; the good ones are kept."""
    path = "/root/testdata/sf0.1"
    labels = table(spark, path, "labels").where("quality is not null")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    kept = {r.doc_id for r in quality.select_ids(table(spark, path, "documents"), labels.where(~hidden)).collect()}
    rows = labels.where(hidden).collect()
    share = lambda q: np.mean([r.doc_id in kept for r in rows if r.quality == q])
    assert share(1) > 0.97
    assert share(0) < 0.1
