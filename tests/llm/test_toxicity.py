"""Toxicity: FTRL against a plain loop, held-out labels, awkward rows."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import toxicity
from veilframe.llm.queries import op7_toxicity, table


def test_ftrl_equals_a_plain_loop():
    draw = np.random.default_rng(1)
    s = toxicity.Settings(bits=5, l1=0.9, alpha=0.7, epochs=2, l2=0.3)
    rows = [np.unique(draw.integers(0, 32, 6)) for _ in range(80)]
    labels = np.array([float(4 in r or 9 in r) for r in rows])
    z, n, l1 = [0.0] * 33, [0.0] * 33, s.l1

    def weight(i):
        bound = 0.0 if i == 32 else l1
        if abs(z[i]) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for row, y in zip(rows, labels, strict=True):
            at = [*row.tolist(), 32]
            w = [weight(i) for i in at]
            g = (1 / (1 + math.exp(-sum(w))) - y) * (s.positive_weight if y else 1)
            for i, wi in zip(at, w, strict=True):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * wi
                n[i] += g * g
    found = toxicity.ftrl(rows, labels, s)
    assert np.allclose(found, [weight(i) for i in range(33)])
    assert found[4] > 0 < found[9]


def test_features_are_words_pairs_and_skips():
    at, places = toxicity.features(pa.array(["a b c", "A b", "", "a a"]), 20)
    assert np.bincount(at, minlength=4).tolist() == [6, 3, 0, 2]
    of = lambda n: set(places[at == n])
    assert of(1) <= of(0)


def test_awkward_rows(awkward, no_docs, labels):
    rows = toxicity.score(awkward, labels).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in awkward.collect())
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    none = [r.score for r in rows if r.doc_id in (2, 3, 4)]
    assert len(none) == 4 and len(set(none)) == 1
    assert toxicity.score(no_docs, labels).collect() == []
    assert {r.score for r in toxicity.score(awkward, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_read(spark, awkward, labels):
    held = [r.doc_id for r in awkward.collect() if r.doc_id and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    flipped = spark.createDataFrame([(i, 1, 1) for i in held], "doc_id bigint, quality int, toxic int")
    score = lambda x: sorted(repr((r.doc_id, r.score)) for r in toxicity.score(awkward, x).collect())
    assert held and score(labels) == score(labels.union(flipped))


def test_held_out_rows_are_told_apart(spark):
    path = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, path, "labels").collect()}
    rows = [(r.predicted, truth[r.doc_id]) for r in op7_toxicity(spark, path).collect() if r.held_out and r.doc_id in truth]
    caught = sum(p and t for p, t in rows)
    assert caught >= 0.7 * sum(t for _, t in rows)
    assert caught >= 0.95 * sum(p for p, _ in rows)
    assert pytest.approx(len(rows) / len(truth), abs=0.1) == 1 / 3


def test_features_by_brute_force():
    """Coordinates of words, pairs and skip-pairs, each made on its own."""
    texts = ["One two-three one two", "x", "", "ab cd ef gh ab cd"]
    at, places = toxicity.features(pa.array(texts), 18)
    for n, text in enumerate(texts):
        words = re.findall("[a-z0-9_]+", text.lower())
        alone = {w: toxicity.features(pa.array([w]), 18)[1][0] for w in words}
        near = {p: set(toxicity.features(pa.array([" ".join(p)]), 18)[1]) - {alone[w] for w in p} for p in zip(words, words[1:])}
        skip = {
            (a, c): set(toxicity.features(pa.array([f"{a} {b} {c}"]), 18)[1]) - {alone[w] for w in (a, b, c)} - near[a, b] - near[b, c]
            for a, b, c in zip(words, words[1:], words[2:])
        }
        want = set(alone.values()) | set().union(*near.values(), *skip.values())
        assert set(places[at == n]) == want


def test_the_sample_is_bounded_by_its_features(spark, make_docs):
    docs = make_docs([(n, f"{'bad' if n % 2 else 'good'} word{n} " * 3) for n in range(60)])
    labels = spark.createDataFrame([(n, 1, n % 2) for n in range(60)], "doc_id bigint, quality int, toxic int")
    few = toxicity.Settings(sample_features=40, l1=0.1)
    places, _ = toxicity.train(docs, labels, few, "doc_id", "text")
    assert 0 < len(places) <= 41
    all_places, _ = toxicity.train(docs, labels, toxicity.Settings(l1=0.1), "doc_id", "text")
    assert len(all_places) > 2 * len(places)
