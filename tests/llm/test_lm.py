"""The language model: counts against brute force, probabilities that sum to one."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import lm
from veilframe.llm.queries import op3_lm, table
from veilframe.llm.text import LOWER, WORDS, raw, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SMALL = lm.Settings(unit_words=8, classes=4, head_words=20, steps=40)


def brute(rows):
    """Per row: held out, tokens, known tokens, all training tokens, base score."""
    words = [WORD.findall((t or "").translate(FOLD)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for h, ws in zip(held, words, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for (i, _), h, ws in zip(rows, held, words, strict=True)
    ]


def compare(df, settings):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in lm.score(df, settings=settings).collect()), key=lambda r: repr((r[:4], round(r[5], 4))))
    want = sorted(brute(rows), key=lambda r: repr((r[:4], round(r[5], 4))))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-6)
    assert all(math.isfinite(g[6]) and g[6] <= 0 for g in got)


def test_counts_and_base_scores(awkward, no_docs):
    compare(awkward, SMALL)  # most words are beyond the head
    compare(awkward, lm.Settings(steps=5))
    assert lm.score(no_docs, settings=SMALL).collect() == []


def test_without_training_rows(make_docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.score(make_docs([(held, "some words")]), settings=SMALL).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row.score)


def test_better_than_counts_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    compare(table(spark, path, "documents"), lm.Settings())
    rows = [r for r in op3_lm(spark, path).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.75 * len(rows)


def test_probabilities_sum_to_one(make_docs):
    texts = ["the cat sat on a mat", "the dog sat on the cat", "one more text of other words", "cat cat cat dog"]
    df = make_docs([(None, t) for t in texts])
    train = df.select("text")
    counts = lm.count_words(train, SMALL).cache()
    model = lm.train_model(counts, train, len(texts), SMALL)
    logs = lm.log_probabilities(model)
    assert np.allclose((10**logs).sum(axis=1), 1)
    # After "cat": all known words, an unseen word of each class, and the end.
    vocabulary = sorted({w for t in texts for w in t.split()})
    assert model.distinct == len(vocabulary) + 1
    data, offsets = raw(pa.array(vocabulary))
    own = lm.classes_of(data, tokens(data, offsets, WORDS, LOWER), SMALL.classes)
    start = lm.scores_of(pa.array(["cat"]), model, logs, SMALL.classes)[3][0].as_py()
    end = logs[_unit(model, "cat", own, vocabulary), -1]
    prefix = start - end
    total = 10**end
    for w in vocabulary:
        total += 10 ** (lm.scores_of(pa.array([f"cat {w}"]), model, logs, SMALL.classes)[3][0].as_py() - prefix - logs[_unit(model, w, own, vocabulary), -1])
    context = _unit(model, "cat", own, vocabulary)
    total += sum(10 ** logs[context, model.n_words + c] / model.class_sums[c] for c in range(SMALL.classes))
    assert total == pytest.approx(1, abs=1e-9)


def _unit(model, word, own, vocabulary):
    data, offsets = raw(pa.array([word]))
    at = lm._placed(model.hashes, tokens(data, offsets, WORDS, LOWER).hash)[0]
    unit = model.units[at] if at >= 0 else -1
    return unit if unit >= 0 else model.n_words + own[vocabulary.index(word)]


def test_noise_contrastive_estimation_finds_conditionals():
    counts = np.array([[90.0, 5, 5], [5, 90, 5], [30, 30, 40]]) * 100
    r, q, b = lm.nce(counts, lm.Settings(size=8, steps=1500))
    model = lm.Model(*[None] * 8, r, q, b)
    found = 10 ** lm.log_probabilities(model)
    assert np.abs(found - counts / counts.sum(axis=1, keepdims=True)).max() < 0.05


def test_unit_sequence():
    contexts, outputs = lm.unit_sequence(np.array([4, 5, 6]), np.array([0, 0, 2]), 3, 9, 8)
    assert outputs.tolist() == [4, 5, 8, 8, 6, 8]
    assert contexts.tolist() == [9, 4, 5, 9, 9, 6]
