"""Quality rules: counts against brute force, EM, and what is kept."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from veilframe.llm import rules
from veilframe.llm.queries import op8_rules, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def check(df):
    rows = rules.judge(df).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    want = [(r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not any(r.kept and (r.base_failed or r.quality < rules.KEEP_FROM) for r in rows)
    return rows


def test_awkward_rows(awkward, no_docs):
    rows = check(awkward)
    assert not any(r.kept for r in rows if not r.n_words)
    assert rules.judge(no_docs).collect() == []


def test_random_texts(make_docs):
    draw = random.Random(4)
    parts = ["a", "b", "é", "日本", " ", "  ", "\n", "\n\n", "\t", "#", "|", "A b c", "\r", "!", " "]
    check(make_docs([(n, "".join(draw.choices(parts, k=draw.randint(0, 60)))) for n in range(300)]))


def test_a_whole_table(spark):
    path = "/root/testdata/sf0.01"
    check(table(spark, path, "documents"))
    kept = {r.doc_id: r for r in op8_rules(spark, path).collect()}
    labels = [r for r in table(spark, path, "labels").collect() if r.quality is not None]
    good = [kept[r.doc_id] for r in labels if r.quality == 1 and not kept[r.doc_id].base_failed]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([kept[r.doc_id].kept for r in labels if r.quality == 0]) < 0.05


def test_em_finds_the_accuracies():
    draw = np.random.default_rng(2)
    good = draw.random(20_000) < 0.7
    rates = np.array([0.95, 0.85, 0.75, 0.6, 0.9, 0.8])
    right = draw.random((20_000, 6)) < rates
    votes = np.where(draw.random((20_000, 6)) < 0.2, 0, np.where(right == good[:, None], 1, 2))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, given = rules.estimate(patterns, counts.astype(float), rounds=300)
    assert abs(share - 0.7) < 0.03
    accuracy = given[1, :, 1] / (given[1, :, 1] + given[1, :, 2])
    assert np.abs(accuracy - rates).max() < 0.05
    p = rules.posterior(votes, share, given)
    assert np.mean((p > 0.5) == good) > 0.93


def test_stats_do_not_depend_on_neighbours():
    texts = ["a b c a b c", "a b c", None, "x\nx\nx", ""]
    together = rules.stats_of(pa.array(texts))
    for n, t in enumerate(texts):
        alone = rules.stats_of(pa.array([t], pa.string()))
        assert all(together[k][n] == alone[k][0] for k in alone)
