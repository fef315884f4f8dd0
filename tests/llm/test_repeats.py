"""Repeated byte strings, against a plain search for every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import repeats
from veilframe.llm.queries import op12_repeats
from veilframe.llm.text import raw


def expected(texts, length):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    found = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(1 for n, g in enumerate(gone) if g and (n == 0 or not gone[n - 1]))
        found.append((len(b), sum(gone), n_spans, kept))
    return found


def results(df, **options):
    spans = F.transform("spans", lambda s: s["end"] - s["start"])
    rows = repeats.without_repeats(df, ["n"], **options).select("row.n", "n_bytes", spans.alias("s"), "kept").collect()
    return [(r.n_bytes, sum(r.s), len(r.s), bytes(r.kept)) for r in sorted(rows, key=lambda r: r.n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3, "n")


@pytest.mark.parametrize("length, gram, letters", [(20, 5, "ab"), (21, 4, "abcdefgh"), (12, 12, "ab "), (30, 1, "abc"), (24, 9, "aé日")])
def test_random_texts(spark, length, gram, letters):
    rng = random.Random(length)
    parts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(40)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) + "".join(rng.choices(letters, k=5)) for _ in range(80)]
    texts += ["a" * 200, "a" * 19, "ab" * 70, "", None]
    assert results(frame(spark, texts), length=length, gram=gram) == expected(texts, length)


def test_windows_share_a_passage_only_in_part(spark):
    """Passages one byte below and at the length, at text ends and overlapping."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    long, short, other = noise(200), noise(199), noise(450)
    texts = [noise(300) + long + noise(300), long + noise(10), noise(10) + long, noise(50) + short + noise(50), short + noise(70)]
    texts += [other, noise(70) + other[:260], noise(60) + other[240:], other[100:320] + noise(9), noise(1000)]
    found = results(frame(spark, texts))
    assert found == expected(texts, 200)
    assert [f[1] for f in found[:5]] == [200, 200, 200, 0, 0]


def test_many_distinct_surroundings_of_one_passage(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    common = noise(90)
    texts = [noise(150) + common + noise(150) for _ in range(400)] + [noise(20) + common * 3 + noise(20) for _ in range(20)]
    assert results(frame(spark, texts)) == expected(texts, 200)


def test_text_in_pieces(monkeypatch):
    """A text longer than a piece picks the same anchors and windows."""
    rng = np.random.default_rng(1)
    data, offsets = raw(pa.array(["".join(rng.choice(list("abcd"), n)) for n in (700, 0, 35, 2500, 41)]))
    whole = repeats.anchors_of(data, offsets, 40, 9)
    monkeypatch.setattr(repeats, "PIECE", 256)
    pieces = repeats.anchors_of(data, offsets, 40, 9)
    spread = lambda found: sorted((a, p) for a, lo, hi in zip(*found, strict=True) for p in range(lo, hi + 1))
    assert spread(whole) == spread(pieces)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, expected(list(docs.values()), 200), strict=True))
    rows = op12_repeats(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n_bytes, n_removed, n_spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n_bytes, n_removed, n_spans, hashlib.sha256(kept).hexdigest())


def test_awkward_rows(awkward, no_docs):
    found = repeats.digests(awkward)
    assert found.count() == awkward.count()
    by_id = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert (by_id[5].n_removed, by_id[5].n_spans) == (50_000, 1)
    assert by_id[6].n_removed == 9 * 20_000 and by_id[3].n_bytes == 0 and by_id[9].n_removed == 0
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert repeats.digests(no_docs).count() == 0
    with pytest.raises(ValueError, match="q-gram"):
        repeats.without_repeats(awkward, length=10, gram=11)
