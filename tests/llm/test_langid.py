"""Language ID: the path against all paths, scripts, held-out rows, spans."""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from veilframe.llm import langid
from veilframe.llm.queries import op9_langid, table
from veilframe.llm.text import raw


def test_best_path_equals_trying_all_paths():
    draw = np.random.default_rng(3)
    counts = np.array([3, 0, 6, 1, 5])
    score = draw.normal(0, 2, (counts.sum(), 3))
    labels = langid.best_path(score, counts, 1.5)
    first = np.cumsum(counts) - counts
    for a, n in zip(first, counts, strict=True):
        def value(path, a=a):
            return sum(score[a + i, l] for i, l in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))
        best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
        assert np.isclose(value(labels[a : a + n]), best)


def test_scripts():
    name = list(langid.SCRIPTS)
    for text, script in (("a", "latin"), ("é", "latin"), ("я", "cyrillic"), ("λ", "greek"), ("語", "han"), ("か", "kana"), ("ع", "arabic"), ("한", "hangul"), ("𠀀", "han"), ("😀", "none"), ("1", "none"), ("“", "none")):
        data = np.frombuffer(text.encode(), np.uint8)
        assert name[langid.scripts_at(data)[0]] == script, text


def test_folding_equals_lower():
    text = "".join(chr(c) for c in range(0x20, 0x100))
    want = "".join(c.lower() if c.isascii() or unicodedata.category(c) == "Lu" else c for c in text)
    assert langid.folded(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == want


LEARN = [
    ("the cat and the dog were there with them", "en"),
    ("der hund und die katze sind nicht hier", "de"),
    ("кошка и собака были здесь", "ru"),
]


def learned(make_docs):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    rows = [(i, LEARN[n % 3][0]) for n, i in enumerate(ids)]
    return make_docs(rows, lang=[LEARN[n % 3][1] for n in range(60)])


def test_mixed_text_gets_spans(make_docs):
    model = langid.train(learned(make_docs), "doc_id", "text", "lang")
    assert model.languages == ["de", "en", "ru"]
    text = "é! the dog were there with them; собака была здесь 12 der hund und die katze"
    _, share, spans = langid.identify(pa.array([text]), model, 4.0)
    found = [(text[s["start"] : s["end"]], s["lang"]) for s in spans.to_pylist()[0]]
    assert [lang for _, lang in found] == ["en", "ru", "de"]
    assert found[1][0] == "собака была здесь"
    assert 0.3 < share[0].as_py() < 0.7


def test_awkward_rows(awkward, no_docs, make_docs):
    rows = langid.predict(awkward).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in awkward.collect())
    for r in rows:
        assert r.lang_pred == ("und" if r.doc_id in (2, 3, 4, 8) or (r.doc_id is None and r.score == 0) else "en")
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert langid.predict(no_docs).collect() == []
    unlabelled = make_docs([(1, "some text")], lang=[None])
    assert langid.predict(unlabelled).first().lang_pred == "und"


def test_in_one_language(awkward, no_docs):
    kept = langid.in_one_language(awkward)
    assert kept.columns == awkward.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, None, 5, 6, 7, 7, 9]))
    assert langid.in_one_language(no_docs).collect() == []


def test_without_languages_nothing_is_lost(make_docs):
    docs = make_docs([(1, "some text"), (2, "ещё текст"), (3, None), (4, "12 !"), (None, "a")], lang=[None] * 5)
    kept = langid.in_one_language(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_held_out_rows_are_told_apart(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, path, "documents").collect()}
    rows = [r for r in op9_langid(spark, path).collect() if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.98


def test_the_trigram_table_by_brute_force(spark, make_docs):
    """Shares of hashed byte trigrams, counted word by word."""
    texts = ["Der Hund, der bellt", "the dog that barks", "le chien aboie là-bas", "das HAUS", "12 the 34"]
    langs = ["de", "en", "fr", "de", "en"]
    rows = [(None, t) for t in texts]
    model = langid.train(make_docs(rows, lang=langs), "doc_id", "text", "lang")
    assert model.languages == ["de", "en", "fr"]
    for n, lang in enumerate(model.languages):
        counts = np.full(langid.BUCKETS, 0.1)
        for text, of in zip(texts, langs, strict=True):
            for word in re.findall(r"[^\W_]+", text) if of == lang else ():
                if not any(c.isalpha() for c in word):
                    continue
                data, offsets = raw(pa.array([word]))
                low = [0, *langid.folded(data).tolist(), 0]
                for a, b, c in zip(low, low[1:], low[2:]):
                    counts[((a | b << 8 | c << 16) * 2654435769 % 2**32) >> 16] += 1
        assert np.allclose(model.score[:, n], np.log(counts / counts.sum()), atol=1e-5)


def test_stray_languages_are_not_learned(spark, make_docs):
    rows = [(None, f"word{n} and more of it") for n in range(40)]
    langs = ["en"] * 12 + ["de"] * 8 + [f"tag{n}" for n in range(20)]
    model = langid.train(make_docs(rows, lang=langs), "doc_id", "text", "lang", languages=2)
    assert model.languages == ["de", "en"]
