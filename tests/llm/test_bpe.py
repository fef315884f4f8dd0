"""Byte-level BPE against the tokenizers library and its round trip."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veilframe.llm import bpe
from veilframe.llm.queries import op10_bpe, table, tokenizer

PIECES = "a aaa é ß 's 'S I'll 日本 😀 1 12.3 \x00 _ !! <|endoftext|> <|endof".split() + [" ", "  ", "\n", "\t", " ", " ", "\x85", "\x1c", "\r\n", "　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(tokenizer()))


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_library(library, codec):
    draw = random.Random(3)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 14))) for _ in range(20_000)]
    texts += ["a" * 30_000, " " * 3_000, "é" * 3_000, "ab" * 10_000, ""]
    assert codec.encode_all(pa.array(texts)).to_pylist() == ids_of(library, texts)


def test_every_code_point_equals_the_library(library, codec):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["﻿", "\U0001f600", "\U000e0001"]
    texts = [f"a {p} {p}x  {p}1 {p}{p}  b" for p in points]
    assert codec.encode_all(pa.array(texts)).to_pylist() == ids_of(library, texts)


def test_forced_cuts_are_pairs_in_no_token(codec):
    inside = {(t[i], t[i + 1]) for t in codec.pieces.to_pylist() for i in range(len(t) - 1) if t != b"<|endoftext|>"}
    assert {(a, b) for a in range(256) for b in range(256) if codec.inside[a, b]} == inside


def test_decoding_broken_bytes(library, codec):
    ids = [library.encode("日本", add_special_tokens=False).ids[:1], [], None, [50256, 5]]
    assert codec.decode_all(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [
        library.decode(i or [], skip_special_tokens=False) for i in ids
    ]


def test_awkward_rows_round_trip(awkward, no_docs, library):
    rows = bpe.digests(awkward, tokenizer()).collect()
    want = []
    for r in awkward.collect():
        ids = ids_of(library, [r.text or ""])[0]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(r.text or "")))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.digests(no_docs, tokenizer()).collect() == []


def test_encode_keeps_columns_and_decodes(awkward):
    rows = bpe.decode(bpe.encode(awkward, tokenizer()), tokenizer()).collect()
    assert all(r.decoded == (r.row.text or "") for r in rows)
    assert rows[0].row.asDict().keys() == set(awkward.columns)


def test_query_equals_the_library(spark, library):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r.ids_sha256 for r in op10_bpe(spark, path).collect()}
    docs = table(spark, path, "documents").collect()
    for r, ids in zip(docs, ids_of(library, [d.text or "" for d in docs]), strict=True):
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
