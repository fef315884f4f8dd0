"""Decontamination: planted leaks, other values, inconsistent values, awkward rows."""

from __future__ import annotations

import random
import re

import pytest

from veilframe.llm import decontaminate
from veilframe.llm.queries import op5_decontaminate, table

ITEM = "The train from Paris to Lyon takes 3 hours and 40 minutes, so how far does Anna go in 3 hours at 90 km/h?"
OTHER = "The train from Berlin to Bonn takes 5 hours and 20 minutes, so how far does Otto go in 5 hours at 75 km/h?"
WRONG = "The train from Berlin to Bonn takes 5 hours and 20 minutes, so how far does Otto go in 8 hours at 75 km/h?"
FILLER = "and this is some other text of the page that nobody asked about"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(10, ITEM, "x"), (11, "Short question here", "x"), (12, None, "x"), (13, "", "x"), (None, "an item without an id but of seven words", "x")]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id string")


def found(docs, benchmark):
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, benchmark).collect()}


def test_leaks(make_docs, benchmark):
    docs = make_docs(
        [
            (1, f"{FILLER}. {ITEM} {FILLER}"),
            (2, f"{FILLER}.\n{OTHER}\n{FILLER}"),
            (3, f"{FILLER}. {WRONG} {FILLER}"),
            (4, FILLER * 50),
            (5, f"some short QUESTION, here {FILLER}"),
            (6, ITEM.upper()),
            (7, f"{ITEM} {OTHER} {ITEM}"),
            (None, ITEM),
            (8, "quote: an item without an id but of seven words!"),
        ]
    )
    got = found(docs, benchmark)
    assert set(got) == {(1, 10), (2, 10), (5, 11), (6, 10), (7, 10), (None, 10), (8, None)}
    assert got[1, 10].share == got[7, 10].share == 1.0
    assert (got[1, 10].reparameterised, got[2, 10].reparameterised) == (False, True)


def test_template(spark):
    df = spark.createDataFrame([(ITEM,)], "text string")
    row = df.withColumn("_digits", decontaminate.F.lit(True)).select(decontaminate.template(decontaminate.F.col("text"))).first()[0]
    assert row == (
        "the train from ⟨name⟩ to ⟨name⟩ takes ⟨num⟩ ⟨unit⟩ and ⟨num⟩ ⟨unit⟩ so how far does ⟨name⟩ go in "
        "⟨num⟩ ⟨unit⟩ at ⟨num⟩ ⟨unit⟩"
    )


def test_awkward_rows(awkward, no_docs, benchmark):
    assert found(awkward, benchmark) == {}
    assert found(no_docs, benchmark) == {}
    assert found(awkward, benchmark.limit(0)) == {}
    copies = awkward.withColumnsRenamed({"text": "t", "source": "text"}).withColumn("text", decontaminate.F.lit(ITEM))
    assert {k for k in found(copies, benchmark)} == {(r.doc_id, 10) for r in awkward.collect()}


def test_without_benchmark(make_docs, benchmark, no_docs):
    docs = make_docs([(1, ITEM), (1, "clean but of the same id"), (2, FILLER), (2, FILLER), (None, FILLER), (3, None)])
    docs = docs.union(make_docs([(None, ITEM), (None, ITEM.lower())])).withColumnRenamed("hash", "_copy")
    kept = decontaminate.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns
    left = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert left == sorted(map(repr, [(1, "clean but of the same id"), (2, FILLER), (2, FILLER), (None, FILLER), (3, None)]))
    assert decontaminate.without_benchmark(no_docs, benchmark).collect() == []


def test_large_benchmarks_are_joined_by_shuffle(make_docs, benchmark):
    docs = make_docs([(1, f"{FILLER} {ITEM}"), (2, FILLER)])
    s = decontaminate.Settings(broadcast_limit=0)
    rows = decontaminate.contaminated(docs, benchmark, settings=s).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 10)]


def test_a_whole_table(spark):
    path = "/root/testdata/sf0.01"
    docs, items = table(spark, path, "documents").collect(), table(spark, path, "benchmark").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in op5_decontaminate(spark, path).collect()}
    assert want and got == want


BUYS = (
    "Anna buys 5 apples and 3 pears at the market. Ben gives her 2 more pears. How many pieces of fruit does she "
    "carry home in the end, if she eats 1 of them on the way and finds 7 in the garden?"
)
LONG = (
    "A worker named Otto lays 12 stones in a row, then rests, then lays more stones until the wall is done. The wall of "
    "his brother takes 12 stones too, and both walls stand side by side at the end of the long garden path"
)


def test_one_clash_costs_its_windows_only(spark, make_docs):
    items = spark.createDataFrame([(20, BUYS), (21, LONG)], "item_id bigint, text string")
    docs = make_docs(
        [
            (1, f"{FILLER}. {BUYS.replace('5', '4').replace('3', '4')}"),
            (2, f"{FILLER}. {LONG.replace('takes 12', 'takes 21')}"),
            (3, f"{FILLER}. {LONG}"),
            (4, f"{FILLER}. {LONG.replace('12', '30')}"),
        ]
    )
    got = found(docs, items)
    assert set(got) == {(1, 20), (2, 21), (3, 21), (4, 21)}
    assert got[1, 20].share == got[3, 21].share == got[4, 21].share == 1.0
    assert 0.5 < got[2, 21].share < 1.0
    assert [got[k].reparameterised for k in sorted(got)] == [True, False, False, True]


def test_trivial_disguises(spark, make_docs, benchmark):
    """Case, line breaks and blanks change neither words nor the verdict."""
    copies = [ITEM, ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.replace(" ", "  "), ITEM.replace(" ", "\n"), ITEM.replace(" to ", "\r\n\tto ")]
    docs = make_docs([(n, f"{FILLER}. {copy} {FILLER}") for n, copy in enumerate(copies)])
    got = found(docs, benchmark)
    assert set(got) == {(n, 10) for n in range(len(copies))}
    assert not any(r.reparameterised for r in got.values())


WORDS = "which of these seven rivers flows through more than one country before it finally reaches the cold sea in autumn or winter storms each year without ever freezing over"


@pytest.mark.parametrize("size", [15, 20, 25, 30])
def test_short_items_with_edits(spark, make_docs, size):
    """One or two changed words hide no item; recall over all places of them."""
    words = (WORDS.split() + ["again", "and", "again"])[:size]
    edits = [(i,) for i in range(size)] + [(i, j) for i in range(0, size, 3) for j in range(i + 6, size, 4)]
    text = lambda places: " ".join("otherword" if n in places else w for n, w in enumerate(words))
    docs = make_docs([(n, f"{FILLER} {text(places)} {FILLER}") for n, places in enumerate(edits)] + [(-1, FILLER), (-2, " ".join(words[:7]))])
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = {k[0] for k in found(docs, items)}
    assert got <= set(range(len(edits)))
    assert len(got) >= 0.9 * len(edits)


def brute(docs, items, width=6):
    """Share of the words of each item that windows of plain words cover."""
    split = lambda text: [w for w in (re.sub(r"[^\w\s]|_", "", x) for x in text.lower().split()) if w]
    found = {}
    for doc, text in docs:
        words = split(text)
        held = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        for item, asked in items:
            want = split(asked)
            inside = {p for q in range(len(want) - width + 1) if tuple(want[q : q + width]) in held for p in range(q, q + width)}
            if len(inside) >= 0.5 * len(want):
                found[doc, item] = len(inside) / len(want)
    return found


def test_windows_and_shares_by_brute_force(spark, make_docs):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randint(6, 30)))) for n in range(20)]

    def edited(text):
        words = text.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words[rng.randint(0, 3) :])

    docs = [(n, " ".join([edited(rng.choice(items)[1]), *rng.choices(vocabulary, k=5), edited(rng.choice(items)[1])])) for n in range(60)]
    got = found(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    want = brute(docs, items)
    assert len(want) > 30
    assert {k: round(r.share, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_tables_of_numbers_meet_as_they_are(spark, make_docs):
    """20,000 numbers against an item of 50: no window of placeholders alone."""
    numbers = lambda n, step: " ".join(str(step * i + 7) for i in range(n))
    items = spark.createDataFrame([(1, numbers(50, 3)), (2, numbers(50, 1000))], "item_id bigint, text string")
    docs = make_docs([(1, numbers(20_000, 2)), (2, f"{FILLER} {numbers(60, 3)}"), (3, numbers(20_000, 1000))])
    assert set(found(docs, items)) == {(2, 1), (3, 2)}
