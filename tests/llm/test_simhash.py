"""SimHash groups and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import components, simhash
from veilframe.llm.queries import op2_simhash, table

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_components(rows):
    """Smallest id of each row's component."""
    prints = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    groups = Groups()
    for n, p in enumerate(prints):
        for other in np.flatnonzero(np.bitwise_count(prints ^ p) <= 2):
            groups.join(n, int(other))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[groups.find(n)] = min(i, least.get(groups.find(n), i))
    return [least.get(groups.find(n)) for n in range(len(rows))], prints


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    roots, prints = brute_components(rows)
    want = [(i, f"{int(p):016x}", root) for (i, _), p, root in zip(rows, prints, roots, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_awkward_rows(awkward, no_docs):
    check(awkward)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_copies_and_edits(make_docs):
    draw = random.Random(5)
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(60):
        base = draw.choices(words, k=draw.choice([3, 40, 400]))
        for _ in range(draw.choice([1, 1, 3, 12])):
            copy = list(base)
            if draw.random() < 0.6:
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    check(make_docs(rows))


def test_query_on_a_whole_table(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))
    assert op2_simhash(spark, "/root/testdata/sf0.001").columns == ["doc_id", "fingerprint", "component_id"]


def test_one_of_each(awkward, no_docs, make_docs):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = awkward.select("doc_id", "text").collect()
    roots, _ = brute_components([(r.doc_id, r.text) for r in rows])
    # Ids 2, 3 and 4 and the null id have no words; 7 is there twice.
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == sorted([1, 2, None, 5, 6, 7, 8, 9], key=repr), (got, roots)
    assert simhash.one_of_each(no_docs).collect() == []
    same = make_docs([(None, "a b c d")] * 5)
    assert simhash.one_of_each(same).count() == 1


def test_links_join_all_within_two_bits(spark):
    draw = random.Random(1)
    values = {draw.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(draw.randint(0, 6)):
            v ^= 1 << draw.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = components.connect(simhash.links(spark.createDataFrame(signed, "fingerprint long")))
    roots = {r.node & (1 << 64) - 1: r.root for r in found.collect()}
    groups = Groups()
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                groups.join(a, b)
    partition = lambda of: sorted(sorted(v for v in values if of(v) == g) for g in {of(v) for v in values})
    assert partition(groups.find) == partition(lambda v: roots.get(v, v))


def test_components_of_chains_stars_and_random_graphs(spark):
    draw = random.Random(2)
    edges = [(n, n + 1) for n in range(0, 300)] + [(1000, 1000 + n) for n in range(1, 300)]
    edges += [(2000 + draw.randrange(400), 2000 + draw.randrange(400)) for _ in range(300)]
    draw.shuffle(edges)
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r.node: r.root for r in components.connect(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: groups.find(x) for x in linked}
    none = spark.createDataFrame([(1, 1)], "src long, dst long")
    assert components.connect(none).where(F.lit(True)).collect() == []
