"""The trie of conversations, against one built node by node."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from veilframe.llm.trie import SpillingQueue, nodes_of, rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, a string, place string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)


def sequences(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(turns)] for c, turns in said.items()}
    found = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = said.get(c - int(abs(c) % 100 * (1 if c >= 0 else -1)), [])[:h] + turns[h:]
    return found


def expected(found):
    members = defaultdict(list)
    for c, turns in sorted(found.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    ids = {node: ",".join(str(c) for c in m if len(found[c]) == len(node)) for node, m in members.items()}
    return sorted(
        (
            (m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ids[node].encode()).hexdigest())
            for node, m in members.items()
        ),
        key=repr,
    )


def results(spark, rows, **options):
    found = nodes_of(*rebuilt(frame(spark, rows)), **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def some_rows(seed, n, turns, words):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in rng.sample(range(-150, 1000), n) for t in range(rng.randint(1, turns))]
    return rows


@pytest.mark.parametrize("options", [{}, {"band": 2, "large": 3, "queue": 2}, {"band": 3, "large": 10**9}, {"band": 64, "large": 0}])
def test_random_conversations(spark, options):
    rows = some_rows(1, 150, 9, ["", "a", "é日", "a b"])
    assert results(spark, rows, **options) == expected(sequences(rows))


def test_copies_of_a_long_conversation(spark):
    """A path of many bands that many share, and one turn that all begin with."""
    long = [("user" if t % 2 else "bot", f"turn {t}") for t in range(300)]
    rows = [(100 * c, t, *turn) for c in range(30) for t, turn in enumerate(long[: 300 - c % 3])]
    rows += [(c, t, *long[t]) for c in (7, 8, 107) for t in range(10)]
    want = expected(sequences(rows))
    assert results(spark, rows) == want
    assert results(spark, rows, band=7, large=40, queue=5) == want


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, 0, "", "b"), (1, 0, "", "b"), (1, 0, "a", ""), (2, 5, "user", None), (None, 1, "user", "x")]
    rows += [(3, t, "r" * t, "é" * t) for t in range(7)] + [(3, 2, "rr", "éé"), (100, 0, "a", "ab"), (101, 0, "aa", "b"), (102, 3, "aa", "b")]
    assert results(spark, rows) == expected(sequences(rows))


def test_turnless_conversations(spark):
    """Without their base, short conversations lose all their turns."""
    rows = [(c, 0, "user", "hi") for c in (101, 102, 103, 104, 205, 206)]
    found = sequences(rows)
    assert any(not t for t in found.values())
    assert results(spark, rows) == expected(found)


def test_no_rows(spark):
    assert results(spark, some_rows(1, 3, 2, ["a"])[:0]) == []


def test_queue_spills_and_returns_in_order():
    rng = random.Random(4)
    queue, messages = SpillingQueue(7), [(rng.randint(-20, 0), rng.randint(0, 3), 0, n, 2, 1) for n in range(500)]
    for m in messages:
        queue.push(m)
    for key in sorted({m[:3] for m in messages}):
        assert sorted(queue.take(key)) == sorted(m[3:] for m in messages if m[:3] == key)
    assert not queue.heap and not queue.heads
