"""The best documents of each item by lexical score, by search over two trees.

Items are a stated query set; they are taken in blocks of bounded size, and all
documents are searched for each block.  A document becomes a short list of the
block's terms it holds.  Batches of those lists and the block's items each get a
hierarchy in which a node holds, term by term, the maximum of what lies below
it: for documents of what a term adds per unit of weight, for items of the
weight of the term times its occurrences.  The product of two nodes bounds every
score between them.  A pair of nodes whose bound is below the weakest k-th best
score among its items is cut off with all it holds; the others are opened level
by level, down to single items and documents, where the bound is the score.

The k-th best scores of a small sample of the documents are true lower bounds
of the final ones, so a first search over the sample keeps later batches from
returning more than a few rows per item.  Scores are whole numbers; products are
summed in doubles while they are below 2**53 and in integers otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.text import LOWER, in_small_batches, map_texts, raw, tokens
from veilframe.shared import dropped, written

K = 10
# Fixed values of the score.
B_PERCENT = 75
# Tokens are runs of letters, digits and bytes of non-ASCII characters.
TERMS = np.zeros(256, np.uint8)
TERMS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

BLOCK_BYTES = 4 << 20
SAMPLED = 32
FAN = 8
BATCH = 4096
_EXACT = float(1 << 53)
_TOP_TERM = 1_000_000


class Block(NamedTuple):
    """Items of a block in tree order, by their terms: ``ends`` of each item's
    terms (places in the sorted ``terms``) and their occurrences."""

    number: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    term: np.ndarray
    times: np.ndarray


class Sparse(NamedTuple):
    """Rows of (term, value), terms ascending in a row."""

    ends: np.ndarray
    term: np.ndarray
    value: np.ndarray


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, term hash, occurrences)`` in order of both, and terms per text."""
    found = tokens(*raw(texts), TERMS, LOWER)
    order = np.lexsort((found.hash, found.text))
    owner, value = found.text[order], found.hash[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value))), np.bincount(found.text, minlength=len(texts))


def _weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _levels(rows: Sparse) -> list[Sparse]:
    """The rows, and above them every ``FAN`` neighbours as their maxima."""
    levels = [rows]
    while len(levels[-1].ends) > FAN:
        low = levels[-1]
        n = len(low.ends)
        parent = np.repeat(np.arange(n) // FAN, np.diff(np.append(0, low.ends)))
        order = np.lexsort((low.term, parent))
        parent, term, value = parent[order], low.term[order], low.value[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (parent[1:] != parent[:-1])
        at = np.flatnonzero(new)
        value = np.maximum.reduceat(value, at) if len(at) else value
        ends = np.cumsum(np.bincount(parent[at], minlength=-(-n // FAN)))
        levels.append(Sparse(ends, term[at], value))
    return levels


def _taken(rows: Sparse, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place in which, term, value)`` of the given rows."""
    start = np.append(0, rows.ends)[which]
    size = rows.ends[which] - start
    place = np.repeat(np.arange(len(which)), size)
    at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    return place, rows.term[at], rows.value[at]


class Best:
    """The ``k`` best documents of each item so far, as (score, id, id is null):
    equal scores by id, null last.  ``least`` is what a score must reach."""

    def __init__(self, n_items: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n_items

    def add(self, item: int, *found: np.ndarray) -> None:
        found = tuple(np.concatenate(x) for x in zip(self.held[item], found, strict=True))
        score, doc, none = found
        if len(score) > self.k:
            keep = np.lexsort((doc, none, -score))[: self.k]
            found = tuple(x[keep] for x in found)
        self.held[item] = found
        if len(found[0]) == self.k:
            self.least[item] = max(self.least[item], found[0].min())


def _bounds(items: Sparse, nodes: np.ndarray, docs: Sparse, opened: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Products of document nodes (rows) and item nodes; ``slot`` is zero for
    every term, before and after."""
    place, term, weight = _taken(items, nodes)
    own = np.unique(term)
    slot[own] = np.arange(1, len(own) + 1)
    doc, doc_term, value = _taken(docs, opened)
    column = slot[doc_term] - 1
    slot[own] = 0
    shared = column >= 0
    doc, column, value = doc[shared], column[shared], value[shared]
    heaviest = np.bincount(place, weights=weight.astype(float), minlength=len(nodes)).max(initial=0) * _TOP_TERM
    kind = np.float64 if heaviest < _EXACT else np.int64
    table = np.zeros((len(own), len(nodes)), kind)
    table[np.searchsorted(own, term), place] = weight
    found = np.zeros((len(opened), len(nodes)), kind)
    at = np.flatnonzero(np.diff(np.append(-1, doc)))
    if len(at):
        found[doc[at]] = np.add.reduceat(table[column] * value.astype(kind)[:, None], at, axis=0)
    return found.astype(np.int64)


def _children(nodes: np.ndarray, n: int) -> np.ndarray:
    below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    return below[below < n]


def search(items: list[Sparse], docs: list[Sparse], n_terms: int, best: Best, ids: np.ndarray, none: np.ndarray) -> int:
    """Put every score that reaches an item's ``least`` among its best, for all
    items and documents below two hierarchies; ``ids`` and ``none`` are those of
    the documents.  Returns how many single pairs were scored."""
    slot = np.zeros(n_terms, np.int64)

    def visit(level: int, nodes: np.ndarray, doc_level: int, opened: np.ndarray) -> int:
        scored = 0
        found = _bounds(items[level], nodes, docs[doc_level], opened, slot)
        for column, node in enumerate(nodes.tolist()):
            weakest = lambda: max(int(best.least[node * FAN**level : (node + 1) * FAN**level].min()), 1)  # noqa: B023, E731
            alive = np.flatnonzero(found[:, column] >= weakest())
            if not len(alive):
                continue
            if level == doc_level == 0:
                scored += len(alive)
                left = opened[alive]
                best.add(node, found[alive, column], ids[left], none[left])
                continue
            # Promising documents first, in steps, so that k-th scores rise early.
            alive = alive[np.argsort(-found[alive, column], kind="stable")]
            lower = _children(np.array([node]), len(items[level - 1].ends)) if level else np.array([node])
            for lo in range(0, len(alive), FAN * FAN):
                if found[alive[lo], column] < weakest():
                    break
                left = np.sort(opened[alive[lo : lo + FAN * FAN]])
                if doc_level:
                    left = _children(left, len(docs[doc_level - 1].ends))
                scored += visit(max(level - 1, 0), lower, max(doc_level - 1, 0), left)
        return scored

    if not len(items[0].ends) or not len(docs[0].ends):
        return 0
    return visit(len(items) - 1, np.arange(len(items[-1].ends)), len(docs) - 1, np.arange(len(docs[-1].ends)))


def _postings(docs: DataFrame, id_col: str, text_col: str, block: Block) -> DataFrame:
    """``(doc, n, term, times)``: of each document its number of terms and those
    that the block knows."""
    known = docs.sparkSession.sparkContext.broadcast(block.terms)

    def work(texts: pa.Array) -> list:
        owner, value, times, n = counted(texts)
        place = np.searchsorted(known.value, value)
        place[place == len(known.value)] = 0
        held = known.value[place] == value if len(known.value) else np.zeros(len(value), bool)
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner[held], minlength=len(texts)))))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[held], pa.int32())) for x in (place, times)]
        return [pa.array(n.astype(np.int64)), *lists]

    fields = [T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("term", "times"))]
    return map_texts(docs, F.col(f"`{text_col}`"), [F.col(f"`{id_col}`").alias("id")], fields, work).select("row.id", "n", "term", "times")


def _block(items: DataFrame) -> Block:
    """The items ``(number, text)`` of one block; similar ones are neighbours:
    in order of their rarest terms."""
    table = items.toArrow()
    owner, value, times, _ = counted(table["text"])
    terms, place, held_by = np.unique(value, return_inverse=True, return_counts=True)
    rare = np.lexsort((place, held_by[place], owner))
    first = np.flatnonzero(np.diff(np.append(-1, owner)))
    by_item = np.zeros(len(table), np.int64) - 1
    by_item[owner[first]] = place[rare][first]
    sequence = np.argsort(by_item, kind="stable")
    position = np.empty(len(table), np.int64)
    position[sequence] = np.arange(len(table))
    order = np.lexsort((place, position[owner]))
    ends = np.cumsum(np.bincount(position[owner], minlength=len(table)))
    return Block(table["number"].to_numpy()[sequence], terms, ends, place[order], times[order])


def _documents(n: np.ndarray, owner: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
    """The hierarchy over documents of ``n`` terms each, and their order in it:
    those whose greatest share of a score is from one term are neighbours."""
    m = np.array([100 - B_PERCENT + B_PERCENT * x * n_docs // n_terms for x in n.tolist()], np.int64)
    value = (1_000_000_000 * times) // (1000 * times + 8 * m[owner])
    heavy = np.lexsort((terms, -(value * weights[terms]), owner))
    first = np.flatnonzero(np.diff(np.append(-1, owner)))
    leading = np.full(len(n), -1)
    leading[owner[first]] = terms[heavy][first]
    sequence = np.argsort(leading, kind="stable")
    position = np.empty(len(n), np.int64)
    position[sequence] = np.arange(len(n))
    order = np.lexsort((terms, position[owner]))
    ends = np.cumsum(np.bincount(position[owner], minlength=len(n)))
    return _levels(Sparse(ends, terms[order], value[order])), sequence


def _best_of(postings: DataFrame, block: Block, weights: np.ndarray, totals: tuple[int, int], k: int, least: np.ndarray) -> DataFrame:
    """``(number, doc, score)``: of each task the best documents of each item
    that score at least its ``least``."""
    sent = postings.sparkSession.sparkContext.broadcast((block, weights, least))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, least = sent.value
        items = _levels(Sparse(block.ends, block.term, block.times * weights[block.term]))
        best = Best(len(block.ends), k, least)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                terms, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
                n = batch.column(1).to_numpy()
                docs, sequence = _documents(n, owner, terms, times, weights, *totals)
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False)[sequence]
                ids = batch.column(0).fill_null(0).to_numpy()[sequence]
                search(items, docs, len(block.terms), best, ids, none)
        score, doc, none = (np.concatenate([h[c] for h in best.held]) if best.held else np.zeros(0, np.int64) for c in range(3))
        number = np.repeat(block.number, [len(h[0]) for h in best.held])
        columns = [pa.array(number), pa.array(doc.astype(np.int64), mask=none.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["number", "doc", "score"])

    return in_small_batches(postings.select("id", "n", "term", "times")).mapInArrow(run, "number long, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item, first within parts of them, so that no
    task gets more than a few rows for each task of the search."""
    found = found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64)))
    best = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    in_part = found.withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*best))).where(F.col("rank") <= k)
    return in_part.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*best))).where(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = K
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: of each row of ``items`` the ``k``
    documents with the highest scores above 0, equal ones by ascending id (an
    integer; null last).

    Null and empty texts have no terms: such an item gets no rows and such a
    document no rank.  Equal rows of either table count and are ranked on their
    own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    numbered = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    numbered = written(numbered.withColumn("number", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(-(-size // BLOCK_BYTES), 1)
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    results = []
    for n in range(n_blocks):
        block = _block(numbered.where(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == n).select("number", "text"))
        postings = written(_postings(docs, "id", "text", block), "postings")
        totals = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not totals[1]:
            dropped(postings)
            continue
        held = postings.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()
        df = np.zeros(len(block.terms), np.int64)
        df[held["term"].to_numpy()] = held["count"].to_numpy()
        weights = np.array([_weight(x, totals[0]) for x in df.tolist()], np.int64)
        least = np.zeros(len(block.ends), np.int64)
        sample = postings.where(F.pmod(F.xxhash64("id", "n"), F.lit(SAMPLED)) == 0)
        seen = _ranked(_best_of(sample, block, weights, tuple(totals), k, least), k).where(F.col("rank") == k).toArrow()
        order = np.argsort(block.number)
        least[order[np.searchsorted(block.number[order], seen["number"].to_numpy())]] = seen["score"].to_numpy()
        results.append(written(_ranked(_best_of(postings, block, weights, tuple(totals), k, least), k), "ranked"))
        dropped(postings)
    schema = "number long, doc long, score long, part long, rank int"
    found = spark.createDataFrame([], schema)
    for result in results:
        found = found.unionByName(result)
    return found.join(numbered, "number").select(
        F.col("item").alias(item_col), F.col("rank"), F.col("doc").alias(id_col), F.col("score")
    )
