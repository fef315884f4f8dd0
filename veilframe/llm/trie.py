"""The trie of shared beginnings of conversations, by time-forward processing.

A node is known by two 64-bit values: the exclusive or of hashes of its turns
with their places, so that prefixes of a conversation of any length are sums
over slices of it.  Counts of a node are partial aggregations over the paths.

Totals of subtrees are passed on from the leaves.  Nodes are dealt into shards
by the *top* above them: nodes at every ``BAND``-th level, and nodes whose part
of a band is so large that it would fill a task (each of these is a shard of its
own, and so each of its children starts another).  A shard is sorted by reverse
level order, which Spark does with spilling, and read once: a node takes the
messages of its children from the head of a priority queue, which spills too,
adds its own, and sends the sum to its parent.  Tops send theirs across shards:
tops without tops below them are summed per receiver, the others (at most one
of ``BAND`` nodes on a path, besides the large ones) are one more, small, shard
that is processed alike.  With what tops receive known, the shards are read
again, for every node.

Nodes of one conversation have one leaf and save nothing; they go into no shard.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.text import in_small_batches
from veilframe.operators.joins import attach
from veilframe.operators.ranking import rank_within
from veilframe.shared import dropped, written

BAND = 64
LARGE = 200_000
QUEUE = 500_000
BROADCAST_LIMIT = 8 << 20
CHUNK = 1 << 16
_NODE = ["depth", "a", "b"]


class SpillingQueue:
    """Messages ``(key..., values...)`` of six integers, least key first; sorted
    runs beyond ``limit`` messages wait in files that vanish with the task."""

    WIDTH = 6

    def __init__(self, limit: int = QUEUE) -> None:
        self.limit = limit
        self.heap: list[tuple[int, ...]] = []
        self.heads: list[tuple[tuple[int, ...], int]] = []
        self.runs: list[Iterator[tuple[int, ...]]] = []

    def push(self, message: tuple[int, ...]) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        np.array(sorted(self.heap), np.int64).tofile(run)
        self.heap = []
        run.seek(0)
        self.runs.append(self._read(run))
        self._advance(len(self.runs) - 1)

    def _read(self, run) -> Iterator[tuple[int, ...]]:
        with run:
            while len(part := np.fromfile(run, np.int64, 4096 * self.WIDTH)):
                yield from map(tuple, part.reshape(-1, self.WIDTH).tolist())

    def _advance(self, n: int) -> None:
        head = next(self.runs[n], None)
        if head is not None:
            heapq.heappush(self.heads, (head, n))

    def take(self, key: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """The values of all messages with this key, which is the least."""
        size = len(key)
        while self.heap and self.heap[0][:size] == key:
            yield heapq.heappop(self.heap)[size:]
        while self.heads and self.heads[0][0][:size] == key:
            head, n = heapq.heappop(self.heads)
            self._advance(n)
            yield head[size:]


def _forward(nodes: DataFrame, shards: list[str] | None, limit: int, tops_only: bool) -> DataFrame:
    """Totals ``children``, ``leaves`` and ``saved`` over the part of each
    node's subtree that lies in its shard.

    ``nodes`` have their own shares under those names, ``top``, and the parent
    ``(up_depth, pa, pb)`` that gets their message; ``shards`` None is one shard.
    """
    columns = [*_NODE, "up_depth", "pa", "pb", "top", "children", "leaves", "saved"]
    sharded = nodes.repartition(*shards) if shards else nodes.repartition(1)
    ordered = sharded.select(*columns).sortWithinPartitions(F.col("depth").desc(), "a", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        for batch in batches:
            found = []
            for depth, a, b, up, pa_, pb, top, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for more_leaves, more_saved, n in queue.take((-depth, a, b)):
                    children, leaves, saved = children + n, leaves + more_leaves, saved + more_saved
                if not top:
                    queue.push((-up, pa_, pb, leaves, saved, 1))
                if top or not tops_only:
                    found.append((depth, a, b, children, leaves, saved))
            table = np.array(found, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in table.T.copy()], names=[*_NODE, "children", "leaves", "saved"])

    return in_small_batches(ordered).mapInArrow(run, "depth long, a long, b long, children long, leaves long, saved long")


def rebuilt(conversations: DataFrame, *, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike: ``(conv_id, length)`` and their turns
    ``(conv_id, depth, role, text, length)``.

    Conversation c gets the first h turns of conversation ``c - c % group`` (all
    if fewer, none if absent), h being crc32 of c as text modulo ``heads``, then
    its own turns after its first h.  Turns are in order of ``turn``, null first,
    then of role and text; null roles and texts are empty.  Rows without a
    ``conv_id`` belong to no conversation.
    """
    said = conversations.where("conv_id is not null").select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    ranked = rank_within(said, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place")
    ranked = written(ranked.drop("turn"), "ranked")
    taken = F.crc32(F.col("conv_id").cast("string")) % heads
    counts = written(ranked.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    convs = counts.withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    convs = convs.join(counts.toDF("base", "base_n"), "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "h", "base", "lent", "length"), "convs")
    first = ranked.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "role", "text")
    lent = convs.join(first, "base").where("depth <= h").select("conv_id", "depth", "role", "text", "length")
    own = ranked.where(F.col("place") > taken)
    own = attach(own, convs.select("conv_id", "h", "lent", "length"), ["conv_id"], "inner", broadcast_limit=BROADCAST_LIMIT)
    own = own.select("conv_id", (F.col("lent") + F.col("place") - F.col("h")).alias("depth"), "role", "text", "length")
    return convs.select("conv_id", "length"), lent.union(own)


def _paths(convs: DataFrame, turns: DataFrame, band: int) -> DataFrame:
    """``(conv_id, depth, a, b, pa, pb, size, length, band)``: every node on the
    way of every conversation, the root's with depth 0."""
    value = lambda n: F.xxhash64(F.lit(n), "depth", "role", "text")
    in_band = F.floor((F.col("depth") - 1) / band)
    marked = turns.select("conv_id", "depth", "length", value(1).alias("va"), value(2).alias("vb"), F.length("text").cast("bigint").alias("size"))
    marked = written(marked.withColumn("band", in_band), "turn-hashes")
    sums = marked.groupBy("conv_id", "band").agg(F.bit_xor("va").alias("sa"), F.bit_xor("vb").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "band", *(F.coalesce(F.bit_xor(f"s{c}").over(before), F.lit(0)).alias(f"s{c}") for c in "ab"))
    upto = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    walked = marked.join(starts, ["conv_id", "band"])
    for c in "ab":
        walked = walked.withColumn(c, F.col(f"s{c}").bitwiseXOR(F.bit_xor(f"v{c}").over(upto)))
    walked = walked.select(
        "conv_id", "depth", "a", "b", *(F.col(c).bitwiseXOR(F.col(f"v{c}")).alias(f"p{c}") for c in "ab"), "size", "length", "band"
    )
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("size"), "length", F.lit(-1).cast("bigint").alias("band"))
    return walked.union(roots)


def _ends(paths: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids of the conversations that end there.

    Ids are joined to chunks where they were sorted, over all tasks; the hash of
    one node then reads its chunks in order.
    """
    key = ["a", "b"]
    last = paths.where("depth = length").select("a", "b", "conv_id")
    last = last.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (c.to_numpy() for c in batch.columns)
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new).tolist()
            spans = [(x, y) for lo, hi in zip(at, [*at[1:], len(a)], strict=True) for x in range(lo, hi, CHUNK // 16) for y in [min(x + CHUNK // 16, hi)]]
            first = [x for x, _ in spans]
            joined = [",".join(map(str, ids[x:y].tolist())) for x, y in spans]
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(ids[first]), pa.array(joined, pa.string())], names=["a", "b", "first", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            found = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    found.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256(ids.encode())
            yield _ended(found)
        yield _ended([] if now is None else [(*now, digest.hexdigest())])

    def _ended(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "ends_sha256"])

    joined = in_small_batches(last).mapInArrow(chunks, "a long, b long, first long, ids string")
    return joined.repartition(*key).sortWithinPartitions(*key, "first").select("a", "b", "ids").mapInArrow(digests, "a long, b long, ends_sha256 string")


def _shards(paths: DataFrame, nodes: DataFrame, band: int, large: int) -> DataFrame:
    """``(depth, a, b, t_depth, ta, tb)``: the top of each node's shard."""
    heavy = written(nodes.where(F.col("below") > large).select(*_NODE, F.lit(True).alias("heavy")), "heavy")
    ways = attach(paths.select("conv_id", "band", *_NODE), heavy, _NODE, broadcast_limit=BROADCAST_LIMIT)
    step = Window.partitionBy("conv_id", "band").orderBy("depth")
    is_heavy = F.col("heavy").isNotNull()
    ways = ways.withColumn("top", (F.col("depth") == 0) | ((F.col("depth") - 1) % band == 0) | is_heavy | F.coalesce(F.lag(is_heavy).over(step), F.lit(False)))
    top = F.when(F.col("top"), F.struct(F.col("depth").alias("t_depth"), F.col("a").alias("ta"), F.col("b").alias("tb")))
    ways = ways.withColumn("shard", F.last(top, ignorenulls=True).over(step))
    return ways.groupBy(*_NODE).agg(F.min("shard").alias("shard")).select(*_NODE, "shard.*")


def _totals(paths: DataFrame, nodes: DataFrame, band: int, large: int, queue: int) -> DataFrame:
    """``(depth, a, b, children, leaves, saved)`` of the nodes of two
    conversations or more, by the passes within and across shards."""
    tails = nodes.where("n_convs = 1").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth"))
    tails = tails.agg(F.count("*").alias("tails"))
    shared = nodes.where("n_convs > 1").join(_shards(paths, nodes, band, large), _NODE).join(tails, _NODE, "left")
    tails = F.coalesce("tails", F.lit(0))
    shared = shared.select(
        *_NODE, (F.col("depth") - 1).alias("up_depth"), "pa", "pb", "t_depth", "ta", "tb",
        ((F.col("depth") == F.col("t_depth")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))).alias("top"),
        tails.alias("children"),
        (tails + F.when(F.col("inner"), 0).otherwise(1)).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    shared = written(shared, "shared")
    shards = ["t_depth", "ta", "tb"]
    tops = written(_forward(shared, shards, queue, True), "tops")
    # Each top sends to the top of the shard that holds its parent.
    sent = shared.where("top and depth > 0").select(*_NODE, "up_depth", "pa", "pb")
    above = shared.select(F.col("depth").alias("up_depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), *shards)
    sent = attach(sent, written(above, "above"), ["up_depth", "pa", "pb"], "inner", broadcast_limit=BROADCAST_LIMIT)
    over = written(sent.join(tops.drop("children"), _NODE), "over")
    inner = over.select(*shards).distinct().toDF(*_NODE).withColumn("is_inner", F.lit(True))
    leafs = over.join(inner, _NODE, "left_anti").groupBy(*shards).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).toDF(*_NODE, "l", "s")
    across = tops.drop("children").join(inner, _NODE).join(over.select(*_NODE, *shards), _NODE, "left").join(leafs, _NODE, "left")
    across = across.select(
        *_NODE, F.coalesce("t_depth", F.lit(-1)).alias("up_depth"), F.coalesce("ta", F.lit(0)).alias("pa"), F.coalesce("tb", F.lit(0)).alias("pb"),
        (F.col("depth") == 0).alias("top"), F.lit(0).cast("bigint").alias("children"),
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
    )
    final = written(_forward(across, None, queue, False).select(*_NODE, F.col("leaves").alias("l"), F.col("saved").alias("s")), "across")
    whole = over.join(final, _NODE, "left").withColumn("leaves", F.coalesce("l", "leaves")).withColumn("saved", F.coalesce("s", "saved"))
    got = whole.groupBy(F.col("up_depth").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    got = got.agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    ready = shared.join(got, _NODE, "left")
    for name, more in (("children", "c"), ("leaves", "l"), ("saved", "s")):
        ready = ready.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    result = written(_forward(ready, shards, queue, False), "totals")
    dropped(shared, tops, over, final)
    return result


def nodes_of(convs: DataFrame, turns: DataFrame, *, band: int = BAND, large: int = LARGE, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie of all conversations' beginnings.

    ``convs`` has ``conv_id`` (distinct, not null) and ``length``, ``turns``
    besides ``depth`` (from 1), ``role`` and ``text``, not null.  Columns of the
    result: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``.  Conversations without turns are members of the root;
    without conversations there is no node.
    """
    paths = written(_paths(convs, turns, band), "paths")
    ends = written(_ends(paths), "ends")
    left = F.least("length", (F.col("band") + 1) * band) - F.col("depth") + 1
    nodes = paths.groupBy(*_NODE, "pa", "pb").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("size").alias("size"),
        F.max(F.col("depth") < F.col("length")).alias("inner"),
        F.when(F.col("depth") > 0, F.sum(left)).otherwise(0).alias("below"),
    )
    nodes = written(nodes, "nodes")
    totals = _totals(paths, nodes, band, large, queue)
    found = nodes.join(totals, _NODE, "left").join(ends, ["a", "b"], "left")
    parents = nodes.where("inner").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = attach(found, written(parents, "parents"), ["depth", "pa", "pb"], broadcast_limit=BROADCAST_LIMIT)
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("children", F.col("inner").cast("bigint")).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
