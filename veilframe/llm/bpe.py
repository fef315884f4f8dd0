"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be merged over, so a cut between them is certain.  A text is cut at such
places, its fragments are merged each on its own, equal ones once, and the ids
are concatenated.  All fragments of a slice of texts are merged side by side:
each round applies every fragment's lowest ranked pair.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.text import in_small_batches, map_named, raw

# Fixed value: the pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNMERGED = np.iinfo(np.int64).max
# Bytes that end no Unicode blank: ASCII signs, letters and digits.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable
    Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def tables(spec: dict) -> dict:
    """What encoding and decoding look up, from a vocabulary file's content:
    merges by pair of ids, ids of bytes, bytes of ids, special tokens, and
    which bytes are neighbours inside some token."""
    model, letters = spec["model"], byte_letters()
    pre, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    usual = pre.get("type") == decoder.get("type") == "ByteLevel" and pre.get("use_regex", True)
    if model.get("type") != "BPE" or not usual or pre.get("add_prefix_space") or spec.get("normalizer") or any(map(model.get, options)):
        raise ValueError("not a plain byte-level BPE vocabulary")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    as_bytes = {t: bytes(map(letters.__getitem__, t)) for t in tokens}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys, first = np.unique(np.array([(tokens[a] << 32) | tokens[b] for a, b in merges], np.int64), return_index=True)
    inside = np.zeros((256, 256), bool)
    for token in as_bytes.values():
        held = np.frombuffer(token, np.uint8)
        inside[held[:-1], held[1:]] = True
    pieces = {i: as_bytes[t] for t, i in tokens.items()} | {i: s.encode() for s, i in special.items()}
    by_letter = {b: tokens[c] for c, b in letters.items()}
    return {
        "keys": keys,
        "ranks": first.astype(np.int64),
        "made": np.array([tokens[a + b] for a, b in merges], np.int64),
        "byte_ids": np.array([by_letter[b] for b in range(256)], np.int64),
        "inside": inside,
        "pieces": pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.large_binary()),
        "special": special,
    }


class Codec:
    """Encodes and decodes arrays of texts with the tables of a vocabulary."""

    def __init__(self, held: dict):
        self.keys, self.ranks, self.made = held["keys"], held["ranks"], held["made"]
        self.byte_ids, self.inside, self.pieces = held["byte_ids"], held["inside"], held["pieces"]
        self.special = held["special"]
        self.split = regex.compile(SPLIT)
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.whole_texts = any(regex.search(r"\s", t) for t in ordered)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; ``_UNMERGED`` if there is none."""
        if not len(self.keys):
            return np.full(len(left), _UNMERGED)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _UNMERGED)

    def merged(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments, one after another, and how many each has;
        fragments begin at ``starts`` and none is empty."""
        ids = self.byte_ids[data]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
        rank = np.full(len(ids), _UNMERGED)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(ids[:-1], ids[1:]), _UNMERGED)
        done_ids, done_owners = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(rank, first)
            ended = np.repeat(low == _UNMERGED, size)
            if ended.any():
                done_ids.append(ids[ended])
                done_owners.append(owner[ended])
                ids, owner, rank = ids[~ended], owner[~ended], rank[~ended]
                if not len(ids):
                    break
                low, size = low[low != _UNMERGED], size[low != _UNMERGED]
            hit = rank == np.repeat(low, size)
            # Of overlapping pairs (aaa) every second one, from the left.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            at = np.flatnonzero(hit & ((place - run) % 2 == 0))
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at = at - np.arange(len(at))
            near = np.zeros(len(ids) + 1, bool)
            near[at] = near[at - 1] = True  # for 0, the spare place at the end
            rank[-1] = _UNMERGED
            touched = np.flatnonzero(near[:-2])
            same = owner[touched] == owner[touched + 1]
            rank[touched] = np.where(same, self.rank(ids[touched], ids[touched + 1]), _UNMERGED)
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owners)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(starts))

    def solid(self, data: np.ndarray) -> np.ndarray:
        """Bytes that surely end no blank: ASCII signs, and the second byte of
        two-byte letters (blanks among those begin with C2)."""
        solid = _SOLID[data]
        solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        return solid

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of units that pre-tokenization never looks beyond: the texts,
        cut where a blank follows what is surely none."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets[:-1]] = True
        if not self.whole_texts:
            cut[1:-1] |= self.solid(data)[:-1] & (data[1:] == 0x20)
        return np.flatnonzero(cut[:-1])

    def pretokens(self, text: str) -> list[str]:
        """Pieces of a text that may hold special tokens."""
        if self.special_split is None:
            return self.split.findall(text)
        parts = self.special_split.split(text)
        return [x for p in parts for x in ([p] if p in self.special else self.split.findall(p))]

    def encode_units(self, units: pa.Array) -> pa.Array:
        """Lists of ids of distinct, non-empty units."""
        any_special = any(pc.any(pc.match_substring(units, t)).as_py() for t in self.special)
        data, ends = raw(units)
        # Units that begin and end as if cut out of a text are searched as one.
        alone = any_special | (data[ends[:-1]] != 0x20) | ~self.solid(data)[ends[1:] - 1]
        order = np.argsort(alone, kind="stable")
        units = units.take(pa.array(order))
        data, ends = raw(units)
        n_joined = int((~alone).sum())
        pieces = self.split.findall(data[: ends[n_joined]].tobytes().decode())
        cut_up = self.pretokens if any_special else self.split.findall
        for unit in units.slice(n_joined).to_pylist():
            pieces += cut_up(unit)
        # The pieces, one after another, are the units again.
        piece_ends = np.append(0, np.cumsum(pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy()))
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]]
        cut[piece_ends[:-1]] = True
        upto = np.append(0, np.cumsum(cut))  # fragments before each byte
        fragments, codes = _distinct(data, np.flatnonzero(cut))
        ids, n_ids = _taken(_lists(*self.merged(*_bytes_and_starts(fragments))), codes)
        before = np.append(0, np.cumsum(n_ids))
        if any_special:
            keep = np.ones(len(ids), bool)
            for piece, a, b in zip(pieces, before[upto[piece_ends[:-1]]], before[upto[piece_ends[1:]]], strict=True):
                if piece in self.special:
                    keep[a + 1 : b] = False
                    ids[a] = self.special[piece]
            ids, before = ids[keep], np.append(0, np.cumsum(keep))[before]
        return _lists(ids, np.diff(before[upto[ends]])).take(pa.array(np.argsort(order)))

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Lists of ids, one per text."""
        data, offsets = raw(texts)
        if not len(data):
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        starts = self.units(data, offsets)
        units, codes = _distinct(data, starts)
        ids, n_ids = _taken(self.encode_units(units.cast(pa.large_string())), codes)
        bounds = np.append(0, np.cumsum(n_ids))[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
        lists = ids.cast(pa.large_list(pa.int32()))
        values = pc.fill_null(lists.flatten(), len(self.pieces))
        inner = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(self.pieces)))
        tokens = pc.fill_null(self.pieces.take(pc.if_else(inner, values, pa.scalar(None, pa.int32()))), b"")
        sizes = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        places = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=places[1:])
        data = tokens.buffers()[2] or pa.py_buffer(b"")
        start = int(np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset]) if len(tokens) else 0
        joined = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends[places] + start), data])
        try:
            return joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct stretches of the bytes (as binary), and which one each is."""
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _bytes_and_starts(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = raw(parts)
    return data, ends[:-1]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.array(values))


def _taken(lists: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of the lists with these numbers, one after another."""
    found = lists.take(pa.array(codes))
    sizes = found.value_lengths().to_numpy(zero_copy_only=False)
    return found.flatten().to_numpy(zero_copy_only=False).copy(), sizes


def load(path: str) -> dict:
    """Tables of a vocabulary file, made by the driver and sent to the tasks:
    their size is fixed by the tokenizer, not by the data."""
    with open(path, encoding="utf-8") as file:
        return tables(json.load(file))


def encode(df: DataFrame, path: str, text_col: str = "text", rows: list[str] | None = None) -> DataFrame:
    """``(row, ids)``: the columns ``rows`` (default all) as a struct, and the
    ids of the whole text; a null or empty text has none."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    codecs: list[Codec] = []

    def work(texts: pa.Array) -> list:
        if not codecs:
            codecs.append(Codec(shared.value))
        return [codecs[0].encode_all(texts)]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return map_named(df, text_col, df.columns if rows is None else rows, fields, work, 2 << 20)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The frame with ``decoded``: the text of the ids (none: empty), special
    tokens included."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    place = encoded.columns.index(ids_col)
    codecs: list[Codec] = []

    def run(batches):
        for batch in batches:
            if not codecs:
                codecs.append(Codec(shared.value))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = codecs[0].decode_all(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], schema=pa.schema([*part.schema, ("decoded", pa.string())]))

    return in_small_batches(encoded).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text_col: str = "text", rows: list[str] | None = None) -> DataFrame:
    """``(row, ids, decoded)``: :func:`encode`, and :func:`decode` of its ids
    while they are at hand, in one pass of one worker."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    codecs: list[Codec] = []

    def work(texts: pa.Array) -> list:
        if not codecs:
            codecs.append(Codec(shared.value))
        ids = codecs[0].encode_all(texts)
        return [ids, codecs[0].decode_all(ids)]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_named(df, text_col, df.columns if rows is None else rows, fields, work, 2 << 20)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens`` and SHA-256 of the ids and of the decoded text.

    Null texts count as empty; rows with equal or null ids all stay; other
    columns of the input are not read; an empty table gives an empty result.
    """
    coded = round_trip(df, path, text_col, [id_col])
    return coded.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
