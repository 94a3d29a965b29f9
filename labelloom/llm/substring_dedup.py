"""Exact substring removal across documents by fixed-block anchors.

Every document is cut into blocks of ``(window + 1) // 2`` words. Any window holds one of its
document's blocks whole, so if a window is repeated elsewhere, a rolling window there equals that
block. Three rounds between documents and shards of the hash space:

1. Chunks of documents send the hash of every rolling block-sized window, marked where it is one
   of the document's own blocks (the index side). A shard answers which are *anchors*: indexed in
   one document and present in another (or in another chunk, if its id is dealt to several; round 2
   compares ids).
2. Hits are extended to full windows: a window around an anchor is sent by its own hash with the
   smallest document id that holds it. A shard answers which also start in a smaller document.
3. Overlapping windows that were answered grow into maximal exact repeats, and their words go.

Pairs of documents are never formed: a passage shared by many costs one entry per chunk.
Hashes of windows have 64 bits; two different windows among n are taken for one with a chance of
about n^2 / 2^65 over all windows that survive round 1.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import words as W
from labelloom.llm.chunks import NO_ID, by_id, column, lay_out
from labelloom.llm.packing import (
    groups, pack, pack_flags, pack_sorted, shard_bounds, unpack, unpack_flags, unpack_sorted,
)

WINDOW = 50
ANCHOR_BITS = 50

ASK = "shard int, chunk int, size long, keys binary, extra binary, marks binary"
REPLY = "chunk int, round int, shard int, size long, marks binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:long,stop:long>>"


class Keys(NamedTuple):
    """Distinct keys of a chunk in order, and for every key occurrence its number among them."""

    distinct: np.ndarray
    number: np.ndarray
    position: np.ndarray
    first: np.ndarray


class Chunk:
    """Words and hashes of one chunk, in the order of document ids."""

    def __init__(self, table: pa.Table):
        self.table, self.ids, self.place = by_id(table)
        raw = column(self.table, "raw") if len(self.table) else pa.array([], pa.binary())
        data, offsets = W.buffers(raw)
        self.data, self.words = data, W.split_words(data, offsets)
        self.hashes = W.word_hashes(data, self.words)
        self.text = self.words.text_of()
        self.left = self.words.left()

    def keys(self, width: int, bits: int, chosen: np.ndarray | None = None) -> Keys:
        """Keys of all windows of ``width`` words, or of the chosen ones."""
        full = self.left >= width
        position = np.flatnonzero(full if chosen is None else full & chosen)
        values = W.window_hashes(self.hashes, width)[position] & np.uint64(2**64 - 2 ** (64 - bits))
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        first, number = groups(ordered)
        return Keys(ordered[first], number, position[order], first)

    def blocks(self, width: int) -> np.ndarray:
        """Which words begin a block of their own document."""
        return (np.arange(len(self.text)) - self.words.first[self.text]) % width == 0

    def anchors(self, width: int, reply: np.ndarray) -> tuple[Keys, np.ndarray]:
        keys = self.keys(width, ANCHOR_BITS)
        hit = np.zeros(len(self.text), bool)
        hit[keys.position] = reply[keys.number]
        return keys, hit

    def around(self, hit: np.ndarray, window: int, block: int) -> np.ndarray:
        """Starts of windows that hold an anchor."""
        sums = np.concatenate([[0], np.cumsum(hit)])
        reach = np.minimum(np.arange(len(hit)) + window - block + 1, len(hit))
        return sums[reach] > sums[:-1]

    def owners(self, keys: Keys) -> np.ndarray:
        """Smallest id holding each key; occurrences are in the order of ids already."""
        return self.ids[self.text[keys.position[keys.first]]]


def _rows(keys: np.ndarray, shards: int, chunk: int, extra: np.ndarray, marks: np.ndarray) -> pa.Table:
    bounds = shard_bounds(keys, shards)
    spans = [(s, a, b) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return pa.table({
        "shard": pa.array([s for s, _, _ in spans], pa.int32()),
        "chunk": pa.array([chunk] * len(spans), pa.int32()),
        "size": pa.array([b - a for _, a, b in spans], pa.int64()),
        "keys": pa.array([pack_sorted(keys[a:b]) for _, a, b in spans], pa.binary()),
        "extra": pa.array([pack(extra[a:b]) if len(extra) else b"" for _, a, b in spans], pa.binary()),
        "marks": pa.array([pack_flags(marks[2 * a:2 * b]) if len(marks) else b"" for _, a, b in spans], pa.binary()),
    })


def _reply(table: pa.Table, number: int, marks: np.ndarray) -> pa.Table:
    """One answer per request of a shard's group, from the marks of all its keys in request order."""
    sizes = table["size"].to_numpy()
    ends = np.cumsum(sizes)
    return pa.table({
        "chunk": table["chunk"], "round": pa.array([number] * len(table), pa.int32()), "shard": table["shard"],
        "size": table["size"],
        "marks": pa.array([pack_flags(marks[e - n:e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()),
    })


def _answered(replies: pa.Table, number: int) -> np.ndarray:
    """Answers of a round for all keys of a chunk in key order."""
    rows = sorted((r["shard"], r["size"], r["marks"]) for r in replies.to_pylist() if r["round"] == number)
    return np.concatenate([unpack_flags(m, n) for _, n, m in rows]) if rows else np.empty(0, bool)


def _all_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all requests, their order, and the run number of each key in that order."""
    keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    return keys, order, groups(keys[order])[1]


def find_anchors(table: pa.Table) -> pa.Table:
    """Shard side of round 1: keys indexed as a block and held by two documents or more."""
    keys, order, run = _all_keys(table)
    flags = [unpack_flags(m, 2 * n).reshape(-1, 2) for m, n in zip(
        table["marks"].to_pylist(), table["size"].to_pylist(), strict=True)]
    several, block = np.concatenate(flags).T
    docs = np.bincount(run, weights=1.0 + several[order])
    indexed = np.bincount(run, weights=block[order])
    marks = np.empty(len(keys), bool)
    marks[order] = ((docs >= 2) & (indexed > 0))[run]
    return _reply(table, 1, marks)


def find_owners(table: pa.Table) -> pa.Table:
    """Shard side of round 2: keys that a smaller document of another chunk holds."""
    keys, order, run = _all_keys(table)
    owner = np.concatenate([unpack(x) for x in table["extra"].to_pylist()]).view(np.int64)
    least = np.full(run[-1] + 1 if len(run) else 0, 2**63 - 1)
    np.minimum.at(least, run, owner[order])
    marks = np.empty(len(keys), bool)
    marks[order] = owner[order] > least[run]
    return _reply(table, 2, marks)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **sizes: int,
) -> DataFrame:
    """One row per document: key, n_words, n_removed, the kept words and the repeats found in it.

    A word goes when a window of ``window`` words around it also starts in a document with a smaller
    key; ``repeats`` are the maximal runs of such words (word numbers, end exclusive), judged on the
    input. Null or empty text has no words. A null key counts as smaller than any other; rows
    sharing a key count as one document when compared and keep a row each. Other columns are ignored.
    """
    block = (window + 1) // 2
    layout = lay_out(docs, key, text, **sizes)
    shards = layout.shards

    def probe(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        keys = chunk.keys(block, ANCHOR_BITS)
        place = chunk.place[chunk.text[keys.position]]
        last = np.concatenate([keys.first[1:], [len(place)]]) - 1
        several = place[last] != place[keys.first] if len(place) else np.empty(0, bool)
        own = np.bincount(keys.number, weights=chunk.blocks(block)[keys.position]) > 0
        return _rows(keys.distinct, shards, table["chunk"][0].as_py(), np.empty(0), np.stack([several, own], 1).ravel())

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _rows(np.empty(0, np.uint64), shards, 0, np.empty(0), np.empty(0))
        chunk = Chunk(table)
        _, hit = chunk.anchors(block, _answered(replies, 1))
        keys = chunk.keys(window, 64, chunk.around(hit, window, block))
        return _rows(keys.distinct, shards, table["chunk"][0].as_py(), chunk.owners(keys).view(np.uint64), np.empty(0))

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _result([], [], [], [], [])
        chunk = Chunk(table)
        count = len(chunk.text)
        gone = np.zeros(count, bool)
        if len(replies):
            _, hit = chunk.anchors(block, _answered(replies, 1))
            keys = chunk.keys(window, 64, chunk.around(hit, window, block))
            marks = _answered(replies, 2)
            if len(marks):
                later = chunk.ids[chunk.text[keys.position]] > chunk.owners(keys)[keys.number]
                starts = keys.position[marks[keys.number] | later]
                edges = np.zeros(count + window + 1, np.int64)
                edges[starts] += 1
                edges[starts + window] -= 1
                gone = np.cumsum(edges)[:count] > 0
        return _cut(chunk, gone)

    first = layout.deal(layout.ask(probe, ASK).groupBy("shard").applyInArrow(find_anchors, REPLY))
    second = layout.deal(
        layout.ask(extend, ASK, first).groupBy("shard").applyInArrow(find_owners, REPLY))
    done = layout.ask(finish, RESULT, first.unionByName(second))
    return done if key == "doc_id" else done.withColumnRenamed("doc_id", key)


def _result(ids: list, words: list, removed: list, kept: list, repeats: list) -> pa.Table:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()),
        "repeats": pa.array(repeats, pa.list_(span)),
    })


def _cut(chunk: Chunk, gone: np.ndarray) -> pa.Table:
    """Result rows of a chunk given the words that go."""
    first, raw = chunk.words.first, column(chunk.table, "raw").to_pylist()
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[first[1:]] - before[first[:-1]]
    kept, repeats = [], []
    for d, text in enumerate(raw):
        words = (text or b"").split()
        if not removed[d]:
            kept.append(b" ".join(words).decode())
            repeats.append([])
            continue
        out = gone[first[d]:first[d + 1]]
        kept.append(b" ".join([words[i] for i in np.flatnonzero(~out).tolist()]).decode())
        edge = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
        spans = zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)
        repeats.append([{"start": a, "stop": b} for a, b in spans])
    ids = [None if i == NO_ID else i for i in chunk.ids.tolist()]
    return _result(ids, np.diff(first).tolist(), removed.tolist(), kept, repeats)


def digest(rows: DataFrame) -> DataFrame:
    """The kept words of each document as a digest."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
