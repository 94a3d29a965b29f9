"""Removal of lines that many documents share, by a sharded minimal perfect hash.

A line's key is 128 bits of hash. Chunks of documents send each shard their distinct keys with the
number of documents (saturating), the ids that are dealt to several chunks and the largest id holding
them. Every shard builds a minimal
perfect hash over its distinct keys; it indexes three arrays: fingerprints, document counts and
largest ids. Documents then probe those arrays with packed keys and get one bit per key back; lines
are never joined. ``build_index`` returns the shards as rows, so an index can be kept and probed
again; a foreign line is recognised by its fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelloom.llm.chunks import NO_ID, Layout, by_id, column, lay_out
from labelloom.llm.packing import (
    groups, pack, pack_flags, pack_sorted, shard_bounds, unpack, unpack_flags, unpack_sorted,
)
from labelloom.llm.words import mix

MIN_CHARS = 20
MIN_DOCS = 3

ASK = "shard int, chunk int, size long, keys binary, checks binary, docs binary, last binary, held binary, ids binary"
INDEX = "shard int, size long, levels array<binary>, fingerprints binary, docs binary, last binary"
REPLY = "chunk int, shard int, size long, marks binary"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of bit arrays and a rank over them.

    A level keeps the keys that are alone in their cell; the others go to the next, smaller level.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(x.sum()) for x in levels]
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 + sum(counts[:i]) for i, x in enumerate(levels)]
        self.size = sum(counts)

    @staticmethod
    def cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return mix(keys + np.uint64((level + 1) * 0xA24BAED4963EE407 & (2**64 - 1))) % np.uint64(cells)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            cells = 2 * len(keys)
            at = cls.cell(keys, len(levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were never built in, any slot for the others."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.cell(keys[todo], level, len(bits))
            found = bits[at]
            out[todo[found]] = ranks[at[found]]
            todo = todo[~found]
        return out


class ChunkLines:
    """Long line keys of a chunk: distinct (key, check) pairs, their documents and largest id."""

    def __init__(self, table: pa.Table, min_chars: int):
        ordered, self.ids, self.place = by_id(table)
        self.lines = [(raw or b"").split(b"\n") for raw in column(ordered, "raw").to_pylist()]
        hashes, row = [], []
        for d, lines in enumerate(self.lines):
            for line in lines:
                key = line.strip().lower()
                if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                    hashes.append(xxhash.xxh3_128_digest(key))
                else:
                    hashes.append(None)
            row.append(len(lines))
        long = np.array([h is not None for h in hashes], bool)
        pairs = np.frombuffer(b"".join(h for h in hashes if h is not None), ">u8").reshape(-1, 2)
        key, check = pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64)
        doc = np.repeat(np.arange(len(row)), row)
        order = np.lexsort((check, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        self.key, self.check = key[order][first], check[order][first]
        self.doc = doc
        self.number = np.full(len(hashes), -1)
        at = np.flatnonzero(long)
        self.number[at[order]] = number
        # Documents are in the order of their ids: count the distinct ones and take the largest per key.
        owner = self.place[doc[at]][order] if len(at) else np.empty(0, np.int64)
        pair = np.unique(np.stack([number, owner]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        # Ids that other chunks may hold as well are named, for the shard to count them once.
        ids = self.ids[np.concatenate([[0], np.flatnonzero(np.diff(self.place)) + 1])] if len(self.ids) else self.ids
        split = np.zeros(len(ids), bool)
        split[self.place] = column(ordered, "split").to_numpy(zero_copy_only=False)
        named = split[pair[1]]
        self.docs = np.bincount(pair[0][~named], minlength=len(first))
        self.held = np.bincount(pair[0][named], minlength=len(first))
        self.named = ids[pair[1][named]]
        self.begin = np.concatenate([[0], np.cumsum(self.held)])
        self.last = np.full(len(first), NO_ID)
        np.maximum.at(self.last, number, self.ids[doc[at]][order])


def _requests(table: pa.Table, shards: int, min_chars: int) -> pa.Table:
    lines = ChunkLines(table, min_chars)
    bounds = shard_bounds(lines.key, shards)
    spans = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return pa.table({
        "shard": pa.array([s for s, _ in spans], pa.int32()),
        "chunk": pa.array([table["chunk"][0].as_py()] * len(spans), pa.int32()),
        "size": pa.array([x.stop - x.start for _, x in spans], pa.int64()),
        "keys": pa.array([pack_sorted(lines.key[x]) for _, x in spans], pa.binary()),
        "checks": pa.array([pack(lines.check[x]) for _, x in spans], pa.binary()),
        "docs": pa.array([pack(lines.docs[x]) for _, x in spans], pa.binary()),
        "last": pa.array([pack(lines.last[x].view(np.uint64)) for _, x in spans], pa.binary()),
        "held": pa.array([pack(lines.held[x]) for _, x in spans], pa.binary()),
        "ids": pa.array([pack(lines.named[lines.begin[x.start]:lines.begin[x.stop]].view(np.uint64)) for _, x in spans],
                        pa.binary()),
    })


def _joined(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Both halves of a key in one 64-bit word, so that equal first halves still differ."""
    return mix(keys ^ mix(checks))


def build_shard(table: pa.Table) -> pa.Table:
    """Index of one shard over the distinct keys of all requests."""
    keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
    checks = np.concatenate([unpack(x) for x in table["checks"].to_pylist()])
    docs = np.concatenate([unpack(x) for x in table["docs"].to_pylist()]).astype(np.int64)
    last = np.concatenate([unpack(x) for x in table["last"].to_pylist()]).view(np.int64)
    joined = _joined(keys, checks)
    order = np.argsort(joined, kind="stable")
    first, run = groups(joined[order])
    distinct = joined[order][first]
    count = np.bincount(run, weights=docs[order]).astype(np.int64)
    which = np.empty(len(keys), np.int64)
    which[order] = run
    which = np.repeat(which, np.concatenate([unpack(x) for x in table["held"].to_pylist()]).astype(np.int64))
    ids = np.concatenate([unpack(x) for x in table["ids"].to_pylist()]).view(np.int64)
    place = np.lexsort((ids, which))
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(which[place]) != 0) | (np.diff(ids[place]) != 0)
    count += np.bincount(which[place][new], minlength=len(first))
    largest = np.full(len(first), NO_ID)
    np.maximum.at(largest, run, last[order])
    perfect = PerfectHash.build(distinct)
    slot = perfect.slots(distinct)
    fingerprints, counts, lasts = (np.empty(len(distinct), t) for t in (np.uint32, np.uint32, np.int64))
    fingerprints[slot] = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    counts[slot] = np.minimum(count, 2**32 - 1)
    lasts[slot] = largest
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "size": pa.array([len(distinct)], pa.int64()),
        "levels": pa.array([[np.packbits(x).tobytes() for x in perfect.levels]], pa.list_(pa.binary())),
        "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
        "docs": pa.array([counts.tobytes()], pa.binary()), "last": pa.array([lasts.tobytes()], pa.binary()),
    })


class IndexShard:
    """The arrays of a stored shard, ready to be probed."""

    def __init__(self, row: dict):
        levels, rest = [], row["size"]
        for raw in row["levels"]:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * rest).astype(bool))
            rest -= int(levels[-1].sum())
        self.perfect = PerfectHash(levels)
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint32)
        self.docs = np.frombuffer(row["docs"], np.uint32)
        self.last = np.frombuffer(row["last"], np.int64)

    def probe(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0 when unknown) and largest id of each key."""
        slot = self.perfect.slots(joined)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == (joined[known] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        docs, last = np.zeros(len(joined), np.int64), np.full(len(joined), NO_ID)
        docs[known], last[known] = self.docs[slot[known]], self.last[slot[known]]
        return docs, last


def build_index(layout: Layout, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Packed requests of all chunks, and the index: one row per shard."""
    shards = layout.shards
    asked = layout.ask(lambda t: _requests(t, shards, min_chars), ASK).repartition(shards, "shard")
    return asked, asked.groupBy("shard").applyInArrow(build_shard, INDEX)


def drop_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    more: tuple[str, ...] = (), **sizes: int,
) -> DataFrame:
    """One row per document: key, n_lines, n_dropped and the kept lines joined by a line feed.

    Lines whose key (blanks stripped at both ends, A-Z lower-cased) has ``min_chars`` code points and
    is found in ``min_docs`` documents go, except in the document with the largest key holding them.
    Null or empty text is one empty line. A null key counts as the smallest; rows sharing a key
    count as one document and keep a row each. ``more`` names columns to carry along, which must not
    be named like the results or ``chunk``, ``split``, ``large_id``, ``row place`` or ``raw``.
    """
    layout = lay_out(docs, key, text, more, **sizes)
    asked, index = build_index(layout, min_chars)
    own = [StructField(n, t) for n, t in (("doc_id", LongType()), ("n_lines", LongType()), ("n_dropped", LongType()),
                                          ("kept", StringType()))]
    schema = StructType([*own, *[docs.schema[c] for c in more]])

    def probe(requests: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(requests):
            return pa.table({"chunk": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()),
                             "size": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        arrays = IndexShard(shard.to_pylist()[0])
        marks = []
        for r in requests.to_pylist():
            found, last = arrays.probe(_joined(unpack_sorted(r["keys"]), unpack(r["checks"])))
            common = found >= min_docs
            here = unpack(r["last"]).view(np.int64) == last
            marks.append(pack_flags(np.stack([common, here], 1).ravel()))
        return pa.table({"chunk": requests["chunk"], "shard": requests["shard"], "size": requests["size"],
                         "marks": pa.array(marks, pa.binary())})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        lines = ChunkLines(table, min_chars)
        ordered, _, _ = by_id(table)
        rows = sorted((r["shard"], r["size"], r["marks"]) for r in replies.to_pylist())
        marks = [unpack_flags(m, 2 * n).reshape(-1, 2) for _, n, m in rows]
        common, here = np.concatenate(marks).T if marks else np.zeros((2, 0), bool)
        gone = np.zeros(len(lines.number), bool)
        keyed = lines.number >= 0
        at = lines.number[keyed]
        last_here = here[at] & (lines.ids[lines.doc[keyed]] == lines.last[at])
        gone[keyed] = common[at] & ~last_here
        first = np.concatenate([[0], np.cumsum([len(x) for x in lines.lines])]).astype(np.int64)
        kept, dropped = [], []
        for d, parts in enumerate(lines.lines):
            out = gone[first[d]:first[d + 1]]
            dropped.append(int(out.sum()))
            kept.append(b"\n".join([x for x, o in zip(parts, out.tolist(), strict=True) if not o]).decode())
        return pa.table({
            "doc_id": ordered["doc_id"], "n_lines": pa.array(np.diff(first), pa.int64()),
            "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.string()),
            **{c: ordered[c] for c in more},
        })

    replies = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, REPLY)
    done = layout.ask(finish, schema, layout.deal(replies))
    return done if key == "doc_id" else done.withColumnRenamed("doc_id", key)


def digest(rows: DataFrame) -> DataFrame:
    """The kept lines of each document as a digest."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
