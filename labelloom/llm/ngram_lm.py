"""Trigram language model in sharded Elias-Fano tries, trained and queried by the same chunks.

Two rounds between chunks of documents and shards:

1. Words: every chunk sends its distinct words with their training counts; shards answer the counts
   over all training documents and number the words.
2. Trigrams (u, v, w): every chunk sends its distinct trigrams to the shard of their middle word v.
   A frequent v is salted by w, so that no shard holds more than its part of v's successors. Shards
   build a trie from the training counts and answer every trigram from it.

A trie has the middle words, below each its successors w and its predecessors u, and below each
(v, u) the words that followed. Those are stored *relative to the context*: as places among v's
successors, which are small numbers. All levels are Elias-Fano coded monotone sequences with
pointers of the same kind; probabilities are 16-bit codes of a logarithm. A level is a byte string
that is read in place and searched for successors, never expanded.

Smoothing is hierarchical (Dirichlet): with c training counts,
P(w) = (c(w) + 1) / (N + V + 1), P(w | v) = (c(vw) + s2 P(w)) / (c(v) + s2),
P(w | u v) = (c(uvw) + s3 P(w | v)) / (c(uv) + s3).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm import words as W
from labelloom.llm.chunks import NO_ID, by_id, column, lay_out
from labelloom.llm.packing import groups, pack, pack_sorted, shard_bounds, unpack, unpack_sorted

FOLDS, HELD_FOLD = 7, 2
STRENGTH_2, STRENGTH_3 = 300.0, 5.0
SPLIT = 250_000
SHARD_BYTES = 6 << 20
END = np.uint64(0x6A09E667F3BCC908)
#: Codes 1 .. 65535 cover log10 values from LEAST to 0; 0 says absent.
LEAST = -12.0

ASK_WORDS = "shard int, chunk int, size long, keys binary, counts binary"
TOLD_WORDS = "chunk int, shard int, size long, counts binary, numbers binary, tokens long, distinct long"
ASK_GRAMS = "shard int, chunk int, size long, v binary, u binary, w binary, counts binary, totals binary"
TOLD_GRAMS = "chunk int, shard int, size long, second binary, third binary"
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


class EliasFano:
    """A monotone sequence below ``universe``: packed low bits and a unary coded high part.

    Stored as one byte string; ``find`` locates values by searching the few entries that share their
    high part.
    """

    def __init__(self, count: int, universe: int, raw: bytes):
        self.count = count
        self.low_bits = low_bits(count, universe)
        n_low = -(-count * self.low_bits // 64) + 1
        self.lows = np.frombuffer(raw, np.uint64, n_low)
        bits = np.frombuffer(raw, np.uint8, offset=8 * n_low)
        # Directory: how many entries lie before each high part.
        marks = np.unpackbits(bits)
        zeros = np.flatnonzero(marks == 0)
        self.before = np.concatenate([[0], zeros - np.arange(len(zeros))])

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        bits = low_bits(len(values), universe)
        values = values.astype(np.uint64)
        lows = np.zeros(-(-len(values) * bits // 64) + 1, np.uint64)
        if bits:
            at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            low = values & np.uint64(2**bits - 1)
            np.bitwise_or.at(lows, word, low << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(lows, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(bits)).astype(np.int64)
        marks = np.zeros(len(values) + (universe >> bits) + 2, bool)
        marks[high + np.arange(len(values))] = True
        return lows.tobytes() + np.packbits(marks).tobytes()

    def low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        rest = np.where(shift > 0, self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.lows[word] >> shift) | rest) & np.uint64(2**self.low_bits - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it does not occur."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        wanted = values & np.uint64(2**self.low_bits - 1)
        lo, hi = self.before[high], self.before[high + 1]
        stop = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.low(mid) < wanted[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = np.full(len(values), -1)
        inside = np.flatnonzero(lo < stop)
        same = self.low(lo[inside]) == wanted[inside]
        found[inside[same]] = lo[inside[same]]
        return found


def low_bits(count: int, universe: int) -> int:
    return max((universe // max(count, 1)).bit_length() - 1, 0)


def quantise(probability: np.ndarray) -> np.ndarray:
    code = np.rint((np.log10(probability) - LEAST) / -LEAST * 65534) + 1
    return np.clip(code, 1, 65535).astype(np.uint16)


#: Probability of every code; absent gives zero.
RESTORED = np.concatenate([[0.0], 10.0 ** (np.arange(65535) / 65534 * -LEAST + LEAST)])


class Level:
    """Children of the nodes above: keys ascending below each parent, as one monotone sequence."""

    def __init__(self, parent: np.ndarray, key: np.ndarray, parents: int, codes: np.ndarray | None = None):
        self.width = int(key.max()) + 1 if len(key) else 1
        self.parents = parents
        self.raw = EliasFano.encode(parent * self.width + key, parents * self.width)
        # Where each parent's children begin.
        self.pointers = EliasFano.encode(np.searchsorted(parent, np.arange(parents + 1)), len(key) + 1)
        self.keys = EliasFano(len(key), parents * self.width, self.raw)
        self.codes = codes

    def find(self, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Node of (parent, key); -1 without such a child or parent."""
        known = np.flatnonzero((parent >= 0) & (key >= 0) & (key < self.width))
        out = np.full(len(parent), -1)
        out[known] = self.keys.find(parent[known] * self.width + key[known])
        return out

    def size(self) -> int:
        return len(self.raw) + len(self.pointers) + (self.codes.nbytes if self.codes is not None else 0)


class Trie:
    """Trigrams with counts below their middle words, from distinct rows ordered by (v, u, w)."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, total: np.ndarray,
                 strength: float):
        """``total`` is the training count of each row's middle word."""
        first, parent = groups(v)
        self.middles = Level(np.zeros(len(first), np.int64), v[first], 1)
        middles = len(first)
        order = np.argsort(joined(parent, w), kind="stable")
        first, run = groups2(parent[order], w[order])
        pair_count = np.bincount(run, weights=count[order])
        at = order[first]
        self.strength = strength
        self.successors = Level(parent[at], w[at], middles, quantise(pair_count / (total[at] + strength)))
        begin = np.searchsorted(parent[at], np.arange(middles))
        rank, share = np.empty(len(v), np.int64), np.empty(len(v))
        rank[order] = run - begin[parent[order]]
        share[order] = count[order] / pair_count[run]
        # Places among the successors ascend like the words do, so the rows are in order already.
        first, run = groups2(parent, u)
        self.contexts = Level(parent[first], u[first], middles)
        self.follow = Level(run, rank, len(first), quantise(share))
        self.begin = begin

    def query(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(vw) and c(uvw) as the stored c(vw) / (c(v) + s2) and c(uvw) / c(vw) tell them; 0 where unseen.

        Counts are sent rather than codes as small whole numbers pack better.
        """
        parent = self.middles.find(np.zeros(len(v), np.int64), v)
        pair = self.successors.find(parent, w)
        second = np.rint(np.where(pair >= 0, RESTORED[self.successors.codes[pair]], 0.0) * (total + self.strength))
        rank = np.where(pair >= 0, pair - self.begin[parent], -1)
        triple = self.follow.find(self.contexts.find(parent, u), rank)
        third = np.rint(np.where(triple >= 0, RESTORED[self.follow.codes[triple]], 0.0) * second)
        return second.astype(np.int64), third.astype(np.int64)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of numbers below 2**32 as one sortable number."""
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def groups2(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``groups`` for ordered pairs."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


class Chunk:
    """Tokens of a chunk: lower-cased words of each text, then its end."""

    def __init__(self, table: pa.Table):
        self.table, self.ids, _ = by_id(table)
        self.number = table["chunk"][0].as_py()
        data, offsets = W.buffers(column(self.table, "raw"))
        words = W.split_words(data, offsets)
        self.keys = np.insert(W.word_hashes(data, words, W.LOWER), words.first[1:], END)
        self.first = words.first + np.arange(len(words.first))
        self.held = np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS == HELD_FOLD
                              for i in self.ids.tolist()], bool)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.train = ~self.held[self.doc]
        self.distinct, self.word = np.unique(self.keys, return_inverse=True)

    def ask_words(self, shards: int) -> pa.Table:
        counts = np.bincount(self.word[self.train], minlength=len(self.distinct))
        bounds = shard_bounds(self.distinct, shards)
        spans = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({
            "shard": pa.array(range(shards), pa.int32()), "chunk": pa.array([self.number] * shards, pa.int32()),
            "size": pa.array([x.stop - x.start for x in spans], pa.int64()),
            "keys": pa.array([pack_sorted(self.distinct[x]) for x in spans], pa.binary()),
            "counts": pa.array([pack(counts[x]) for x in spans], pa.binary()),
        })

    def learn_words(self, told: pa.Table) -> None:
        rows = sorted(told.to_pylist(), key=lambda r: r["shard"])
        counts = np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64)
        numbers = np.concatenate([unpack(r["numbers"]) for r in rows]).astype(np.int64)
        self.tokens, self.vocabulary = sum(r["tokens"] for r in rows), sum(r["distinct"] for r in rows)
        self.count, self.id = counts[self.word], numbers[self.word]
        self.starts = int(counts[np.searchsorted(self.distinct, END)])

    def grams(self, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct trigrams by (shard, v, u, w): shard, v, u, w, c(v), training count; and each token's number."""
        begin = self.first[:-1]
        v, u = (np.concatenate([np.zeros(k, np.int64), self.id[:-k]])[:len(self.id)] for k in (1, 2))
        total = np.concatenate([[0], self.count[:-1]])
        v[begin] = u[begin] = 0
        total[begin] = self.starts
        second = begin + 1
        u[second[second < self.first[1:]]] = 0
        salts = (total // SPLIT + 1).astype(np.uint64)
        spot = W.mix(v.astype(np.uint64) * np.uint64(W.GOLDEN) + W.mix(self.id.astype(np.uint64)) % salts)
        shard = ((spot >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((joined(u, self.id), joined(shard, v)))
        ordered = [x[order] for x in (shard, v, u, self.id, total)]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in ordered[1:4]], axis=0)
        at = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        counts = np.bincount(number[self.train], minlength=len(at))
        return (*[x[at] for x in ordered], counts, number)

    def ask_grams(self, shards: int) -> pa.Table:
        shard, v, u, w, total, counts, _ = self.grams(shards)
        bounds = np.searchsorted(shard, np.arange(shards + 1))
        spans = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.table({
            "shard": pa.array([s for s, _ in spans], pa.int32()), "chunk": pa.array([self.number] * len(spans), pa.int32()),
            "size": pa.array([x.stop - x.start for _, x in spans], pa.int64()),
            "v": pa.array([pack_sorted(v[x].astype(np.uint64)) for _, x in spans], pa.binary()),
            "u": pa.array([pack(u[x]) for _, x in spans], pa.binary()),
            "w": pa.array([pack(w[x]) for _, x in spans], pa.binary()),
            "counts": pa.array([pack(counts[x]) for _, x in spans], pa.binary()),
            "totals": pa.array([pack(total[x][groups(v[x])[0]]) for _, x in spans], pa.binary()),
        })

    def scores(self, told: pa.Table, shards: int, s2: float, s3: float) -> pa.Table:
        number = self.grams(shards)[-1]
        rows = sorted(told.to_pylist(), key=lambda r: r["shard"])
        pair, triple = (np.concatenate([unpack(r[c]) for r in rows])[number].astype(float) for c in ("second", "third"))
        begin = self.first[:-1]
        before = np.concatenate([[0], self.count[:-1]])
        before[begin] = self.starts
        context = np.concatenate([[0.0], pair[:-1]])
        context[begin] = self.starts
        p1 = (self.count + 1) / (self.tokens + self.vocabulary + 1)
        p2 = (pair + s2 * p1) / (before + s2)
        p3 = (triple + s3 * p2) / (context + s3)
        known = np.add.reduceat((self.count > 0).astype(np.int64), begin)
        n = len(self.ids)
        return pa.table({
            "doc_id": self.table["doc_id"], "held_out": pa.array(self.held), "n_tokens": pa.array(np.diff(self.first)),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, self.tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(p1), begin)),
            "score": pa.array(np.add.reduceat(np.log10(p3), begin)),
        })


def answer_words(table: pa.Table, shards: int) -> pa.Table:
    """Shard side of round 1: training counts over all chunks and a number for every word."""
    shard = table["shard"][0].as_py()
    sizes = table["size"].to_pylist()
    keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
    counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    _, run = groups(keys[order])
    total = np.bincount(run, weights=counts[order]).astype(np.int64)
    which = np.empty(len(keys), np.int64)
    which[order] = run
    ends = np.cumsum(sizes)
    spans = [slice(e - n, e) for n, e in zip(sizes, ends, strict=True)]
    return pa.table({
        "chunk": table["chunk"], "shard": table["shard"], "size": table["size"],
        "counts": pa.array([pack(total[which[x]]) for x in spans], pa.binary()),
        "numbers": pa.array([pack(which[x] * shards + shard + 1) for x in spans], pa.binary()),
        "tokens": pa.array([int(total.sum())] * len(sizes), pa.int64()),
        "distinct": pa.array([int((total > 0).sum())] * len(sizes), pa.int64()),
    })


def answer_grams(table: pa.Table, strength: float) -> pa.Table:
    """Shard side of round 2: a trie of the training trigrams, and its codes for every request."""
    rows = table.to_pylist()
    parts = []
    for r in rows:
        v = unpack_sorted(r["v"]).astype(np.int64)
        parts.append((v, unpack(r["u"]).astype(np.int64), unpack(r["w"]).astype(np.int64),
                      unpack(r["counts"]).astype(np.int64), unpack(r["totals"]).astype(np.int64)[groups(v)[1]]))
    v, u, w, count, total = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    seen = np.flatnonzero(count)
    order = seen[np.lexsort((joined(u[seen], w[seen]), v[seen]))]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (v, u, w)], axis=0)
    sums = np.bincount(np.cumsum(new) - 1, weights=count[order])
    at = order[new]
    if len(at):
        second, third = Trie(v[at], u[at], w[at], sums, total[at], strength).query(v, u, w, total)
    else:
        second = third = np.zeros(len(v), np.int64)
    ends = np.cumsum([r["size"] for r in rows])
    spans = [slice(e - r["size"], e) for r, e in zip(rows, ends, strict=True)]
    return pa.table({
        "chunk": table["chunk"], "shard": table["shard"], "size": table["size"],
        "second": pa.array([pack(second[x]) for x in spans], pa.binary()),
        "third": pa.array([pack(third[x]) for x in spans], pa.binary()),
    })


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", s2: float = STRENGTH_2, s3: float = STRENGTH_3,
    shard_bytes: int = SHARD_BYTES, **sizes: int,
) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A text's tokens are its words, A-Z lower-cased, and its end. Documents whose crc32 of the key as
    text leaves HELD_FOLD modulo FOLDS are held out; the model learns from all others. Scores are log10
    probabilities. Null or empty text is its end alone; a null key trains and counts as empty text
    for the fold; repeated rows train as often as they occur. Other columns are ignored.
    """
    layout = lay_out(docs, key, text, shard_bytes=shard_bytes, **sizes)
    shards = layout.shards

    def ask(table: pa.Table) -> pa.Table:
        return Chunk(table).ask_words(shards)

    def ask_again(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        chunk.learn_words(told)
        return chunk.ask_grams(shards)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        grams = told.column("second").is_valid()
        chunk.learn_words(told.filter(told.column("numbers").is_valid()))
        return chunk.scores(told.filter(grams), shards, s2, s3)

    words = layout.deal(layout.ask(ask, ASK_WORDS).groupBy("shard").applyInArrow(
        lambda t: answer_words(t, shards), TOLD_WORDS))
    grams = layout.deal(layout.ask(ask_again, ASK_GRAMS, words).groupBy("shard").applyInArrow(
        lambda t: answer_grams(t, s2), TOLD_GRAMS))
    done = layout.ask(finish, RESULT, words.unionByName(grams, allowMissingColumns=True))
    return done if key == "doc_id" else done.withColumnRenamed("doc_id", key)
