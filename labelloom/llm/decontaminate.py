"""Benchmark decontamination: a prefix-filtered set join of item windows against documents.

A window is a set of shingles that must all occur in a document for the window to occur, so one
shingle, its *prefix token*, is enough to find candidates. Shingles are ordered by how rare they are
in all documents, counted first; the rarest one of each window is its prefix token. A document
position holding a prefix token fixes where the window would begin, which bounds its place (not
before the text's first word) and length (not beyond its last). What remains is verified word by
word over the window's own length.

Items come in blocks of bounded size; each block is one narrow pass over the documents. Nothing of
the documents is shuffled but counts of item shingles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField

from labelloom.llm import words as W
from labelloom.llm.shipping import ship
from labelloom.session import cut_lineage

WINDOW = 10
SHINGLE = 5
BLOCK_WORDS = 2_000_000
SIEVE_BITS = 20

FOUND = ArrayType(StringType())
MARK, ITEMS, COUNT = "decontamination_hits", "decontamination_items", "decontamination_words"


def item_words(text: str | None) -> tuple[bytes, ...]:
    """Lower-cased words of one text."""
    table = bytes(int(c) if inside else 0x20 for c, inside in zip(W.LOWER, W.ALPHANUMERIC, strict=True))
    return tuple((text or "").encode().translate(table).split())


def hashes_of(windows: list[tuple[bytes, ...]]) -> list[np.ndarray]:
    """Word hashes of word lists, as the documents' words get them."""
    flat = [w for words in windows for w in words]
    data = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.cumsum([len(w) for w in flat], dtype=np.int64)
    starts = ends - np.array([len(w) for w in flat], np.int64)
    hashed = W.word_hashes(data, W.Words(starts, ends, np.array([0, len(flat)])))
    return np.split(hashed, np.cumsum([len(w) for w in windows])[:-1]) if windows else []


class Block:
    """Distinct windows of some items with their shingles."""

    def __init__(self, items: list[tuple[str | None, tuple[bytes, ...]]], window: int, shingle: int):
        self.items_of: dict[tuple[bytes, ...], list[str | None]] = defaultdict(list)
        for item, words in items:
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                self.items_of[words[i:i + window]].append(item)
        self.windows = list(self.items_of)
        self.shingles = []
        for words, hashed in zip(self.windows, hashes_of(self.windows), strict=True):
            width = min(shingle, len(words))
            self.shingles.append((width, W.window_hashes(hashed, width)[:len(words) - width + 1].tolist()))

    def by_width(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = defaultdict(set)
        for width, hashed in self.shingles:
            out[width].update(hashed)
        return out

    def prefix_index(self, counts: dict[int, int]) -> PrefixIndex:
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (width, hashed) in enumerate(self.shingles):
            at = min(range(len(hashed)), key=lambda i: (counts.get(hashed[i], 0), hashed[i]))
            found[width][hashed[at]].append((number, at))
        return PrefixIndex(found, self.windows, [sorted({i for i in self.items_of[w] if i is not None}) for w in self.windows])


class Sieve:
    """A sorted set of hashes behind a bit table that most other hashes fail."""

    def __init__(self, hashes: list[int]):
        self.sorted = np.array(sorted(hashes), np.uint64)
        self.bits = np.zeros(1 << SIEVE_BITS, bool)
        self.bits[self._cell(self.sorted)] = True

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes in the set."""
        maybe = np.flatnonzero(self.bits[self._cell(hashes)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == hashes[maybe]]


class PrefixIndex:
    """Windows by their prefix token."""

    def __init__(self, found: dict, windows: list[tuple[bytes, ...]], items: list[list[str]]):
        self.found = {width: dict(x) for width, x in found.items()}
        self.windows, self.items = windows, items
        self.sieves = {width: Sieve(list(x)) for width, x in self.found.items()}


def shingle_positions(data, words: W.Words, sieves: dict[int, Sieve]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, positions, hashes) of shingles in the sieves, for each width."""
    hashed = W.word_hashes(data, words, W.LOWER)
    left = words.left()
    for width, sieve in sieves.items():
        rolled = W.window_hashes(hashed, width)
        at = sieve.find(rolled)
        at = at[left[at] >= width]
        yield width, at, rolled[at]


def count_shingles(docs: DataFrame, text: str, wanted: dict[int, set[int]]) -> dict[int, int]:
    """Occurrences of the wanted shingles in all documents; as many rows as wanted shingles at most."""
    shared = docs.sparkSession.sparkContext.broadcast({w: Sieve(list(x)) for w, x in wanted.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for batch in batches:
            raw = batch.column(0)
            for a, b in W.slices(raw):
                data, offsets = W.buffers(raw.slice(a, b - a))
                words = W.split_words(data, offsets, W.ALPHANUMERIC)
                for _, _, hashed in shingle_positions(data, words, shared.value):
                    for h, n in zip(*np.unique(hashed, return_counts=True), strict=True):
                        total[int(h)] += int(n)
        keys = np.array(list(total), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(list(total.values()), pa.int64())], names=["shingle", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("raw")).mapInArrow(run, "shingle long, n long")
    counted = rows.groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {r["shingle"] % 2**64: r["n"] for r in counted}


def _mark_text(raw: bytes, words: W.Words, d: int, candidates: list[tuple[int, int]], index: PrefixIndex,
               hit: np.ndarray, items: set[str]) -> None:
    """Verify candidate (first word, window) pairs in text ``d`` and note their words and items."""
    base, end = words.first[d], words.first[d + 1]
    table = bytes(W.LOWER)
    for at, number in candidates:
        window = index.windows[number]
        if at < base or at + len(window) > end:
            continue
        at_text = zip(words.start[at:at + len(window)].tolist(), words.end[at:at + len(window)].tolist(), strict=True)
        if tuple(raw[a:b].translate(table) for a, b in at_text) == window:
            hit[at - base:at - base + len(window)] = True
            items.update(index.items[number])


def mark_block(docs: DataFrame, text: str, index: PrefixIndex) -> DataFrame:
    """Add the block's hits to the hit bits, items and word count of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = docs.columns
    at_text, at_mark, at_items, at_count = (names.index(c) for c in (text, MARK, ITEMS, COUNT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(at_text).cast(pa.binary())
            for a, b in W.slices(texts):
                part = batch.slice(a, b - a)
                data, offsets = W.buffers(texts.slice(a, b - a))
                words = W.split_words(data, offsets, W.ALPHANUMERIC)
                candidates: dict[int, set[tuple[int, int]]] = defaultdict(set)
                for width, at, hashed in shingle_positions(data, words, index.sieves):
                    of = np.searchsorted(words.first, at, "right") - 1
                    for p, d, h in zip(at.tolist(), of.tolist(), hashed.tolist(), strict=True):
                        candidates[d].update((p - shift, n) for n, shift in index.found[width][h])
                marks, items = part.column(at_mark).to_pylist(), part.column(at_items).to_pylist()
                raw = data.tobytes() if candidates else b""
                counts = np.diff(words.first)
                for d, found in candidates.items():
                    size = int(counts[d])
                    hit = np.unpackbits(np.frombuffer(marks[d] or bytes(-(-size // 8)), np.uint8), count=size).astype(bool)
                    known = set(items[d] or ())
                    _mark_text(raw, words, d, sorted(found), index, hit, known)
                    if hit.any():
                        marks[d], items[d] = np.packbits(hit).tobytes(), sorted(known)
                columns = list(part.columns)
                columns[at_mark], columns[at_items] = pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))
                columns[at_count] = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, tuple[bytes, ...]]]]:
    """Items in blocks of at most ``block_words`` words (a longer item is a block of its own)."""
    block, size = [], 0
    for row in items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = item_words(row["t"])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((row["k"], words))
            size += len(words)
    if block:
        yield block


def contaminate(
    docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add n_words, n_hit, items (sorted ids as strings), hit bits and contaminated to every row.

    Words are lower-cased runs of letters, digits and characters beyond ASCII. An item of fewer words
    than a window is one window; an item without words never occurs, and one without an id marks words but
    is not named in ``items``. Null or empty documents have no words; a very long one is a batch of its own. Rows are independent, other columns pass through; those named like the
    results are replaced. Repeated item ids count once.
    """
    ship(docs.sparkSession)
    results = ("n_words", "n_hit", "items", "hit_bits", "contaminated", MARK, ITEMS, COUNT)
    kept = [c for c in docs.columns if c not in results]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    fields = [StructField(MARK, BinaryType()), StructField(ITEMS, FOUND), StructField(COUNT, LongType())]
    marked = plain.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})
    empty = Block([], window, shingle)
    blocks = 0
    for items_here in item_blocks(items, key, item_text, block_words):
        block = Block(items_here, window, shingle)
        counts = count_shingles(plain, text, block.by_width())
        marked = mark_block(cut_lineage(marked) if blocks else marked, text, block.prefix_index(counts))
        blocks += 1
    if not blocks:
        marked = mark_block(marked, text, empty.prefix_index({}))
    return _finish(marked, kept)


def _finish(marked: DataFrame, kept: list[str]) -> DataFrame:
    n_hit = F.coalesce(F.bitmap_count(F.col(MARK)), F.lit(0)).cast("long")
    return marked.select(
        *[F.col(f"`{c}`") for c in kept], F.col(COUNT).alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.col(ITEMS), F.array().cast(FOUND)).alias("items"), F.col(MARK).alias("hit_bits"),
        (n_hit > 0).cast(BooleanType()).alias("contaminated"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """Counts and a digest of the items per document."""
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
