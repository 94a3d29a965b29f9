"""BPE encoding and decoding of whole texts by tree concatenation.

A text longer than a leaf is halved in the middle, wherever that is, until leaves remain. Leaves are
encoded in parallel, then neighbours are joined up the tree: a window around each join is encoded anew
and grown on both sides until it ends where both sides agree with what lies beyond.

Within a text they agree at a *free cut*, before an ASCII blank that follows a visible character: no
pre-token and no merge reaches across one, so what lies between two is encoded the same in any text
that holds it. The window from the last free cut of the left half to the first one of the right half
is all that a join can change.

A stretch without a free cut that is longer than a leaf is a node of its own: its pre-tokens are found
first, and one that is itself longer than a leaf is halved in the same way. There the window grows until
its first and last tokens are those of the halves. A token sequence is the encoding of its text when
every pair of neighbouring tokens is the encoding of the pair's own text, and each pair of the result
then occurs in a sequence that is an encoding already.

Leaves go to the fastest exact engine: rank merging for scripts whose character classes all
libraries share, the tokenizer of the vocabulary file itself for everything else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

from labelloom.llm.shipping import ship

LEAF = 4096

# The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A free cut. Rarer kinds of white space and separators, on which libraries differ, never allow one.
CUT = re.compile(r"(?<=\S)(?=[ \t-\r])")
# Beyond Latin, Greek, Cyrillic and Armenian, releases differ in what is a letter.
SHARED_SCRIPTS = re.compile(r"[\x00-\u058f]*")


@dataclass(frozen=True)
class Node:
    """Part start .. end - 1 of a text: a leaf, or two nodes that meet at a cut."""

    start: int
    end: int
    left: Node | None = None
    right: Node | None = None
    cut: int = 0
    leaf: int | None = None


class TreeEncoder:
    """Encoder and decoder of one byte-level vocabulary; ``leaf`` characters are merged at once."""

    def __init__(self, vocabulary: str, leaf: int = LEAF):
        self.leaf = leaf
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_at = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        letters = byte_letters()
        self.bytes_of = [b""] * self.library.get_vocab_size()
        ranks = {}
        for token, i in self.library.get_vocab().items():
            plain = token not in self.special and all(c in letters for c in token)
            self.bytes_of[i] = bytes(letters[c] for c in token) if plain else token.encode()
            if plain:
                ranks[self.bytes_of[i]] = i
        if not merges_follow_ids(vocabulary):
            raise ValueError("ids of the vocabulary do not follow the order of its merges")
        self.fast = tiktoken.Encoding("text", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=self.special)
        self.size_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.pool = ThreadPoolExecutor(2)
        self.unsplit = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text (int32)."""
        leaves: list[tuple[int, int]] = []
        tree = self._halve(text, 0, len(text), leaves)
        run = self.pool.map if len(leaves) > 2 else map
        made = list(run(lambda ends: self._piece(text[ends[0]:ends[1]]), leaves))
        return self._fold(text, tree, made)

    def _halve(self, text: str, a: int, b: int, leaves: list[tuple[int, int]]) -> Node:
        """The tree over text[a:b]; its leaves are added to the list."""
        if b - a <= self.leaf:
            leaves.append((a, b))
            return Node(a, b, leaf=len(leaves) - 1)
        middle = (a + b) // 2
        low, high = self._cuts_around(text, a, b, middle)
        if high - low <= self.leaf:
            return Node(a, b, self._halve(text, a, middle, leaves), self._halve(text, middle, b, leaves), middle)
        # A long stretch without a free cut is a node, joined at the cuts around it.
        leaves.append((low, high))
        node = Node(low, high, leaf=len(leaves) - 1)
        if low > a:
            node = Node(a, high, self._halve(text, a, low, leaves), node, low)
        return Node(a, b, node, self._halve(text, high, b, leaves), high) if high < b else node

    def _cuts_around(self, text: str, a: int, b: int, middle: int) -> tuple[int, int]:
        """Last free cut from a to the middle and first one from there to b, else a and b themselves."""
        reach = 64
        while True:
            low = max(a, middle - reach)
            before = None
            for before in CUT.finditer(text, low, middle + 1):
                pass
            if before is not None and before.start() > a or low == a:
                break
            reach *= 4
        behind = CUT.search(text, middle, b)
        start = before.start() if before is not None and before.start() > a else a
        return start, behind.start() if behind else b

    def _fold(self, text: str, node: Node, made: list[np.ndarray]) -> np.ndarray:
        """Ids of a node from those of its leaves."""
        if node.leaf is not None:
            return made[node.leaf]
        left, right = self._fold(text, node.left, made), self._fold(text, node.right, made)
        low, high = self._cuts_around(text, node.start, node.end, node.cut)
        if low == node.cut or high == node.cut:
            return np.concatenate([left, right])
        keep = len(left) - self._tokens(left[::-1], text[low:node.cut])
        skip = self._tokens(right, text[node.cut:high])
        return np.concatenate([left[:keep], self._piece(text[low:high]), right[skip:]])

    def _tokens(self, ids: np.ndarray, text: str) -> int:
        """How many ids from the first on make up a text."""
        want, reach = len(text.encode()), 64
        while True:
            held = np.cumsum(self.size_of[ids[:reach]])
            if held[-1] >= want or reach >= len(ids):
                return int(np.searchsorted(held, want)) + 1
            reach *= 4

    def _piece(self, text: str) -> np.ndarray:
        if len(text) <= 2 * self.leaf:
            return self._leaf(text)
        return np.array(self.encode_long(text), "<i4")

    def _leaf(self, text: str) -> np.ndarray:
        if SHARED_SCRIPTS.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<i4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4")

    def encode_long(self, text: str) -> list[int]:
        """Text without free cuts: special tokens apart, then pre-tokens, then halves."""
        out: list[int] = []
        at = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            out += self._pre_tokens(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._pre_tokens(text[at:])

    def _pre_tokens(self, text: str) -> list[int]:
        out: list[int] = []
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text) if text else ():
            out += self.encode_unsplit(text[a:b])
        return out

    def encode_unsplit(self, text: str) -> list[int]:
        """One pre-token of any length by tree concatenation."""
        cuts = [text[i:i + self.leaf] for i in range(0, len(text), self.leaf)]
        if len(cuts) == 1:
            return self.unsplit.encode_ordinary(text)
        nodes = list(map(self.unsplit.encode_ordinary, cuts))
        while len(nodes) > 1:
            joined = list(map(self.join, nodes[:-1:2], nodes[1::2]))
            nodes = joined + nodes[len(joined) * 2:]
        return nodes[0]

    def join(self, left: Sequence[int], right: Sequence[int]) -> list[int]:
        """Encoding of the concatenation of two encoded texts."""
        reach = 4
        while True:
            a, b = max(len(left) - reach, 0), min(reach, len(right))
            window = [*left[a:], *right[:b]]
            fresh = self._again(b"".join(self.bytes_of[i] for i in window))
            if fresh is not None:
                starts = a == 0 or (fresh[0] == left[a] and len(left) - a > 1)
                ends = b == len(right) or (fresh[-1] == right[b - 1] and b > 1)
                if starts and ends and len(fresh) > 1:
                    return [*left[:a], *fresh, *right[b:]]
            if a == 0 and b == len(right):
                return fresh or []
            reach *= 2

    def _again(self, raw: bytes) -> list[int] | None:
        """Ids of bytes; None when the window cuts a character, which a wider one may not."""
        try:
            return self.unsplit.encode_ordinary(raw.decode())
        except UnicodeDecodeError:
            return None

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids, special tokens included; bytes that form no character give U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def merges_follow_ids(vocabulary: str) -> bool:
    model = json.loads(vocabulary)["model"]
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return ids == sorted(ids)


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows 255."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, leaf: int) -> TreeEncoder:
    return TreeEncoder(vocabulary, leaf)


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def share_vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file (a fixed one or two megabytes), read once and shipped to the executors."""
    ship(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return df.sparkSession.sparkContext.broadcast(text)


def encode_decode(
    docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
    leaf: int = LEAF,
) -> DataFrame:
    """Add token ids (array<int>) and the text decoded from them to every row.

    Null or empty text: no ids, empty decoded text. A very long text is halved like any other beyond
    ``leaf`` characters. Rows are independent: repeated rows and any
    other columns pass through; columns already named like the results are replaced.
    """
    shared = share_vocabulary(docs, vocabulary_path)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*source.schema, StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, leaf)
        for whole in batches:
            for batch in _slices(whole, 256):
                encoded = [encoder.encode(t or "") for t in batch.column(at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype("<i4")
                flat = np.concatenate(encoded) if encoded else np.empty(0, "<i4")
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                           pa.array([encoder.decode(e) for e in encoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, decoded])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of an array<int> column of token ids; null gives empty text."""
    shared = share_vocabulary(rows, vocabulary_path)
    kept = [c for c in rows.columns if c != decoded]
    source = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*source.schema, StructField(decoded, StringType())])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, LEAF)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], "<i4")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, decoded])

    return source.mapInArrow(run, schema)
