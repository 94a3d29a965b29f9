"""Alignment of two tokenizers' tokens over the same bytes, and how often aligned tokens meet.

Tokenizer A is a byte-level vocabulary and gets the text behind one blank; tokenizer B is a piece
vocabulary that adds the blank itself. A byte offset where a token of each ends is a shared cut.

Cuts are found by divide and conquer: in the middle of an interval of A's tokens, the end of the middle
token is looked up among B's ends by bisection; as long as they differ, each side is bisected for the
other's next end, until they meet at the cut nearest behind the middle or the interval is over. The parts
in front of the middle and behind the cut are intervals of their own; what lies between is known to be
cutless. All intervals of a batch of texts are worked on together, level by level. Tokens between
neighbouring cuts are a leaf group, and the last tokens of a group, which end together, are linked.

Counting links over the corpus shuffles one row per distinct pair and task. Counts are looked up from
broadcast slices of a fixed number of pairs, one narrow pass over the written links each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from tokenizers import Tokenizer

from labelloom.llm import words
from labelloom.llm.bpe import PRE_TOKEN, SHARED_SCRIPTS, byte_letters, merges_follow_ids, share_vocabulary
from labelloom.session import durable_dir, work_path

#: Pairs that a pass looks up: 16 bytes each on the driver and in a worker.
SLICE = 2_000_000
#: Text that is aligned at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 19
#: Distinct pairs a task holds before it passes their counts on.
HELD = 1_000_000
RESULTS = ("a_ids", "b_ids", "a_ends", "b_ends")


class ByteSide:
    """Byte-level vocabulary; strings of special tokens in a text are ordinary text."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        if not merges_follow_ids(vocabulary):
            raise ValueError("ids of the vocabulary do not follow the order of its merges")
        letters, special = byte_letters(), self.library.get_added_tokens_decoder()
        self.bytes_of = [b""] * self.library.get_vocab_size()
        ranks = {}
        for token, i in self.library.get_vocab().items():
            plain = i not in special and all(c in letters for c in token)
            self.bytes_of[i] = bytes(letters[c] for c in token) if plain else token.encode()
            if plain:
                ranks[self.bytes_of[i]] = i
        self.fast = tiktoken.Encoding("plain", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(" " + t) for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if SHARED_SCRIPTS.fullmatch(text):
            return self.fast.encode_to_numpy(text).astype(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class PieceSide:
    """Piece vocabulary with byte fallback, given as the bytes of its file."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        of = self.processor
        self.bytes_of = [
            bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace("▁", " ").encode()
            for i in range(of.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.processor.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _sides(vocabulary: str, model: bytes) -> tuple[ByteSide, PieceSide]:
    return ByteSide(vocabulary), PieceSide(model)


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A's tokens in the ranges low .. high - 1 that end where a token of B ends, ascending.

    Ends ascend strictly, and the last of B's is not before any of A's.
    """
    found = [np.empty(0, np.int64)]
    left = low < high
    low, high = low[left], high[left]
    while len(low):
        middle = (low + high) // 2
        at, cut = middle.copy(), np.full(len(low), -1)
        unsettled = np.arange(len(low))
        while len(unsettled):
            here = a_end[at[unsettled]]
            there = b_end[np.searchsorted(b_end, here)]
            meet = here == there
            cut[unsettled[meet]] = at[unsettled[meet]]
            unsettled = unsettled[~meet]
            at[unsettled] = np.searchsorted(a_end, there[~meet])
            unsettled = unsettled[at[unsettled] < high[unsettled]]
        hit = cut >= 0
        found.append(cut[hit])
        # Neighbours stay neighbours, so that the next bisections walk through memory in order.
        low = np.column_stack([low, np.where(hit, cut + 1, high)]).ravel()
        high = np.column_stack([middle, high]).ravel()
        left = low < high
        low, high = low[left], high[left]
    return np.sort(np.concatenate(found))


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def _firsts(parts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, parts)])


def align_texts(texts: list[str], a: ByteSide, b: PieceSide) -> list[pa.Array]:
    """The four results for a list of texts."""
    a_ids, b_ids = a.encode(texts), b.encode(texts)
    none = np.empty(0, np.int32)
    for n, t in enumerate(texts):
        raw = b" " + t.encode()
        if not t or any(_sizes(s)[x[n]].sum() != len(raw) or b"".join(map(s.bytes_of.__getitem__, x[n].tolist())) != raw
                        for s, x in ((a, a_ids), (b, b_ids))):
            a_ids[n] = b_ids[n] = none
    a_first, b_first = _firsts(a_ids), _firsts(b_ids)
    a_all, b_all = (np.concatenate([none, *x]) for x in (a_ids, b_ids))
    a_end, b_end = (np.cumsum(size[x]) for size, x in ((_sizes(a), a_all), (_sizes(b), b_all)))
    last = a_first[1:][np.diff(a_first) > 0] - 1
    cuts = np.sort(np.concatenate([shared_cuts(a_end, b_end, a_first[:-1], a_first[1:] - 1), last]))
    met = np.searchsorted(b_end, a_end[cuts])
    first = np.searchsorted(cuts, a_first)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    return [_lists(a_all, a_first), _lists(b_all, b_first),
            _lists(cuts + 1 - a_first[text_of], first), _lists(met + 1 - b_first[text_of], first)]


def _sizes(side: ByteSide | PieceSide) -> np.ndarray:
    if not hasattr(side, "sizes"):
        side.sizes = np.array([len(x) for x in side.bytes_of], np.int64)
    return side.sizes


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, text: str = "text") -> DataFrame:
    """Add the token ids of both sides and the groups' ends to every row.

    ``a_ends`` and ``b_ends`` say how many tokens of either side a text has up to the end of each group.
    Null and empty texts, and those whose tokens' bytes are not a blank and the text on both sides, have
    empty lists. Rows are independent: repeated rows and other columns pass through; columns named like
    the results are replaced. A very long text is a batch of its own.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*source.schema, *(StructField(n, ArrayType(IntegerType())) for n in RESULTS)])
    aligned = _aligning(source, byte_vocabulary, piece_model, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made in aligned(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*kept, *RESULTS])

    return source.mapInArrow(run, schema)


def _aligning(source: DataFrame, byte_vocabulary: str, piece_model: str, text: str):
    """A function from record batches to (part of a batch, its four results) on the executors."""
    shared = share_vocabulary(source, byte_vocabulary)
    with open(piece_model, "rb") as f:
        model = source.sparkSession.sparkContext.broadcast(f.read())
    at = source.columns.index(text)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        a, b = _sides(shared.value, model.value)
        for batch in batches:
            for i, j in words.slices(batch.column(at).cast(pa.binary()), BATCH_BYTES):
                part = batch.slice(i, j - i)
                yield part, align_texts([t or "" for t in part.column(at).to_pylist()], a, b)

    return aligned


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and firsts of a list array without nulls."""
    first = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[first[0]:first[-1]].astype(np.int64), first - first[0]


def _numerals(a_size: int, b_size: int) -> list[bytes]:
    """Decimal ids with what follows them: inside and at the end of A's half, then of B's."""
    return [b"%d%b" % (i, end) for size, ends in ((a_size, (b",", b"|")), (b_size, (b",", b";"))) for end in ends
            for i in range(size)]


def _digests(made: list[pa.Array], numeral: list[bytes], a_size: int, b_size: int) -> list[pa.Array]:
    """n_a, n_b, n_groups, groups_sha256 and links of each text from its four results."""
    (a, a_first), (b, b_first), (a_end, first), (b_end, _) = map(_flat, made)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a_last, b_last = a_end + a_first[text_of] - 1, b_end + b_first[text_of] - 1
    links = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(a[a_last] * b_size + b[b_last]))
    a_group, b_group = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    a[a_last] += a_size
    b[b_last] += b_size
    # Tokens in the order of their groups, A's half first.
    of_a = np.repeat(np.tile([True, False], len(a_group)), np.column_stack([a_group, b_group]).ravel())
    code = np.empty(len(of_a), np.int64)
    code[of_a] = a
    code[~of_a] = b + 2 * a_size
    edge = (a_first + b_first).tolist()
    written = [hashlib.sha256(b"".join(map(numeral.__getitem__, code[i:j].tolist()))[:-1]).hexdigest() if j > i else ""
               for i, j in zip(edge[:-1], edge[1:])]
    return [*(pa.array(np.diff(x)) for x in (a_first, b_first, first)), pa.array(written, pa.string()), links]


def linked(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, groups_sha256 and ``links`` of every row, aligned and digested in one pass.

    A link's code is its A id times the size of the piece vocabulary, plus its B id.
    """
    names = [key, "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    aligned, (a_size, b_size) = _aligning(source, byte_vocabulary, piece_model, text), sizes(byte_vocabulary, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numeral = _numerals(a_size, b_size)
        for part, made in aligned(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *_digests(made, numeral, a_size, b_size)], names=names)

    kind = dict(source.dtypes)[key]
    return source.mapInArrow(
        run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def sizes(byte_vocabulary: str, piece_model: str) -> tuple[int, int]:
    """Numbers of ids of both sides."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    return Tokenizer.from_file(byte_vocabulary).get_vocab_size(), pieces.get_piece_size()


def pair_counts(rows: DataFrame, b_size: int, links: str = "links") -> DataFrame:
    """(pair, n, best): how often each pair is linked, and whether no other pair of its B id is more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in chain(batches, repeat(None, 1)):
            if batch is not None:
                fresh, n = np.unique(_flat(batch[links])[0], return_counts=True)
                both, place = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
                pairs = both
            if batch is None or len(pairs) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]

    counted = rows.select(links).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    path = work_path(rows.sparkSession, "pair-counts")
    counted.write.parquet(path)
    counted = rows.sparkSession.read.parquet(path)
    b = F.pmod("pair", F.lit(b_size))
    # One row per B id: the vocabulary bounds it.
    most = F.broadcast(counted.groupBy(b.alias("b")).agg(F.max("n").alias("most")))
    return counted.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def look_up(rows: DataFrame, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray, links: str = "links") -> DataFrame:
    """Add to ``n_best`` and ``count_sum`` what the given ascending pairs contribute to each row."""
    shared = rows.sparkSession.sparkContext.broadcast((pairs, counts, best))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            pair, first = _flat(batch[links])
            text_of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            place = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            held = known[place] == pair
            place, text_of = place[held], text_of[held]
            add = {"n_best": np.bincount(text_of[best[place]], minlength=batch.num_rows),
                   "count_sum": np.zeros(batch.num_rows, np.int64)}
            np.add.at(add["count_sum"], text_of, counts[place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch[c].to_numpy() + add[c]) if c in add else batch[c] for c in names], names=names)

    return rows.mapInArrow(run, rows.schema)


def meet_counts(rows: DataFrame, b_size: int, links: str = "links", slice_pairs: int = SLICE) -> DataFrame:
    """Add n_best and count_sum to a written table of links.

    Pairs are looked up in slices of about ``slice_pairs``; each is one pass, and the sums so far are
    written between passes.
    """
    spark = rows.sparkSession
    path = work_path(spark, "pairs")
    pair_counts(rows, b_size, links).write.parquet(path)
    counted = spark.read.parquet(path)
    slices = max(1, -(-counted.count() // slice_pairs))
    rows = rows.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    for number in range(slices):
        part = counted.filter(F.pmod(F.xxhash64("pair"), F.lit(slices)) == number).toPandas().sort_values("pair")
        if len(part):
            rows = look_up(rows, *(part[c].to_numpy() for c in ("pair", "n", "best")), links)
        if number + 1 < slices:
            path = work_path(spark, "links")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
    return rows


def agreement(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text",
    slice_pairs: int = SLICE,
) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Rows without tokens (null, empty, bytes that differ) have zeros and an empty digest. Null and repeated
    keys keep a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    durable_dir(spark)
    path = work_path(spark, "links")
    linked(docs, byte_vocabulary, piece_model, key, text).write.parquet(path, compression="zstd")
    rows = meet_counts(spark.read.parquet(path), sizes(byte_vocabulary, piece_model)[1], slice_pairs=slice_pairs)
    return rows.select(key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
