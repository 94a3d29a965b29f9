"""Target-distribution importance resampling with hashed n-gram features.

Two tables are counted into the same fixed number of buckets; a bucket's gain says how much more often
its features occur in the target than in the raw table. A document's weight is the mean gain of its
features, and Gumbel noise from its key turns the highest scores into a draw without replacement.

Texts are worked on by batches: they are joined with separator bytes, one pass of a regular expression
finds all words, a binary search of the words' places among the texts' offsets tells which text a word
is in, n-grams whose ends lie in different texts are masked, and the rest is counted by ``bincount``.
A batch is walked in blocks of words, so a very long text needs memory for its bytes and one block.

What crosses the network: a partition's bucket counts, the distinct scores (whose number the gains
bound), and the keys of the documents drawn. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.sizing import bounded_rows
from labelloom.llm import words
from labelloom.llm.shipping import ship
from labelloom.session import durable_dir, work_path

BUCKETS = 10_000
SEPARATOR = b"\x00"
#: Lower-cased runs of ASCII letters, digits and all bytes beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_WORDS = 1 << 17
#: Gumbel noise of a 32-bit hash, times 1000, lies between these.
NOISE = (-3_200, 23_000)
DEALS = 64


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Lower-cased texts with a separator between them, and where each begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return SEPARATOR.join(texts).lower(), np.cumsum(size + 1) - size - 1


def features(texts: list[bytes], order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text number of each word, text number of each feature, bucket of each feature).

    Features are the runs of 1 to ``order`` words of one text, joined by one blank.
    """
    data, offsets = joined(texts)
    found = WORD.finditer(data)
    last, last_in = [], np.empty(0, np.int64)
    while part := list(islice(found, BLOCK_WORDS)):
        here = np.searchsorted(offsets, np.fromiter((m.start() for m in part), np.int64, len(part)), "right") - 1
        held = last + [m.group() for m in part]
        text_of = np.concatenate([last_in, here])
        sums = np.fromiter(map(zlib.crc32, held), np.int64, len(held))
        owner, bucket = [here], [sums[len(last):] % buckets]
        for size in range(2, order + 1):
            sums = np.fromiter((zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(sums.tolist(), held[size - 1:])),
                               np.int64, max(0, len(held) - size + 1))
            first, end = text_of[:len(sums)], text_of[size - 1:]
            new = (first == end) & (np.arange(len(sums)) + size > len(last))
            owner.append(first[new])
            bucket.append(sums[new] % buckets)
        yield here, np.concatenate(owner), np.concatenate(bucket)
        keep = max(0, len(held) - order + 1)
        last, last_in = held[keep:], text_of[keep:]


def _batches(raw: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for a, b in words.slices(raw):
        yield a, [t.as_py() or b"" for t in raw[a:b]]


def bucket_counts(docs: DataFrame, text: str = "text", order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts of a table; buckets without features are left out."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _batches(batch.column(0)):
                for _, _, bucket in features(texts, order, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    raw = docs.select(F.col(f"`{text}`").cast("binary").alias("raw"))
    return raw.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target to raw."""
    over, under = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * over / ((s + 1.0) * under)))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(seed: str, key: int | None) -> int:
    """Thousandths of Gumbel noise from a key; a null key has the noise of an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(
    docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", order: int = 1, seed: str = "2024",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """key, ``more``, n_words, n_features, weight and score of every row, given the buckets' gains."""
    ship(docs.sparkSession)
    made = ["n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for at, texts in _batches(batch.column(1)):
                for word_in, owner, bucket in features(texts, order, len(gain)):
                    to = at + len(texts)
                    n_words[at:to] += np.bincount(word_in, minlength=len(texts))
                    n_features[at:to] += np.bincount(owner, minlength=len(texts))
                    np.add.at(total, at + owner, gain[bucket])
            weight = total // np.maximum(n_features, 1)
            luck = np.fromiter((noise(seed, k) for k in batch.column(0).to_pylist()), np.int64, n)
            columns = [n_words, n_features, weight, weight + luck]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], *map(pa.array, columns)], names=[key, *more, *made])

    source = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("binary").alias("raw text"),
                         *[F.col(f"`{c}`") for c in more])
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in (key, *more)), *(f"{c} long" for c in made)]))


def rank_highest(scored: DataFrame, key: str, percent: int, min_words: int, levels: int) -> DataFrame:
    """Add ``rank`` to a written table of scores: 1, 2, 3 .. for the highest, null for the others.

    Of the rows with ``min_words`` words or more, ``percent`` hundredths are drawn; ties go to the smaller
    key, null keys last. The driver sees one count per distinct score, ``levels`` at most; rows of one
    score and key are numbered in ``DEALS`` parts, so a repeated key is not one task's work.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= min_words
    counts = bounded_rows(scored.filter(able).groupBy("score").count(), levels, "distinct scores")
    want, before, seen = sum(r["count"] for r in counts) * percent // 100, [], 0
    for r in sorted(counts, key=lambda r: -r["score"]):
        if seen >= want:
            break
        before.append((r["score"], seen))
        seen += r["count"]
    if not before:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reached = able & (F.col("score") >= before[-1][0])
    ahead = spark.createDataFrame(before, "score long, `rows ahead` long")
    rows = scored.filter(reached).withColumn("row deal", F.pmod(F.xxhash64("place"), F.lit(DEALS)))
    cells = rows.groupBy("score", key, "row deal").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), "row deal")
    begun = cells.join(F.broadcast(ahead), "score").select(
        F.col("score").alias("score of"), F.col(key).alias("key of"), F.col("row deal").alias("deal of"),
        (F.col("rows ahead") + F.sum("n").over(within) - F.col("n")).alias("rows before"))
    number = F.row_number().over(Window.partitionBy("score", key, "row deal").orderBy("place"))
    ranked = rows.withColumn("row number", number).join(
        begun, (F.col("score") == F.col("score of")) & F.col(key).eqNullSafe(F.col("key of"))
        & (F.col("row deal") == F.col("deal of")))
    rank = F.col("rows before") + F.col("row number")
    drawn = ranked.select(*scored.columns, F.when(rank <= want, rank).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~reached).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", order: int = 1,
    buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: str = "2024", more: tuple[str, ...] = (),
) -> DataFrame:
    """key, ``more``, n_words, n_features, weight, score and rank of every row; drawn rows have a rank.

    Null and empty texts have no features and weight 0, and with ``min_words`` above 0 are not drawn. Null
    keys draw the noise of an empty key and yield in ties; repeated rows are drawn row by row, in any
    order among themselves. With an empty target or table all shares are those of the smoothing. Columns
    other than ``more`` are left out, and those of ``more`` named like a result too. A very long text is
    one batch.
    """
    spark = docs.sparkSession
    durable_dir(spark)
    more = tuple(c for c in more if c not in (key, "n_words", "n_features", "weight", "score", "rank", "place"))
    sides = []
    for table, column in ((docs, text), (target, target_text)):
        held = np.zeros(buckets, np.int64)
        for r in bounded_rows(bucket_counts(table, column, order, buckets), buckets, "buckets"):
            held[r["bucket"]] = r["n"]
        sides.append(held)
    gain = gains(*sides)
    path = work_path(spark, "importance")
    score(docs, gain, key, text, order, seed, more).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    levels = int(gain.max() - gain.min()) + NOISE[1] - NOISE[0] + int(abs(gain).max())
    return rank_highest(spark.read.parquet(path), key, percent, min_words, levels).drop("place")
