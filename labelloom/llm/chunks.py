"""Documents in chunks that talk to shards of a key space.

A chunk is some megabytes of documents handled by one task; a shard owns a range of hashed keys.
Chunks send each shard their distinct keys as one packed row, shards answer one packed row per
chunk. A key that a third of all documents hold arrives once per chunk, so no shard sees more of
it, and nothing is joined key by key. The shuffled documents are used again by every round, which
Spark serves from the same shuffle files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.sizing import small_side
from labelloom.llm.shipping import ship
from labelloom.session import durable_dir, work_path

CHUNK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Rows between chunks and shards in one round.
MOST_ROWS = 4_000_000
NO_ID = -(2**63)


@dataclass(frozen=True)
class Layout:
    """Documents dealt to chunks (``chunk``, ``doc_id``, ``split``, ``raw``, further columns) and the shard count.

    Rows of one id are in one chunk unless ``split`` is set.
    """

    docs: DataFrame
    chunks: int
    shards: int

    def ask(self, fn: Callable, schema: str, replies: DataFrame | None = None) -> DataFrame:
        """Rows that ``fn`` makes of each chunk, given the replies it has received so far."""
        if replies is None:
            return self.docs.groupBy("chunk").applyInArrow(fn, schema)
        return self.docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(fn, schema)

    def deal(self, replies: DataFrame) -> DataFrame:
        """Replies next to the chunks they belong to."""
        return replies.repartition(self.chunks, "chunk")


def counts_of(size: int, chunk_bytes: int, shard_bytes: int) -> tuple[int, int]:
    """Numbers of chunks and shards; both sizes grow, eightfold at most, before the rows between them pass ``MOST_ROWS``."""
    rows = size / chunk_bytes * size / shard_bytes
    grown = min(max(1.0, (rows / MOST_ROWS) ** 0.5), 8.0)
    return max(1, ceil(size / (chunk_bytes * grown))), max(1, ceil(size / (shard_bytes * grown)))


def lay_out(
    docs: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = (),
    chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> Layout:
    """Deal documents to chunks by a hash of their key; counts follow the bytes of text.

    Rows of a key (null is one, too) that several rows share and that has more than an eighth of a
    chunk's bytes are dealt singly, by a number each that is written once with them. A single long row
    is no such case.
    """
    spark = docs.sparkSession
    ship(spark)
    held = docs.groupBy(F.col(f"`{key}`").cast("long").alias("large id")).agg(
        F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    large = (F.col("bytes") > max(1, chunk_bytes // 8)) & (F.col("rows") > 1)
    size, shared = held.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(large)).first()
    chunks, shards = counts_of(size, chunk_bytes, shard_bytes)
    rest = [F.col(f"`{c}`") for c in more]
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("raw"), *rest)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")
    dealt = source.select(place.alias("chunk"), "doc_id", F.lit(False).alias("split"), "raw", *rest)
    if shared and chunks > 1:
        durable_dir(spark)
        owners = small_side(held.filter(large).select("large id", F.lit(True).alias("of a large id")))
        same = F.col("doc_id").eqNullSafe(F.col("large id"))
        path = work_path(spark, "rows-of-large-ids")
        source.join(owners, same).select("doc_id", "raw", *rest, F.monotonically_increasing_id().alias("row place")).write.parquet(path)
        split = spark.read.parquet(path).select(
            F.pmod(F.xxhash64("row place"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.lit(True).alias("split"), "raw", *rest)
        dealt = dealt.join(owners, same, "left_anti").unionByName(split)
    return Layout(dealt.repartition(chunks, "chunk"), chunks, shards)


def by_id(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk in the order of its ids, the ids (null as the least) and each row's place among them."""
    table = table.combine_chunks()
    ids = table["doc_id"].fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    place = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
    return table.take(pa.array(order)).combine_chunks(), ids, place


def column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    chunked = table[name]
    return chunked.combine_chunks() if chunked.num_chunks != 1 else chunked.chunk(0)
