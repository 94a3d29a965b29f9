"""Sets of 64-bit keys as compact byte strings, dealt out to shards by their leading bits."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.sizing import bounded_rows

#: Bits of a table that tells hashes in question; a full one only lets others pass for a while.
TABLE_BITS = 24

# A key's shard follows from its leading 32 bits, so sorted keys are sorted by shard as well.


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys; shards + 1 entries."""
    edges = (np.arange(1, shards, dtype=object) * 2**64 + shards - 1) // shards
    cuts = np.searchsorted(keys, edges.astype(np.uint64)) if shards > 1 else np.empty(0, np.int64)
    return np.concatenate([[0], cuts, [len(keys)]]).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, so that leading zeros cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def pack_flags(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpack_flags(raw: bytes, count: int) -> np.ndarray:
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.unpackbits(bits, count=count).astype(bool)


def groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal values, and the run number of every value."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def bit_table(hashes: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """One bit for each value of a hash's lowest bits: 2 ** bits of them, however many hashes there are.

    ``hashes`` has one column.
    """
    hashes = hashes.toDF("hash")
    word = F.shiftright(F.col("hash").bitwiseAND(F.lit(2**bits - 1)), 5)
    packed = hashes.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(hash & 31 AS int)))").alias("mask"))
    table = np.zeros(max(1, 2**bits >> 5), np.uint32)
    for r in bounded_rows(packed, len(table), "words of the bit table"):
        table[r["word"]] = r["mask"]
    return table


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (int64) is set."""
    spot = hashes & (len(table) * 32 - 1)
    return (table[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1 == 1
