"""Sparse rows times a weight matrix of any size, in blocks on both sides.

Rows come in blocks of ``ROWS``, each cut by slices of ``FEATURES`` features; the matrix is cut by the
same slices and by slices of ``MEMBERS`` columns. Every slice of a row block meets the matrix blocks of
its features, and the partial products of a row block are added up. What is shuffled are the non-zero
values, once per column slice, and one dense partial product per row block and feature slice, instead of
one row per non-zero value and column. No task holds more than a matrix block and ``GROUP_BYTES`` of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.sizing import bounded_rows

ROW_BITS = 10
ROWS = 1 << ROW_BITS
FEATURES = 4096
MEMBERS = 512
GROUP_BYTES = 16 * 1024 * 1024

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = "slice int, part int, first int, members int, matrix binary"


def matrix_blocks(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """Blocks of a features x members matrix: (slice, part, first member, members, matrix)."""
    rows = [(f // FEATURES, m // MEMBERS, m, min(MEMBERS, weights.shape[1] - m),
             np.ascontiguousarray(weights[f:f + FEATURES, m:m + MEMBERS]).tobytes())
            for f in range(0, weights.shape[0], FEATURES) for m in range(0, weights.shape[1], MEMBERS)]
    return spark.createDataFrame(rows, BLOCK)


def coefficient_blocks(coefficients: DataFrame, members: int) -> DataFrame:
    """The same from a table (member, feature, w), assembled on the executors; a missing weight is zero."""

    def assemble(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = (k.as_py() for k in key)
        width = min(MEMBERS, members - part * MEMBERS)
        matrix = np.zeros((FEATURES, width))
        for b in batches:
            at = b.column("feature").to_numpy() - number * FEATURES, b.column("member").to_numpy() - part * MEMBERS
            matrix[at] = b.column("w").to_numpy()
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()),
            "first": pa.array([part * MEMBERS], pa.int32()), "members": pa.array([width], pa.int32()), "matrix": [matrix.tobytes()]})

    cell = [F.floor(F.col(c) / n).cast("int").alias(a) for c, n, a in (("feature", FEATURES, "slice"), ("member", MEMBERS, "part"))]
    return coefficients.select(*cell, "member", "feature", F.col("w").cast("double").alias("w")).groupBy(
        "slice", "part").applyInArrow(assemble, BLOCK)


def _packets(rows: DataFrame) -> DataFrame:
    """(block, slice, pos, idx, val): non-zero values of a row block within a feature slice.

    Every block has a packet in slice 0, if only an empty one. A block may come in several packets.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            idx, val = batch.column(1), batch.column(2)
            size = np.diff(idx.offsets.to_numpy())
            idx, val = idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy().astype(np.float64)
            owner = np.repeat(row, size)
            order = np.lexsort((owner, idx // FEATURES, owner >> ROW_BITS))
            owner, idx, val = owner[order], idx[order], val[order]
            block, number = owner >> ROW_BITS, idx // FEATURES
            new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (number[1:] != number[:-1])]) if len(idx) else []
            out = [(int(b), 0, b"", b"", b"") for b in np.unique(row >> ROW_BITS)]
            for a, b in zip(new, [*new[1:], len(idx)]):
                out.append((int(block[a]), int(number[a]), (owner[a:b] & (ROWS - 1)).astype(np.int32).tobytes(),
                            (idx[a:b] % FEATURES).astype(np.int32).tobytes(), val[a:b].tobytes()))
            for at in range(0, len(out), 64):
                columns = zip(pa.schema(PACKET_FIELDS), zip(*out[at:at + 64]))
                yield pa.RecordBatch.from_pydict({f.name: pa.array(c, f.type) for f, c in columns})

    return rows.mapInArrow(pack, "block long, slice int, pos binary, idx binary, val binary")


PACKET_FIELDS = [("block", pa.int64()), ("slice", pa.int32()), ("pos", pa.binary()), ("idx", pa.binary()), ("val", pa.binary())]


def packet_bytes() -> Column:
    """What a packet holds, positions included."""
    return F.octet_length("pos") + F.octet_length("idx") + F.octet_length("val")


def _partial(packet: dict, matrix: np.ndarray) -> tuple[bytes, bytes]:
    """Positions of a packet's rows, and their products with a matrix block."""
    pos, idx, val = (np.frombuffer(packet[c], t) for c, t in (("pos", np.int32), ("idx", np.int32), ("val", np.float64)))
    if not len(pos):
        return b"", b""
    starts = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    out = np.empty((len(starts), matrix.shape[1]))
    for r, (a, b) in enumerate(zip(starts, [*starts[1:], len(pos)])):
        out[r] = val[a:b] @ matrix[idx[a:b]]
    return pos[starts].tobytes(), out.tobytes()


def block_margins(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, part, first, members, margins): dense products of all rows with all matrix blocks.

    ``rows`` is (row, indices, values) with ids as ``monotonically_increasing_id`` gives them, from a
    written table, and ``margins`` has ``ROWS`` rows.
    """
    packets = _packets(rows).persist()
    held = packets.groupBy("slice").agg(F.sum(packet_bytes()).alias("bytes"))
    # One row per feature slice of the matrix.
    deals = {r["slice"]: max(1, -(-r["bytes"] // GROUP_BYTES)) for r in bounded_rows(held, 1 << 20, "feature slices")}
    spark = rows.sparkSession
    dealt = spark.createDataFrame([(s, int(n)) for s, n in deals.items()] or [(0, 1)], "slice int, deals int")
    left = packets.join(F.broadcast(dealt), "slice").withColumn("deal", F.pmod(F.xxhash64("block"), F.col("deals")).cast("int"))
    parts = blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))).drop("deals")
    right = blocks.join(F.broadcast(dealt), "slice").withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")

    def multiply(packets: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for b in blocks.to_pylist():
            matrix = np.frombuffer(b["matrix"]).reshape(-1, b["members"])
            for batch in packets.to_batches(max_chunksize=16):
                for p in batch.to_pylist():
                    out.append((p["block"], b["part"], b["first"], b["members"], *_partial(p, matrix)))
        fields = [("block", pa.int64()), ("part", pa.int32()), ("first", pa.int32()), ("members", pa.int32()),
                  ("pos", pa.binary()), ("sums", pa.binary())]
        columns = list(zip(*out)) or [()] * len(fields)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(fields, columns)})

    partials = left.groupBy("slice", "part", "deal").cogroup(right.groupBy("slice", "part", "deal")).applyInArrow(
        multiply, "block long, part int, first int, members int, pos binary, sums binary")

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, first, members = (k.as_py() for k in key)
        total = np.zeros((ROWS, members))
        for batch in batches:
            for r in batch.select(["pos", "sums"]).to_pylist():
                total[np.frombuffer(r["pos"], np.int32)] += np.frombuffer(r["sums"]).reshape(-1, members)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int32()),
            "members": pa.array([members], pa.int32()), "margins": [total.tobytes()]})

    return partials.groupBy("block", "part", "first", "members").applyInArrow(
        add, "block long, part int, first int, members int, margins binary")


def row_margins(margins: DataFrame) -> DataFrame:
    """(row, first, margins array<double>) of ``block_margins``; rows of a block that do not exist have zeros."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.arange(0, ROWS * r["members"] + 1, r["members"], dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "row": (r["block"] << ROW_BITS) + np.arange(ROWS), "first": pa.array([r["first"]] * ROWS, pa.int32()),
                    "margins": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(r["margins"])))})

    return margins.mapInArrow(rows, "row long, first int, margins array<double>")


def whole_rows(found: DataFrame) -> Column:
    """Margins of all members in their order, to aggregate over the parts of a row."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "margins"))), lambda p: p["margins"]))
