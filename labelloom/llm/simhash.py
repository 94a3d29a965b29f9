"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ are sorted by the population counts of their four 16-bit quarters and cut
into tiles of a fixed size, however many partitions they come in. Two fingerprints within the radius differ by at most the radius in the
sum of their quarters' population counts, so a pair of tiles whose count boxes lie farther apart is
skipped without being looked at; within a pair of tiles the same test skips sub-tiles. What remains
is compared exactly with exclusive-or and bit counts.

A group of mutually near fingerprints is never written out as pairs: every tile pair returns a
spanning forest of its links. The forests are joined to components by label propagation on a table
of distinct fingerprints, written between passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelloom.llm.shipping import ship
from labelloom.session import cut_lineage, discard, durable_dir, work_path

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 32_768
SUB_TILE = 256
HOT_SHARE = 1000

EDGE = "a long, b long"


def text_fingerprint(shingle_hashes: np.ndarray) -> int:
    """Bit b is one if set in over half the hashes; zero without hashes."""
    if not len(shingle_hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(shingle_hashes), 1 << 16):
        part = np.ascontiguousarray(shingle_hashes[at:at + (1 << 16)].astype(">u8")).view(np.uint8)
        bits += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * bits > len(shingle_hashes))
    return int.from_bytes(majority.tobytes(), "big")


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-cased words joined by one blank, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    pieces = map(joined.__getitem__, cuts)
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Add a 64-bit fingerprint (long) to every row; null and empty texts give zero."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (out, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(kept))
            found = [text_fingerprint(shingle_hashes(t.as_py() or b"", shingle)) for t in raw]
            columns = [*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("raw text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{out}` long"]))


def quarter_counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, a row each."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _boxes(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(counts), size)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least sum of differences between points of boxes."""
    gap = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    return gap.sum(axis=-1)


class Forest:
    """Union-find over 0 .. n - 1 that takes links in bulk."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while True:
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            a, b = self.root[a], self.root[b]


def compare_tiles(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (fingerprint, fingerprint) links, of all pairs within the radius."""
    n = len(left)
    forest = Forest(n if same else n + len(right))
    lows, highs = _boxes(quarter_counts(left), SUB_TILE)
    other_lows, other_highs = _boxes(quarter_counts(right), SUB_TILE)
    for i in range(len(lows)):
        near = np.flatnonzero(_apart(lows[i], highs[i], other_lows, other_highs) <= radius)
        a = left[i * SUB_TILE:(i + 1) * SUB_TILE]
        for j in near[near >= i] if same else near:
            b = right[j * SUB_TILE:(j + 1) * SUB_TILE]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if len(x):
                forest.add(x + i * SUB_TILE, y + j * SUB_TILE + (0 if same else n))
    member = np.flatnonzero(forest.root != np.arange(len(forest.root)))
    everything = left if same else np.concatenate([left, right])
    return everything[member], everything[forest.root[member]]


def pieces_of(distinct: DataFrame, tile: int) -> DataFrame:
    """Sorted pieces of at most ``tile`` fingerprints: ``id`` in sort order, ``size``, ``box`` (least and
    largest quarter counts) and packed ``prints``."""
    byte = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    parts = max(1, -(-distinct.count() // tile))
    ordered = distinct.select("fp", *[b.alias(f"q{q}") for q, b in enumerate(byte)]).repartitionByRange(
        parts, "q0", "q1", "q2", "q3", "fp").withColumn("part", F.spark_partition_id()).select("part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = [], 0
        for batch in batches:
            found.append(batch.column(1).to_numpy().view(np.uint64))
            part = batch.column(0)[0].as_py() if batch.num_rows else part
        prints = np.concatenate(found) if found else np.empty(0, np.uint64)
        counts = quarter_counts(prints)
        prints = prints[np.lexsort((prints, *counts.T[::-1]))]
        for number, at in enumerate(range(0, len(prints), tile)):
            cut = prints[at:at + tile]
            c = quarter_counts(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part * 2**20 + number], pa.int64()), pa.array([len(cut)], pa.int64()),
                 pa.array([[*c.min(0).tolist(), *c.max(0).tolist()]], pa.list_(pa.int32())),
                 pa.array([cut.tobytes()], pa.binary())], names=["id", "size", "box", "prints"])

    return ordered.mapInArrow(run, "id long, size long, box array<int>, prints binary")


def assign_tiles(pieces: list[tuple[int, int, list[int]]], tile: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Neighbouring pieces (id, size, box) gathered to tiles of at most ``tile``: (id, tile) pairs and tile boxes."""
    owner, boxes, filled = [], [], tile
    for number, size, box in sorted(pieces):
        if filled + size > tile:
            boxes.append(box)
            filled = 0
        last = boxes[-1]
        boxes[-1] = [*map(min, last[:4], box[:4]), *map(max, last[4:], box[4:])]
        filled += size
        owner.append((number, len(boxes) - 1))
    return owner, np.array(boxes, np.int64).reshape(-1, 8)


def near_tiles(boxes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose boxes (least and largest counts) come as near as the radius.

    Tiles meet at the sums of their counts, of which there are 65; only then are their boxes compared.
    """
    low, high = (sum((F.get("box", F.lit(q)) for q in part), F.lit(0)) for part in (range(4), range(4, 8)))
    left = boxes.select(F.col("tile").alias("a"), F.col("box").alias("x"), F.explode(F.sequence(low, high)).alias("sum"))
    right = boxes.select(
        F.col("tile").alias("b"), F.col("box").alias("y"), F.explode(F.sequence(low - radius, high + radius)).alias("sum"))
    gap = sum((F.greatest(F.lit(0), F.col("y")[q] - F.col("x")[q + 4], F.col("x")[q] - F.col("y")[q + 4]) for q in range(4)), F.lit(0))
    return left.join(right, "sum").filter((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct()


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "fp") -> DataFrame:
    """``rows`` joined with their ``labels``, one row per key; keys of many rows are not gathered.

    Fewer than ``HOT_SHARE`` keys can have more than that part of all rows, so theirs are broadcast.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows of key"))
    hot = counts.filter(F.col("rows of key") > rows.count() // HOT_SHARE).select(key)
    hot = labels.join(F.broadcast(hot), key, "left_semi")
    there = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(labels, key)
    return there.unionByName(others)


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect what the radius connects; ``distinct`` has one column ``fp``.

    The driver sees one box of eight counts per piece, not fingerprints or pairs.
    """
    spark = distinct.sparkSession
    path = work_path(spark, "pieces")
    pieces_of(distinct, tile).write.parquet(path)
    pieces = spark.read.parquet(path)
    owner, box = assign_tiles([(r["id"], r["size"], r["box"]) for r in pieces.select("id", "size", "box").collect()], tile)
    boxes = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(box)] or [(0, [0] * 8)], "tile long, box array<long>")
    path = work_path(spark, "tile-pairs")
    near_tiles(boxes, radius).write.parquet(path)
    wanted = spark.read.parquet(path)
    owned = pieces.join(spark.createDataFrame(owner or [(0, 0)], "id long, tile long"), "id")
    tiles = owned.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("id", "prints")))["prints"].alias("prints"))
    left = tiles.select(F.col("tile").alias("a"), F.col("prints").alias("x"))
    right = tiles.select(F.col("tile").alias("b"), F.col("prints").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(b"".join(r[side]), np.uint64) for side in "xy")
                a, b = compare_tiles(x, y, radius, r["a"] == r["b"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    matched = wanted.join(left, "a").join(right, "b")
    return matched.repartition(max(1, wanted.count()), "a", "b").mapInArrow(run, EDGE)


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest ``label`` reachable from each ``fp`` over undirected links (a, b).

    Label propagation: each pass is one join and one aggregation over the links, with a loop at every
    linked fingerprint so that its own label takes part. What travels is the smallest (label, fp), as
    several fingerprints may share a label. From the second pass on, it is followed to what its
    fingerprint has got itself, which shortens long chains. Only linked fingerprints take part, and
    every pass is written to the shared folder.
    """
    spark = labels.sparkSession
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"])
    # The checkpoint keeps the links partitioned for the join of every pass.
    edges = cut_lineage(links.select(F.explode(ways).alias("e")).select("e.*").repartition("b"))
    now = labels.select("fp", F.struct("label", "fp").alias("least"))
    passes, path = 0, None
    while True:
        old = F.max(F.when(F.col("a") == F.col("b"), F.col("least")))
        near = edges.join(now.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(
            F.min("least").alias("least"), old.alias("old"))
        if passes:
            root = now.select(F.col("fp").alias("root"), F.col("least").alias("up"))
            near = near.join(root, F.col("least.fp") == F.col("root"), "left").withColumn("least", F.least("least", "up"))
        moved = Observation()
        before, path = path, work_path(spark, "components")
        near.observe(moved, F.count_if(F.col("least") < F.col("old")).alias("n")).select("fp", "least").write.parquet(path)
        now = spark.read.parquet(path)
        if before:
            discard(spark, before)
        passes += 1
        if not moved.get["n"]:
            break
    return labels.join(now.select("fp", F.col("least.label").alias("component")), "fp", "left").select(
        "fp", F.coalesce("component", "label").alias("component"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """key, fingerprint (long) and component_id of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; the component is the
    smallest key reachable. Null and empty texts have fingerprint zero and link like any other. A
    null key keeps its row but never names a component, unless no row of it has a key (then null).
    Repeated rows keep a row each. Other columns are ignored.
    """
    spark = docs.sparkSession
    durable_dir(spark)
    path = work_path(spark, "fingerprints")
    fingerprints(docs.select(key, text), text, "fp", shingle).write.parquet(path)
    printed = spark.read.parquet(path)
    path = work_path(spark, "distinct-fingerprints")
    printed.groupBy("fp").agg(F.coalesce(F.min(key).cast("long"), F.lit(2**63 - 1)).alias("label")).write.parquet(path)
    labels = spark.read.parquet(path)
    found = components(link_fingerprints(labels.select("fp"), radius, tile), labels)
    path = work_path(spark, "components")
    found.write.parquet(path)
    return with_labels(printed, spark.read.parquet(path)).select(
        key, F.col("fp").alias("fingerprint"),
        F.when(F.col("component") < 2**63 - 1, F.col("component")).alias("component_id"))


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", near: Callable[..., DataFrame] = near_duplicates,
    **options: int,
) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their near-duplicate component, as ``near`` finds it.

    ``near`` is SimHash alone or, as ``set_dedup.near_duplicates``, SimHash with an exact check after it.
    Rows without a key have nothing smaller to yield to and stay. Of rows repeating a kept key the one
    with the smallest row hash stays (map columns are not looked at), of equal rows any.
    """
    kept = near(docs, key, text, **options).filter(F.col(key) == F.col("component_id")).select(key).distinct()
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not dict(docs.dtypes)[c].startswith("map")])
    copies = docs.select(F.col(f"`{key}`").alias("kept key"), row.alias("row hash")).groupBy("kept key", "row hash").agg(
        F.count(F.lit(1)).alias("copies"))
    chosen = copies.groupBy("kept key").agg(F.min(F.struct("row hash", "copies")).alias("one")).select("kept key", "one.*").join(
        kept.withColumnRenamed(key, "kept key"), "kept key", "left_semi")
    of = docs.withColumn("hash of row", row)
    met = of.join(chosen, (F.col(f"`{key}`") == F.col("kept key")) & (F.col("hash of row") == F.col("row hash")))
    single, equal = met.filter("copies = 1"), met.filter("copies > 1").dropDuplicates(["kept key"])
    lone = docs.filter(F.col(f"`{key}`").isNull())
    names = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*names).unionByName(equal.select(*names)).unionByName(lone)


def digest(rows: DataFrame) -> DataFrame:
    """Fingerprints as 16 hexadecimal digits."""
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
