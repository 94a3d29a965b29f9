"""Near-duplicates by the exact Jaccard similarity of their word shingles.

A prefix join: shingles have one order for all texts, frequent ones last. Two sets with the wanted
similarity share a shingle among the first ones of each: of the smaller set, among the first
``n - need + 1`` where ``need`` is what it must have in common with a set of its own size; of the larger
one, among the first ``n - need + 1`` where ``need`` is the wanted share of itself.

The first candidates are those of SimHash: texts whose fingerprints, of the same shingles, differ in a few
bits. Those that the sets confirm are linked, and the prefix join finds what the fingerprints miss.

Its candidates are looked at in three steps, each exact in what it drops: lengths and the places of the
shared shingle bound what two sets can have in common; then sketches (one bit for each shingle's lowest
hash bits) bound it; then the sets themselves decide. Only sets of candidates that the sketches leave are
made again from their texts and shuffled.

Groups are not written out as pairs: rounds compare each text with one text of every list it is in,
and lists of texts that belong together already fall away. Then the remaining pairs from different
groups are compared all, so no pair of the wanted similarity is missed. Shingles and sets are known by
hashes of 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import simhash, words
from labelloom.llm.packing import bit_table, marked, pack_sorted, unpack_sorted
from labelloom.llm.shipping import ship
from labelloom.llm.simhash import components, with_labels
from labelloom.session import arrow_batches_of, discard, durable_dir, work_path

SHINGLE = 5
PERCENT = 80
#: Shingles that ``FREQUENT`` of a sample of one set in ``SAMPLE`` hold come last in the order; at most
#: ``MOST`` are told apart. Any choice finds the same pairs, and so does any number of rounds.
SAMPLE, FREQUENT, MOST = 16, 3, 1_000_000
ROUNDS = 2
EMPTY = 0
#: Bytes of a batch sent to Python, and of the texts in it that are hashed together, whose arrays are many times
#: as large. Every core of an executor has a worker, beside a JVM that fills its heap.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 19


def shingle_sets(raw: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, ascending, and where each text's begin.

    Texts of fewer words than ``width`` are one shingle.
    """
    data, offsets = words.buffers(raw)
    found = words.split_words(data, offsets)
    hashes = words.word_hashes(data, found, words.LOWER)
    text_of, left = found.text_of(), found.left()
    whole = np.diff(found.first)[text_of]
    shingle, keep = np.zeros_like(hashes), left >= np.minimum(whole, width)
    for size in {width, *np.unique(whole[whole < width]).tolist()}:
        of_size = keep & (np.minimum(whole, width) == size)
        shingle[of_size] = words.window_hashes(hashes, size)[of_size]
    shingle, text_of = shingle[keep], text_of[keep]
    order = np.lexsort((shingle, text_of))
    shingle, text_of = shingle[order], text_of[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text_of[1:] != text_of[:-1])
    return shingle[new], np.searchsorted(text_of[new], np.arange(len(raw) + 1))


def set_hashes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each set, the same for equal sets (int64)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(shingles), dtype=np.uint64)])
    held = np.diff(first)
    hashed = words.mix((total[first[1:]] - total[first[:-1]]) ^ held.astype(np.uint64))
    return np.where(held > 0, hashed, EMPTY).astype(np.uint64).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for the lowest hash bits of each shingle; at least two bits a shingle."""
    bits = np.zeros(max(64, 1 << (2 * len(shingles)).bit_length()), bool)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def common_bound(x: bytes, n: int, y: bytes, m: int) -> int:
    """At least as many shingles as two sets of n and m have in common, by their sketches."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[:len(a) // 2] | a[len(a) // 2:]
        else:
            b = b[:len(b) // 2] | b[len(b) // 2:]
    both, more, other = (int(np.bitwise_count(z.view(np.uint64)).sum()) for z in (a & b, a, b))
    return both + min(n - more, m - other)


def similar(common: Column | int, n: Column | int, m: Column | int, percent: int) -> Column | bool:
    """Whether sets of n and m with so much in common (or more) have the wanted similarity."""
    return (100 + percent) * common >= percent * (n + m)


def _prefixes(shingles: np.ndarray, first: np.ndarray, percent: int, often: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """First shingles of each set in the common order, as many as a similar set cannot miss."""
    place = np.zeros(len(shingles), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        place = np.where(often[at] == shingles, rank[at], 0)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        order = np.argsort(place[a:b], kind="stable")
        out.append(shingles[a:b][order[:b - a - -(-percent * (b - a) // 100) + 1]] if b > a else shingles[a:b])
    return out


def _give_back() -> None:
    """Return what this worker holds free, of earlier tasks and stages, to the system.

    Workers are used again, and each would keep the most that any of its tasks has had.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def _mapped(docs: DataFrame, text: str, fn, schema: str, kept: list[Column]) -> DataFrame:
    """``fn`` of each slice of texts and of the columns kept, as a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            for a, b in words.slices(raw, SLICE_BYTES):
                yield fn(batch.slice(a, b - a), raw[a:b])

    return docs.select(*kept, F.col(f"`{text}`").cast("binary").alias("raw text")).mapInArrow(run, schema)


class Files:
    """Intermediate tables in the shared folder, deleted as soon as they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame, name: str, *done: DataFrame | None) -> DataFrame:
        """Write a table, then delete those that only served to make it."""
        path = work_path(self.spark, f"shingle-{name}")
        with arrow_batches_of(self.spark, BATCH_BYTES):
            df.write.parquet(path)
        for d in done:
            if d is not None:
                discard(self.spark, self.paths.pop(id(d)))
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = path
        return out


def _sampled(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of the different texts, ascending, and their places by count."""

    def run(batch: pa.RecordBatch, raw: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shingle_sets(raw, width)[0].view(np.int64))], names=["token"])

    hashed = docs.select(F.col(f"`{text}`").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    held = _mapped(hashed.distinct(), "text", run, "token long", []).groupBy("token").count()
    often = held.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MOST)
    with arrow_batches_of(docs.sparkSession, BATCH_BYTES):
        often = often.toPandas()
    token = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(token) - order).astype(np.int64)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        for batch in batches:
            x, y = batch["x"].to_pylist(), batch["y"].to_pylist()
            good = [similar(common_bound(p["sketch"], p["n"], q["sketch"], q["n"]), p["n"], q["n"], percent)
                    for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = F.struct("n", "sketch")
    both = pairs.join(sets.select(F.col("fp").alias("a"), side.alias("x")), "a").join(
        sets.select(F.col("fp").alias("b"), side.alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _similar(files: Files, pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """Those of the pairs whose sets are similar, written; sets are made from the texts of these pairs only."""
    pairs = files.store(_possible(pairs, sets, percent), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = files.store(sets.join(ends, "fp", "left_semi").select("fp", "text_hash"), "wanted")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select("text_hash")))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        for batch in batches:
            batch = batch.filter(pa.array(marked(table.value, batch["text_hash"].to_numpy())))
            for i, j in words.slices(batch["raw"], SLICE_BYTES):
                shingles, first = shingle_sets(batch["raw"][i:j], width)
                packed = [pack_sorted(shingles[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_hashes(shingles, first)), batch["text_hash"][i:j], pa.array(packed, pa.binary())],
                    names=["fp", "text_hash", "shingles"])

    whole = docs.select(F.col(f"`{text}`").cast("binary").alias("raw")).select(F.xxhash64("raw").alias("text_hash"), "raw")
    whole = whole.mapInArrow(again, "fp long, text_hash long, shingles binary").join(wanted, ["fp", "text_hash"], "left_semi")
    whole = files.store(whole.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets", wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = unpack_sorted(x.as_py()), unpack_sorted(y.as_py())
                good.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(whole.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(
        whole.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    return files.store(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links", whole, pairs)


def simhash_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of sets (fp, print) that connect those whose SimHash fingerprints differ in ``radius`` bits at most.

    Sets of one fingerprint meet the least of them, and that meets the least one of each fingerprint linked.
    """
    heads = sets.groupBy("print").agg(F.min("fp").alias("head"))
    near = simhash.link_fingerprints(heads.select(F.col("print").alias("fp")), radius)
    heads_of = {c: heads.select(F.col("print").alias(c), F.col("head").alias(f"head of {c}")) for c in "ab"}
    between = near.join(heads_of["a"], "a").join(heads_of["b"], "b").select(F.col("head of a").alias("a"), F.col("head of b").alias("b"))
    within = sets.join(heads, "print").filter(F.col("fp") != F.col("head")).select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return between.unionByName(within)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    rounds: int = ROUNDS, radius: int = simhash.RADIUS,
) -> DataFrame:
    """key and component_id of every row.

    Rows are linked whose sets of ``shingle`` lower-cased words have a Jaccard similarity of ``percent``
    hundredths or more; a shorter text is one shingle, and texts without words are alike. The
    component is the smallest key reachable; null keys never name one, unless no row of it has a key
    (then null). Repeated rows keep a row each; other columns are ignored. A very long text is a batch of
    its own. ``radius`` is that of the SimHash fingerprints looked at first; any finds the same groups.
    """
    spark = docs.sparkSession
    ship(spark)
    durable_dir(spark)
    files = Files(spark)
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    frequent = spark.sparkContext.broadcast(_sampled(docs, "text", shingle))

    def printed_of(batch: pa.RecordBatch, raw: pa.Array) -> pa.RecordBatch:
        found, first = shingle_sets(raw, shingle)
        tokens = [x.view(np.int64) for x in _prefixes(found, first, percent, *frequent.value)]
        sketches = [sketch(found[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        prints = [simhash.text_fingerprint(simhash.shingle_hashes(t.as_py() or b"", shingle)) for t in raw]
        flat = np.concatenate([np.empty(0, np.int64), *tokens])
        ends = np.cumsum([0, *map(len, tokens)])
        return pa.RecordBatch.from_arrays(
            [batch["key"], batch["text_hash"], pa.array(set_hashes(found, first)), pa.array(np.diff(first)),
             pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
             pa.array(np.array(prints, np.uint64).view(np.int64))],
            names=["key", "text_hash", "fp", "n", "sketch", "tokens", "print"])

    printed = files.store(_mapped(
        docs, "text", printed_of,
        f"key {dict(docs.dtypes)['key']}, text_hash long, fp long, n long, sketch binary, tokens array<long>, print long",
        [F.col("key"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash")]), "prefixes")
    sets = files.store(printed.groupBy("fp").agg(
        F.coalesce(F.min("key").cast("long"), F.lit(2**63 - 1)).alias("label"),
        F.first(F.struct("text_hash", "n", "sketch", "tokens", "print")).alias("one")).select("fp", "label", "one.*"), "labels")
    printed = files.store(printed.select("key", "fp"), "keys", printed)
    labels = sets.select("fp", "label")
    # Held by several sets, as least and largest set hash differ.
    every = sets.select(F.posexplode("tokens").alias("place", "token"), "fp", "n")
    several = every.groupBy("token").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    lead = F.col("place") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent))
    entries = files.store(every.join(several.select("token"), "token", "left_semi").select(
        "token", "fp", F.col("n").cast("int").alias("n"), "place", lead.alias("lead")), "entries")

    def grouped(found: DataFrame, label: Column) -> DataFrame:
        return components(found, sets.select("fp", label.alias("label")))

    links = _similar(files, simhash_pairs(sets, radius), sets, docs, "text", shingle, percent)
    group = files.store(grouped(links, F.col("fp")), "groups")

    now, number = entries.join(group, "fp"), 0
    while True:
        # The order of the groups changes from round to round, so that no text stays the only one compared with.
        turn = F.xxhash64("component", F.lit(number))
        mixed = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.min(F.struct("place", turn.alias("turn"), "component", "fp", "n")).alias("hub"))
        mixed = mixed.filter("low < high").select("token", "hub")
        if number == rounds:
            break
        star = now.join(mixed, "token").filter(F.col("component") != F.col("hub.component"))
        most = F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))
        alike = similar(most, F.col("n"), F.col("hub.n"), percent)
        pairs = star.filter(alike).select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).distinct()
        found = _similar(files, pairs, sets, docs, "text", shingle, percent)
        number += 1
        if found.isEmpty():
            break
        links = files.store(links.unionByName(found), "links", links, found)
        group = files.store(grouped(links, F.col("fp")), "groups", group)
        # Groups only grow: a token whose texts are in one of them is done with.
        fresh = entries.join(group, "fp")
        still = fresh.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        entries = files.store(entries.join(still.select("token"), "token", "left_semi"), "entries", entries)
        now = entries.join(group, "fp")
    left = now.join(mixed.select("token"), "token", "left_semi")
    right = left.select("token", *[F.col(c).alias(f"{c} of b") for c in ("fp", "n", "place", "lead", "component")])
    # The smaller set has to lead with the shingle. Of the first shingle that two sets share, nothing in front
    # of it is in common, so what is from there on bounds that; rows of later ones may go with the others.
    other = {c: F.col(f"{c} of b") for c in ("fp", "n", "place", "lead", "component")}
    most = F.least(F.col("n") - F.col("place"), other["n"] - other["place"])
    ordered = (F.col("n") < other["n"]) | ((F.col("n") == other["n"]) & (F.col("fp") < other["fp"]))
    rest = left.filter("lead").join(right, "token").filter(
        ordered & (F.col("component") != other["component"]) & similar(most, F.col("n"), other["n"], percent))
    rest = _similar(files, rest.select(F.col("fp").alias("a"), other["fp"].alias("b")).distinct(), sets, docs, "text",
                    shingle, percent)
    links = files.store(links.unionByName(rest), "links", links, rest)
    done = files.store(grouped(links, F.col("label")), "components", links, group, entries, sets)
    return with_labels(printed, done).select(
        F.col("key").alias(key), F.when(F.col("component") < 2**63 - 1, F.col("component")).alias("component_id"))
