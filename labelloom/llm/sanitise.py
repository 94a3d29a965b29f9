"""Personal data, and terms that give it away, by what the corpus knows about both.

Protected entities are e-mail addresses, IP addresses, card and phone numbers. Leaving them out is not
enough where other words name the same person, so the corpus is asked how much a term tells about an
entity: from the share p(e|t) of the documents holding term t in which entity e stands close to it,
the share of e's information content log2(N / documents with e) that t discloses is

    1 + log2(p(e|t)) / log2(N / documents with e)

which is 1 if t never occurs without e and 0 if t is as good as any word. Terms whose largest share
reaches a first threshold are generalised, from a second one on removed, in all texts.

A pair needs ``support`` independent contexts: those that share their least-hashed other word count
once, so that copies and near copies of one passage make little evidence.

Three narrow passes over the documents: contexts of entities, documents of the terms in question (found
by a bit table of fixed size), spans. Texts are never shuffled; pairs of entity and term are, hashed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import words
from labelloom.llm.packing import bit_table, marked
from labelloom.llm.shipping import ship
from labelloom.session import durable_dir, work_path

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REACH = 6
SUPPORT = 5
GENERALISE, REMOVE = 0.8, 0.95
#: Revealing terms that a pass marks: 16 bytes each on the driver and in a worker.
SLICE = 1_000_000
HELD = 1_000_000

# What the patterns of the four kinds are made of.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile("[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before each @ that a domain follows; every character is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at):
            head = text[free:at]
            start = free + len(head.rstrip(LOCAL))
            if start < at:
                yield start, domain.end()
                # No @ lies in a domain; what ends it may not begin the next local part earlier.
                free, at = domain.end(), text.find("@", domain.end())
                continue
        free, at = at + 1, text.find("@", at + 1)


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """IP addresses and cards as (kind, start, end); a match can begin where a run of digits does only."""
    ip_from = card_from = 0
    for run in DIGITS.finditer(text):
        at = run.start()
        if at >= ip_from and (found := IP.match(text, at)):
            ip_from = found.end()
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in found.groups()):
                yield 1, at, ip_from
        if at >= card_from and (found := CARD.match(text, at)):
            card_from = found.end()
            digits = found.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield 2, at, card_from


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of all personal data, in that order, in code points."""
    found = [(a, 0, b) for a, b in _emails(text)] + [(a, k, b) for k, a, b in _numbers(text)]
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> int:
    """Hash of what an entity is, however it is written."""
    value = value.lower() if kind < 2 else "".join(filter(str.isdigit, value))
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}") - 2**63


class Terms:
    """Lower-cased words of letters and digits of some texts, outside of given spans."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        self.data, self.offsets = words.buffers(pa.array([t.encode() for t in texts], pa.large_binary()))
        self.words = words.split_words(self.data, self.offsets, words.ALPHANUMERIC)
        self.hashes = words.word_hashes(self.data, self.words, words.LOWER).view(np.int64)
        heads = np.flatnonzero((self.data & 0xC0) != 0x80)
        #: Code points before each byte, and the byte at which each one begins.
        self.heads = np.append(heads, len(self.data))
        begun = np.searchsorted(heads, self.offsets)
        self.first_point = begun
        self.ranges = [[(self.heads[begun[n] + a], self.heads[begun[n] + b]) for a, _, b in found]
                       for n, found in enumerate(spans)]
        self.free = np.ones(len(self.hashes), bool)
        for a, b in chain.from_iterable(self.ranges):
            self.free[np.searchsorted(self.words.end, a, "right"):np.searchsorted(self.words.start, b)] = False

    def around(self, text: int, a: int, b: int, reach: int) -> np.ndarray:
        """Hashes of the free words up to ``reach`` words before and behind bytes a .. b - 1 of a text."""
        low, high = self.words.first[text], self.words.first[text + 1]
        i = int(np.clip(np.searchsorted(self.words.end, a, "right"), low, high))
        j = int(np.clip(np.searchsorted(self.words.start, b), low, high))
        near = np.r_[max(low, i - reach):i, j:min(high, j + reach)]
        return np.unique(self.hashes[near[self.free[near]]])

    def points(self, text: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words of a text start and end, in its code points."""
        return tuple(np.searchsorted(self.heads, x[word]) - self.first_point[text] for x in (self.words.start, self.words.end))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for a, b in words.slices(column.cast(pa.binary())):
        yield a, [t or "" for t in column[a:b].to_pylist()]


def contexts(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """(entity, term, least, held): how many documents hold a term near an entity, ``least`` standing for
    the context's other words. A document counts with one of its contexts; a row without a term counts
    the documents that hold the entity."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for _, texts in _texts(batch.column(0)):
                spans = [base_spans(t) for t in texts]
                with_data = [n for n, s in enumerate(spans) if s]
                terms = Terms([texts[n] for n in with_data], [spans[n] for n in with_data])
                for at, n in enumerate(with_data):
                    ids, seen = [entity(k, texts[n][a:b]) for a, k, b in spans[n]], set()
                    rows.update((e, None, None) for e in set(ids))
                    for e, (a, b) in zip(ids, terms.ranges[at]):
                        near = terms.around(at, a, b, reach).tolist()
                        for t in near:
                            least = (near[1] if len(near) > 1 else 0) if t == near[0] else near[0]
                            rows[e, t, least] += (e, t) not in seen
                            seen.add((e, t))
            columns = [*zip(*rows)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (*columns, rows.values())], names=["entity", "term", "least", "held"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "entity long, term long, least long, held long")


def document_counts(docs: DataFrame, table: np.ndarray, text: str = "text") -> DataFrame:
    """(term, documents) for the terms that the bit table lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, terms, counts = shared.value, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in chain(batches, repeat(None, 1)):
            fresh = [np.empty(0, np.int64)]
            for a, b in words.slices(batch.column(0)) if batch is not None else ():
                data, offsets = words.buffers(batch.column(0)[a:b])
                found = words.split_words(data, offsets, words.ALPHANUMERIC)
                hashes = words.word_hashes(data, found, words.LOWER).view(np.int64)
                wanted = np.flatnonzero(marked(table, hashes))
                text_of = found.text_of()[wanted]
                order = np.lexsort((hashes[wanted], text_of))
                kept, text_of = hashes[wanted][order], text_of[order]
                new = np.ones(len(kept), bool)
                new[1:] = (kept[1:] != kept[:-1]) | (text_of[1:] != text_of[:-1])
                fresh.append(kept[new])
            both, place = np.unique(np.concatenate([terms, *fresh]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(len(place) - len(counts), np.int64)])
            terms, counts = both, np.bincount(place, weight, len(both)).astype(np.int64)
            if batch is None or len(terms) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "documents"])
                terms, counts = terms[:0], counts[:0]

    raw = docs.select(F.col(f"`{text}`").cast("binary").alias("raw"))
    return raw.mapInArrow(run, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))


def disclosures(docs: DataFrame, text: str = "text", reach: int = REACH, support: int = SUPPORT) -> DataFrame:
    """(term, entity, contexts, near, documents, disclosure) of all pairs with ``support`` contexts.

    ``term`` and ``entity`` are hashes; ``near`` of the ``documents`` with the term hold it close to the
    entity. A written table.
    """
    spark = docs.sparkSession
    durable_dir(spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    found = stored(contexts(docs, text, reach), "entity-contexts")
    near = found.filter("term is not null").groupBy("entity", "term", "least").agg(F.sum("held").alias("near"))
    near = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("near").alias("near"))
    near = stored(near.filter(F.col("contexts") >= support), "entity-terms")
    table = bit_table(near.select("term"))
    known = document_counts(docs, table, text) if table.any() else near.select("term", F.lit(1).alias("documents")).limit(0)
    held = found.filter("term is null").groupBy("entity").agg(F.sum("held").alias("held"))
    total = docs.count()
    share = F.col("near") / F.col("documents")
    content = F.log2(F.lit(float(max(total, 1))) / F.col("held"))
    disclosure = F.when(content > 0, 1 + F.log2(share) / content).otherwise(F.lit(0.0))
    told = near.join(known, "term").join(held, "entity").select(
        "term", "entity", "contexts", "near", "documents", disclosure.alias("disclosure"))
    return stored(told, "disclosures")


def _replacement(kind: str, text: str, removed: bool) -> str:
    if kind != TERM:
        return f"<{kind}>"
    return "" if removed else "<number>" if text.isdigit() else "<name>" if text[:1].isupper() else "<word>"


def rewrite(text: str, spans: list[dict], remove: float) -> str:
    """The text with spans replaced: personal data by its kind, terms by something general or nothing.

    Of overlapping spans the first is taken, with the end of the last.
    """
    out, at, n = [], 0, 0
    while n < len(spans):
        first, end = spans[n], spans[n]["end"]
        while n < len(spans) and spans[n]["start"] < end:
            end = max(end, spans[n]["end"])
            n += 1
        share = first["disclosure"]
        out += [text[at:first["start"]],
                _replacement(first["kind"], text[first["start"]:end], share is not None and share >= remove)]
        at = end
    return "".join([*out, text[at:]])


SPANS = "spans array<struct<kind string, start int, end int, disclosure double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())]))


def mark(docs: DataFrame, terms: np.ndarray, shares: np.ndarray, text: str, spans: str, first: bool) -> DataFrame:
    """Add spans of the given ascending terms to ``spans``, and those of personal data in the first pass."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, shares))
    kept = [c for c in docs.columns if c != spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, shares = shared.value
        for batch in batches:
            column, out = batch[text], []
            before = None if first else batch[spans].to_pylist()
            for at, texts in _texts(column):
                base = [base_spans(t) for t in texts]
                found = [[(a, k, b, None) for a, k, b in s] for s in base] if first else [
                    [(s["start"], KINDS.index(s["kind"]) if s["kind"] in KINDS else 9, s["end"], s["disclosure"]) for s in x]
                    for x in before[at:at + len(texts)]]
                if len(terms):
                    held = Terms(texts, base)
                    place = np.minimum(np.searchsorted(terms, held.hashes), len(terms) - 1)
                    hit = np.flatnonzero((terms[place] == held.hashes) & held.free)
                    owner = held.words.text_of()[hit]
                    for n in np.unique(owner).tolist():
                        word = hit[owner == n]
                        a, b = held.points(n, word)
                        found[n] += zip(a.tolist(), repeat(9), b.tolist(), shares[place[word]].tolist())
                out += [[{"kind": KINDS[k] if k < 9 else TERM, "start": a, "end": b, "disclosure": d}
                         for a, k, b, d in sorted(x, key=lambda s: s[:3])] for x in found]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(out, SPAN_TYPE)], names=[*kept, spans])

    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{spans}` {SPANS.split(' ', 1)[1]}"]))


def find(
    docs: DataFrame, text: str = "text", spans: str = "spans", reach: int = REACH, support: int = SUPPORT,
    generalise: float = GENERALISE, slice_terms: int = SLICE,
) -> DataFrame:
    """Add ``spans`` to every row: kind, start, end (code points, exclusive) and a term's disclosure.

    Personal data and revealing terms outside of it, by start and kind. Null and empty texts have none.
    Null keys, repeated rows and other columns pass through; a column named like the result is replaced.
    All rows count as documents. A very long text is a batch of its own. Terms are marked in slices; from
    the second on, rows are written between passes.
    """
    spark = docs.sparkSession
    told = disclosures(docs, text, reach, support).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    path = work_path(spark, "revealing-terms")
    told.filter(F.col("disclosure") >= generalise).write.parquet(path)
    revealing = spark.read.parquet(path)
    slices = max(1, -(-revealing.count() // slice_terms))
    rows = docs
    for number in range(slices):
        part = revealing.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == number).toPandas().sort_values("term")
        if number:
            path = work_path(spark, "spans")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
        rows = mark(rows, part["term"].to_numpy(np.int64), part["disclosure"].to_numpy(np.float64), text, spans, number == 0)
    return rows


def sanitise(docs: DataFrame, text: str = "text", spans: str = "spans", remove: float = REMOVE, **options: float) -> DataFrame:
    """The rows with ``text`` sanitised, next to the ``spans`` that were replaced; null texts stay null."""
    found = find(docs, text, spans, **options)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if t is None else rewrite(t, s, remove)
                   for t, s in zip(batch[text].to_pylist(), batch[spans].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch[c] for c in names], names=names)

    return found.mapInArrow(run, found.schema)


def digest(rows: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts by kind, a digest of the personal data and all spans as text."""
    base = F.filter(spans, lambda s: s["kind"] != TERM)

    def written(found: F.Column) -> F.Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(key, *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"),
                       written(F.col(spans)).alias("spans"))
