"""Secret scans through a trigram inverted index.

Every rule's pattern is reduced to a Boolean query (``trigrams``): any of several alternatives, each a set
of trigrams that a match must hold. Documents are indexed by those trigrams as bitmaps of slots, as many
as there are rows, to which a hash of key and text deals them; rows that share a slot only share their
candidates. Postings are intersected within an alternative and united
across alternatives, which leaves candidate documents per rule; only those are matched against the
rule's expression. A rule whose pattern has no mandatory trigram scans every document.

Only DataFrame functions are used. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import let
from labelloom.llm.trigrams import trigram_query

# A bitmap of the engine covers 32,768 ids in 4,096 bytes.
PARTS = 16
PART_BYTES, PART_BITS = 4096 // PARTS, 32_768 // PARTS


@dataclass(frozen=True)
class Rule:
    """A secret's kind and Java regular expression.

    ``group`` of a match must have ``least`` characters; a shorter match is dropped but still consumes
    its text.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def trigram_query(self) -> list[frozenset[str]]:
        """Alternatives of mandatory trigrams; empty when some alternative has none."""
        return trigram_query(self.pattern)


BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # The length is part of the pattern: the runs found are the same, short ones need not be listed.
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


def trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for alternative in r.trigram_query() for t in alternative})


def slot(key: str, text: str, slots: int) -> Column:
    """1 .. ``slots`` by a hash of key and text; null or not, no value gathers rows of different texts."""
    return F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(slots)) + 1


def postings(docs: DataFrame, key: str, text: str, rules: Sequence[Rule], slots: int) -> DataFrame:
    """(trigram, block, bits): which slots of a block of slots hold the trigram, in any case.

    Only trigrams of some rule's query are indexed.
    """
    wanted = trigrams(rules)
    lowered = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    held = let(lowered, lambda t: F.array_compact(F.array(*[
        F.when(F.contains(t, F.lit(x)), F.lit(x)) for x in wanted]))) if wanted else F.array().cast("array<string>")
    rows = docs.select(slot(key, text, slots).alias("id"), F.explode(held).alias("trigram"))
    return rows.groupBy("trigram", F.bitmap_bucket_number("id").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The bitmaps of candidate ids by rule (those with a trigram query): a row per part of a block.

    Parts keep the rows that meet one bitmap few, however few blocks the ids fill.
    """
    spark = index.sparkSession
    needs = [(r.kind, n, len(a), t) for r in rules for n, a in enumerate(r.trigram_query()) for t in sorted(a)]
    query = spark.createDataFrame(needs or [("", 0, 1, "")], "kind string, alternative int, needed int, trigram string")
    every = index.join(F.broadcast(query), "trigram").groupBy("block", "kind", "alternative", "needed").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("present"))
    either = every.filter(F.col("present") == F.col("needed")).groupBy("block", "kind").agg(
        F.bitmap_or_agg("bits").alias("bits"))
    whole = either.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("kind", "bits"))).alias("maps"))
    cut = whole.select("block", "maps", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return cut.select("block", "part", F.transform_values("maps", lambda _, bits: F.substring(
        bits, F.col("part") * PART_BYTES + 1, F.lit(PART_BYTES))).alias("maps"))


def in_bitmap(bits: Column, position: Column) -> Column:
    """Is the bit set? A null bitmap holds nothing."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches that are long enough, leftmost and non-overlapping, as (start, order, kind, end)."""
    kind = "array<struct<start:int,order:int,kind:string,end:int>>"
    chunk = 256

    def grown(a: Column, x: Column) -> Column:
        return a + x["gap"] + x["size"]

    def located(steps: Column, start: Column) -> Column:
        return F.aggregate(
            steps, F.struct(start.alias("at"), F.array().cast(kind).alias("found")),
            lambda a, x: F.struct(
                grown(a["at"], x).alias("at"),
                F.when(x["counts"], F.concat(a["found"], F.array(F.struct(
                    (a["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
                    grown(a["at"], x).alias("end"))))).otherwise(a["found"]).alias("found")),
            lambda a: a["found"])

    def starts(chunks: Column) -> Column:
        return F.aggregate(
            F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), grown)),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"])

    def walk(wholes: Column, gaps: Column, measured: Column) -> Column:
        # Lists grow within a chunk only: appending to one of all matches would copy it for every match.
        steps = F.transform(wholes, lambda w, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"), F.length(w).alias("size"),
            (F.length(F.get(measured, i)) >= rule.least).alias("counts")))
        cut = let(steps, lambda s: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / chunk).cast("int")),
            lambda n: F.slice(s, n * chunk + 1, F.lit(chunk))))
        return let(cut, lambda chunks: let(starts(chunks), lambda begun: F.flatten(
            F.transform(chunks, lambda c, n: located(c, F.get(begun, n))))))

    def of(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))

    found = let(F.struct(of(0).alias("w"), F.split(text, rule.pattern, -1).alias("g"), of(rule.group).alias("m")),
                lambda x: walk(x["w"], x["g"], x["m"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``spans``: array<struct<start, order, kind, end>> sorted by start, then by the rules' order.

    Null text is empty and holds nothing. Keys may be null or repeated; each row is matched by itself, and
    equal rows share a slot. A very long text takes time in proportion to its length and matches. Other
    columns pass through; a column named ``spans`` is replaced.
    """
    kept = [c for c in docs.columns if c != "spans"]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    slots = max(1, source.count())
    found = candidates(postings(source, key, text, rules, slots), rules)
    own = slot(key, text, slots)
    position = F.bitmap_bit_position(own)
    names = {"block": "posting block", "part": "posting part", "maps": "posting maps"}
    placed = source.withColumns({
        names["block"]: F.bitmap_bucket_number(own), names["part"]: F.floor(position / PART_BITS).cast("int")})
    blocked = placed.join(found.withColumnsRenamed(names), [names["block"], names["part"]], "left")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def matched(rule: Rule, order: int) -> Column:
        here = spans(body, rule, order)
        if not rule.trigram_query():
            return here
        return F.when(in_bitmap(F.element_at("posting maps", rule.kind), position % PART_BITS), here)

    every = F.concat(*[F.coalesce(matched(r, n), F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))
                       for n, r in enumerate(rules)])
    return blocked.select(*[F.col(f"`{c}`") for c in kept], F.sort_array(every).alias("spans"))


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return rows.select(key, *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
