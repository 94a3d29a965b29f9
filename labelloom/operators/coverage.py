"""Thin labels and templated example prompts for them."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.columns import let, str_array
from labelloom.functions.sizing import small_side
from labelloom.session import cut_lineage

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrasing families. {desc}, {desc_lc}, {noun} and {noun_singular} are slots.
TEMPLATES = {
    "read": (
        "{desc}",
        "Can you {desc_lc}?",
        "Show me {noun}",
        "What is {noun}?",
        "I need to see {noun}",
        "Look up {noun} for this repo",
        "Check {noun}",
        "Display {noun}",
    ),
    "list": (
        "{desc}",
        "List {noun}",
        "Show all {noun}",
        "What {noun} exist?",
        "Give me every {noun_singular}",
    ),
    "create": ("{desc}", "Create {noun}", "Add {noun}", "Set up {noun}", "I want to add {noun}"),
    "update": ("{desc}", "Update {noun}", "Change {noun}", "Modify {noun}", "Edit {noun}"),
    "delete": ("{desc}", "Delete {noun}", "Remove {noun}", "Get rid of {noun}"),
    "run": ("{desc}", "Run {noun}", "Trigger {noun}", "Execute {noun}", "Kick off {noun}"),
    "search": ("{desc}", "Search for {noun}", "Find {noun}", "Look for {noun}"),
    "write": ("{desc}", "Write {noun}", "Add {noun}", "Post {noun}", "Submit {noun}"),
}
# Description phrasings used once the family is exhausted.
FALLBACK_TEMPLATES = (
    "{desc}.",
    "Could you {desc_lc}?",
    "I'd like to {desc_lc}.",
    "Please {desc_lc}.",
    "Can you help me {desc_lc}?",
    "I need you to {desc_lc}.",
    "Would you {desc_lc}?",
    "Go ahead and {desc_lc}.",
    "For this repo, {desc_lc}.",
    "Right now I need to {desc_lc}.",
)
# Capability words that say nothing about a label.
GENERIC_WORDS = (
    "read", "get", "list", "operation", "single item lookup", "write",
    "bulk listing", "create", "update", "delete",
)
ROUNDS = 6  # passes over a template family, each with another noun variant
MAX_CANDIDATES = 200_000  # texts sent to every task when looking for existing ones


def thin_labels(catalog: DataFrame, counts: DataFrame, target: int = 10) -> DataFrame:
    """Catalog labels with fewer than ``target`` positives, and how many are needed."""
    have = F.coalesce("n", F.lit(0))
    return (
        catalog.join(counts.select("label", "n"), "label", "left")
        .filter(have < target)
        .select(*catalog.columns, have.cast("long").alias("have"), (F.lit(target) - have).cast("long").alias("need"))
    )


def template_family(label: Column, operation: Column, category: Column) -> Column:
    """Phrasing family from the label's name, then from the operation type."""
    name = F.lower(label)
    # The prefixes and their order decide the family.

    def starts(*prefixes: str) -> Column:
        out = F.startswith(name, F.lit(prefixes[0]))
        for p in prefixes[1:]:
            out = out | F.startswith(name, F.lit(p))
        return out

    return (
        F.when(starts("list") | ((category == "repository_stars") & F.contains(name, F.lit("list"))), "list")
        .when(starts("create", "fork"), "create")
        .when(starts("update", "edit"), "update")
        .when(starts("delete", "dismiss", "unstar"), "delete")
        .when(starts("search"), "search")
        .when(F.contains(name, F.lit("trigger")) | starts("run", "merge"), "run")
        .when(F.endswith(name, F.lit("_write")) | starts("add", "push", "star"), "write")
        .when(operation == "read", "read")
        .otherwise("write")
    )


def noun_phrase(capabilities: Column, category: Column, variant: Column) -> Column:
    """One to three telling capability words in a variant-dependent order, else the category in words."""
    telling = F.filter(
        F.coalesce(capabilities, str_array([])),
        lambda c: ~F.lower(c).isin(*GENERIC_WORDS) & (F.char_length(c) > 2),
    )

    def phrase(arg: Column) -> Column:
        v, caps = arg["v"], arg["caps"]
        keyed = F.transform(
            caps, lambda c: F.struct(F.md5(F.concat(v.cast("string"), F.lit("|"), c)).alias("k"), c.alias("c"))
        )
        ordered = F.transform(F.array_sort(keyed), lambda k: k["c"])
        n = F.lit(1) + v % F.greatest(F.least(F.lit(3), F.size(caps)), F.lit(1))
        picked = F.array_join(F.slice(ordered, F.lit(1), n), " ")
        return F.when(F.size(caps) == 0, arg["cat"]).otherwise(picked)

    plain = F.replace(category, F.lit("_"), F.lit(" "))
    return let(F.struct(variant.cast("int").alias("v"), telling.alias("caps"), plain.alias("cat")), phrase)


def _fill(template: Column, slots: dict[str, Column]) -> Column:
    """All slots in one step: braces inside a filled-in value stay as they are."""

    def piece(p: Column) -> Column:
        out = p
        for name, value in slots.items():
            out = F.when(p == "{" + name + "}", value).otherwise(out)
        return out

    pieces = F.split(template, r"(?=\{)|(?<=\})")
    return F.array_join(F.transform(pieces, piece), "")


def _capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def render(thin: DataFrame) -> DataFrame:
    """(pos, label, need, attempt, text): distinct candidate texts per label in order of preference.

    ``thin`` has pos, label, description, category, need and optionally capabilities and
    operation_type. Work is bounded by the catalog: at most 8 * ROUNDS + 10 rows per label, all of
    which are kept, so a label stays short only when its phrasings are exhausted.
    """
    columns = thin.columns
    capabilities = F.col("capabilities") if "capabilities" in columns else F.lit(None).cast("array<string>")
    operation = F.coalesce("operation_type", F.lit("read")) if "operation_type" in columns else F.lit("read")
    desc = F.regexp_replace("description", r"\.+$", "")
    lowered = F.concat(F.lower(F.substring("desc", 1, 1)), F.substr("desc", F.lit(2)))
    base = (
        thin.select("pos", "label", "need", "category", desc.alias("desc"), capabilities.alias("caps"),
                    template_family(F.col("label"), operation, F.col("category")).alias("family"))
        .withColumn("desc_lc", lowered)
    )
    families = F.create_map(*[x for k, ts in TEMPLATES.items() for x in (F.lit(k), str_array(ts))])
    own = base.select("*", F.posexplode(F.flatten(F.array_repeat(F.element_at(families, F.col("family")), ROUNDS))).alias("attempt", "template"))
    noun = noun_phrase(F.col("caps"), F.col("category"), F.col("attempt"))
    own = own.withColumn("noun", noun)
    singular = F.when(F.col("noun") != "", F.substring_index("noun", " ", 1)).otherwise(F.col("category"))
    own_text = _capitalised(
        _fill(F.col("template"), {"desc_lc": F.col("desc_lc"), "desc": F.col("desc"),
                                  "noun_singular": singular, "noun": F.col("noun")})
    )
    closed = F.when(F.col("text").rlike(r"[?.]$"), F.col("text")).otherwise(F.concat("text", F.lit(".")))
    own = own.select("pos", "label", "need", "attempt", own_text.alias("text")).withColumn("text", closed)
    extra = base.select("*", F.posexplode(str_array(FALLBACK_TEMPLATES)).alias("i", "template")).select(
        "pos", "label", "need", (F.col("i") + 1000).alias("attempt"),
        _capitalised(_fill(F.col("template"), {"desc_lc": F.col("desc_lc"), "desc": F.col("desc")})).alias("text"),
    )
    return own.unionByName(extra).groupBy("pos", "label", "need", "text").agg(F.min("attempt").alias("attempt"))


def already_present(existing: DataFrame, candidates: DataFrame, text: str = "prompt") -> DataFrame:
    """The candidate texts that a corpus of any size already holds.

    The corpus is filtered where it lies: the rendered candidates, a few dozen per label, are the
    broadcast side. Only a set beyond the bound makes Spark shuffle the corpus.
    """
    wanted = small_side(candidates.select("text").distinct(), MAX_CANDIDATES)
    return existing.select(F.col(text).alias("text")).join(wanted, "text", "left_semi").distinct()


def _forest(links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Smallest label linked with each label, over all chains of links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def colliding_groups(fresh: DataFrame) -> DataFrame:
    """(pos, component) of the labels that share a candidate text with another one, directly or over others.

    Tasks reduce their links to a spanning forest, one row per label at most, and one task joins the
    forests: its work is that of the catalog's length, and two steps serve chains of any length.
    """
    shared = fresh.groupBy("text").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).filter("a < b")
    links = fresh.join(shared.select("text", "a"), "text").filter("pos > a").select(
        F.col("a").cast("long").alias("a"), F.col("pos").cast("long").alias("b"))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _forest(link for b in batches for link in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pydict({"pos": pa.array(found, pa.int64()), "component": pa.array(found.values(), pa.int64())})

    schema = "pos long, component long"
    return links.mapInArrow(reduced, schema).repartition(1).mapInArrow(reduced, schema)


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """Labels of a component in turn; each takes its first free texts."""
    seen: set[str] = set()
    kept = []
    for _, own in group.sort_values(["pos", "attempt"]).groupby("pos", sort=True):
        left = int(own["need"].iloc[0])
        for at, text in zip(own.index, own["text"], strict=True):
            if left > 0 and text not in seen:
                seen.add(text)
                kept.append(at)
                left -= 1
    return group.loc[kept].drop(columns="component")


def pick_new(candidates: DataFrame, existing: DataFrame, text: str = "prompt") -> DataFrame:
    """At most ``need`` unseen texts per label; an earlier label takes a text before a later one.

    A label takes only its first ``need`` free texts, so what a later label may use depends on what
    the earlier ones really took. Labels whose candidates meet no other label's take theirs at once; the
    others are settled component by component, each in one walk.
    """
    rendered = cut_lineage(candidates.select("pos", "label", "need", "attempt", "text"))
    fresh = cut_lineage(rendered.join(already_present(existing, rendered, text), "text", "left_anti").select(*rendered.columns))
    groups = small_side(cut_lineage(colliding_groups(fresh)))
    order = W.partitionBy("pos", "label").orderBy("attempt")
    free = fresh.join(groups, "pos", "left_anti").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("need"))
    walked = fresh.join(groups, "pos").groupBy("component").applyInPandas(_walk, fresh.schema)
    return free.drop("_r").select(*fresh.columns).unionByName(walked)


def merge_corpus(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing prompt records plus the new texts as records of their label; existing ones win."""
    records = new.select(F.col("text").alias("prompt"), F.array("label").alias("relevant_tools"))
    return existing.select("prompt", "relevant_tools").unionByName(
        records.join(already_present(existing, new).withColumnRenamed("text", "prompt"), "prompt", "left_anti")
    )
