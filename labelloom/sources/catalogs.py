"""Label catalogs: reading, building and looking up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.sizing import MAX_LABELS, bounded_rows, small_side

_ENTRY = "map<string,struct<description:string,category:string,use_when:string>>"
_META = "struct<__meta__:struct<version:string>>"


def catalog_entries(files: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., pos, label, description, category, use_when, version) from catalog JSON texts, one per row.

    Keys starting with ``__`` are not labels. Missing description gives '', missing category and
    version give 'unknown'. ``pos`` is the order inside the text.
    """
    parsed = files.select(
        *keep,
        F.from_json(value, _META)["__meta__"]["version"].alias("version"),
        F.filter(
            F.map_entries(F.from_json(value, _ENTRY)), lambda e: ~F.startswith(e["key"], F.lit("__"))
        ).alias("entries"),
    )
    return parsed.select(*keep, "version", F.posexplode("entries").alias("pos", "e")).select(
        *keep,
        "pos",
        F.col("e.key").alias("label"),
        F.coalesce("e.value.description", F.lit("")).alias("description"),
        F.coalesce("e.value.category", F.lit("unknown")).alias("category"),
        "e.value.use_when",
        F.coalesce("version", F.lit("unknown")).alias("version"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog file (one JSON object) as a table."""
    return catalog_entries(spark.read.text(path, wholetext=True))


def describe_labels(df: DataFrame, catalog: DataFrame, label: str = "label") -> DataFrame:
    """Catalog lookup: description ('' if unknown), category ('unknown') and a membership flag."""
    side = catalog.select(
        F.col("label").alias(label), "description", "category", F.lit(True).alias("in_catalog")
    )
    return df.join(small_side(side), label, "left").select(
        *df.columns,
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"),
    )


def read_tool_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, description, category) from a JSON document with a ``tools`` list."""
    schema = "struct<tools:array<struct<name:string,description:string,category:string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return doc.select(F.posexplode("d.tools").alias("pos", "t")).select("pos", "t.*")


def catalog_from_tools(tools: DataFrame) -> DataFrame:
    """Catalog from (pos, name, description, category): names trimmed, blank ones dropped.

    A later entry of the same name replaces the earlier one but keeps its place.
    """
    named = tools.withColumn("label", tx.strip(F.col("name")))
    last = F.max_by(F.struct("description", "category"), "pos")
    return (
        named.filter(~tx.is_blank(F.col("label")))
        .groupBy("label")
        .agg(F.min("pos").alias("pos"), last.alias("e"))
        .select(
            "pos",
            "label",
            F.coalesce("e.description", F.lit("")).alias("description"),
            F.coalesce("e.category", F.lit("unknown")).alias("category"),
        )
    )


def catalog_from_keywords(keywords: DataFrame) -> DataFrame:
    """Catalog from (label, keyword, pos) rows when no description exists; keywords keep order and repeats.

    A catalog is a dimension: a label's keyword list is one cell of it.
    """
    return keywords.groupBy("label").agg(
        F.concat(F.lit("Tool: "), F.col("label")).alias("description"),
        F.lit("auto").alias("category"),
        F.array_sort(F.collect_list(F.struct("pos", "keyword")))["keyword"].alias("keywords"),
    )


def label_names(df: DataFrame, column: str = "label", bound: int = MAX_LABELS) -> list[str]:
    """Distinct names of a label column, sorted; the list is a schema, so its size is checked."""
    rows = bounded_rows(df.select(column).where(F.col(column).isNotNull()).distinct(), bound, f"labels in {column}")
    return sorted(r[0] for r in rows)


def ordered_labels(catalog: DataFrame, bound: int = MAX_LABELS) -> list[str]:
    """Labels of a catalog table in catalog order."""
    rows = bounded_rows(catalog.select("pos", "label"), bound, "catalog")
    return [r["label"] for r in sorted(rows, key=lambda r: r["pos"])]


def catalog_frame(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """(pos, label) of a label list, as a broadcast side while the list is within its bound."""
    out = spark.createDataFrame(list(enumerate(labels)), "pos int, label string")
    return F.broadcast(out) if len(labels) <= MAX_LABELS else out
