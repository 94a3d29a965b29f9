"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage works on what the one before kept and is written as Parquet before the next reads it.
Nulls: a null text has no words and does not pass the quality rules; a null key is judged like any
other row. Empty tables pass through all stages. Columns of ``documents`` that the stages do not
use travel along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, decontaminate, line_dedup, quality, set_dedup, simhash
from labelloom.llm.vocabularies import vocabulary
from labelloom.session import discard, work_path

#: EM and hash-based near-dedup have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


CARRIED = "carried"


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name can meet an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias(CARRIED)] if others else []))


def unpack(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``pack`` has put away, in their old order."""
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else F.col(CARRIED)[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return unpack(quality.judge(pack(docs)).filter("q_kept"), docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; ``n_chars`` follows the text.

    A document that has lost lines and has no word left goes.
    """
    packed = pack(docs)
    more = tuple(c for c in packed.columns if c == CARRIED)
    kept = line_dedup.drop_lines(packed, more=more).filter((F.col("n_dropped") == 0) | F.col("kept").rlike("[^ \\t-\\r]"))
    out = unpack(kept.withColumnRenamed("kept", "text"), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by a Jaccard similarity of 0.8.

    SimHash finds the candidates, their shingle sets decide, and a prefix join adds what fingerprints miss.
    """
    return unpack(simhash.keep_one(pack(docs), near=set_dedup.near_duplicates), docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return unpack(decontaminate.contaminate(pack(docs), items).filter(~F.col("contaminated")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, checked by decoding."""
    done = bpe.encode_decode(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_common_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", remove_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result is written to the shared folder and read again.

    A stage's rows are deleted when the next one's are written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
