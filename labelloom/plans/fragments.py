"""SQL fragments shared by the side-by-side checks, and the inputs they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import hash_bucket, str_array
from labelloom.functions.labels import membership
from labelloom.sources.catalogs import label_names

SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def sql_norm(text: str = "text") -> str:
    return f"trim(regexp_replace(lower({text}), '{SPACE}+', ' ', 'g'))"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_words(text: str = "t") -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def sql_bucket(key: str, n: int = 1000) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {n})"


# Labels: languages and sources of the documents; every document holds one of each.
LABELS = """labs AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS pos
  FROM (SELECT lang AS label FROM documents UNION SELECT source FROM documents))"""
TRUTH = LABELS + f""", truth AS (
  SELECT d.doc_id, l.pos, l.label, CAST(d.lang = l.label OR d.source = l.label AS INTEGER) AS y,
         {sql_bucket("d.doc_id || '|' || l.label")} / 1000.0::DOUBLE AS score
  FROM documents d CROSS JOIN labs l)"""
CUTS = "cuts AS (SELECT CAST(CAST(0.10 + 0.05 * i AS DECIMAL(4,2)) AS DOUBLE) AS t FROM range(17) r(i))"
SWEEP = CUTS + """, swept AS (
  SELECT label, t, sum(y) FILTER (score >= t) AS tp, count(*) FILTER (score >= t) AS sel,
         sum(y) AS p, count(*) AS n
  FROM truth, cuts GROUP BY label, t),
f AS (SELECT label, t, p, n, CASE WHEN sel + p = 0 THEN 0.0 ELSE 2.0 * coalesce(tp, 0) / (sel + p) END AS f1 FROM swept),
best AS (SELECT label, p, n, t, f1, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS r FROM f)"""
TUNED = SWEEP + """, tuned AS (
  SELECT label, CASE WHEN p > 0 AND p < n THEN greatest(t, 0.3::DOUBLE) ELSE 0.5::DOUBLE END AS threshold
  FROM best WHERE r = 1)"""
COUNTED = """counted AS (
  SELECT t.pos, t.label, count(*) FILTER (score >= threshold AND y = 1) AS tp,
         count(*) FILTER (score >= threshold AND y = 0) AS fp,
         count(*) FILTER (score < threshold AND y = 0) AS tn,
         count(*) FILTER (score < threshold AND y = 1) AS fn
  FROM truth t JOIN tuned USING (label) GROUP BY t.pos, t.label),
scored AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1
  FROM counted)"""
METRICS = TRUTH + ", " + TUNED + ", " + COUNTED


def hash_scores(key: Column, labels: list[str]) -> Column:
    """Deterministic scores in [0, 1) that SQL can reproduce."""
    prefix = F.concat(key.cast("string"), F.lit("|"))
    return F.transform(str_array(labels), lambda l: hash_bucket(F.concat(prefix, l), 1000) / F.lit(1000.0))


def document_labels(docs: DataFrame) -> list[str]:
    return sorted(set(label_names(docs, "lang")) | set(label_names(docs, "source")))


def labelled(docs: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, prompt, y) of the documents."""
    return docs.select("doc_id", F.col("text").alias("prompt"), membership(F.array("lang", "source"), labels).alias("y"))


def scored(docs: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, y, scores) with deterministic scores; the text is never read."""
    return docs.select(
        "doc_id",
        membership(F.array("lang", "source"), labels).alias("y"),
        hash_scores(F.col("doc_id"), labels).alias("scores"),
    )
