"""Queries over text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.operators import features
from labelloom.plans import fragments as fr
from labelloom.plans.registry import query, texts

# Keyword groups of the text queries; substring matches on normalised text.
GROUPS = [
    ("de", ("der", "und ", "nicht", "ü")),
    ("en", (" the ", " and ", "ing")),
    ("es", (" el ", " que ", "ción")),
    ("fr", (" le ", " et ", "eau", "ê")),
    ("symbols", ("%%%", "###", "***", "http")),
]
MAX_FEATURES = 3000

_NORMED = f"n AS (SELECT doc_id, {fr.sql_norm()} AS t FROM documents)"
_GRAMS = _NORMED + f""", w AS (SELECT doc_id, {fr.sql_words()} AS w FROM n),
g AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w)"""
_VOCAB = _GRAMS + f""", tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM g) GROUP BY ALL),
counts AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, term, cf, df, n_docs,
         ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT *, (SELECT count(*) FROM documents) AS n_docs FROM counts ORDER BY cf DESC, term LIMIT {MAX_FEATURES}))"""
_TFIDF = _VOCAB + """, raw AS (
  SELECT doc_id, idx, term, (1.0 + ln(tf::DOUBLE)) * idf AS x FROM tf JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, idx, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS value FROM raw)"""


def _flag_sql(phrases, text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_STRUCT = {
    "struct__char_length": "least(length(t) / 200.0::DOUBLE, 1.0)",
    "struct__word_count": "least(len(list_filter(string_split(t, ' '), lambda x: x <> '')) / 30.0::DOUBLE, 1.0)",
    "struct__has_parentheses": "CAST(contains(t, '(') OR contains(t, ')') AS DOUBLE)",
    "struct__has_dot_notation": "CAST(contains(t, '.') AS DOUBLE)",
    "struct__has_underscore": "CAST(contains(t, '_') AS DOUBLE)",
    "struct__has_question_mark": "CAST(contains(t, '?') AS DOUBLE)",
    "struct__has_file_extension": "CAST(regexp_matches(t, '(?i)\\.(" + "|".join(tx.FILE_EXTENSIONS) + ")$') AS DOUBLE)",
    "struct__starts_with_verb": "CAST(split_part(t, ' ', 1) IN ("
    + ", ".join(f"'{v}'" for v in tx.ACTION_VERBS)
    + ") AS DOUBLE)",
}


def _docs(spark, sf):
    return texts(spark, sf).select("doc_id", F.col("text").alias("prompt"))


def _vocabulary(spark, sf):
    return features.fit_vocabulary(_docs(spark, sf), "prompt", MAX_FEATURES)


@query("e1_normalize", f"SELECT doc_id, md5({fr.sql_norm()}) AS norm_md5 FROM documents")
def normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.normalize(F.col("prompt"))).alias("norm_md5"))


@query("e2_word_tokens", f"""
WITH {_NORMED}
SELECT doc_id, len({fr.sql_words()}) AS n_words, md5(array_to_string({fr.sql_words()}, ' ')) AS words_md5 FROM n""")
def word_tokens(spark, sf):
    rows = _docs(spark, sf).select("doc_id", tx.words(tx.normalize(F.col("prompt"))).alias("w"))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5")
    )


@query("e3_ngrams", f"""
WITH {_GRAMS}
SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM g""")
def ngrams(spark, sf):
    rows = _docs(spark, sf).select("doc_id", features.grams_of(F.col("prompt")).alias("g"))
    return rows.select(
        "doc_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("grams_md5")
    )


@query("e4_e5_vocabulary", f"""
WITH {_VOCAB}
SELECT idx, term, cf, df, n_docs, round(idf, 6) AS idf FROM vocab""")
def vocabulary(spark, sf):
    return _vocabulary(spark, sf).withColumn("idf", F.round("idf", 6))


@query("e4_term_counts_min_df", f"""
WITH {_VOCAB}
SELECT term, cf, df FROM counts WHERE df >= 5""")
def term_counts_min_df(spark, sf):
    return features.term_counts(_docs(spark, sf)).filter((F.col("df") >= 5) & (F.col("term") != features.DOCUMENTS))


@query("e6_e8_tfidf", f"""
WITH {_TFIDF}
SELECT doc_id, term, round(value, 6) AS value FROM tfidf""")
def tfidf(spark, sf):
    docs = _docs(spark, sf)
    space = features.space_from_vocabulary(_vocabulary(spark, sf))
    cells = features.features_long(features.encode(docs, space), space, ["doc_id"])
    return cells.filter(F.col("idx") < len(space.terms)).select(
        "doc_id", F.col("feature").alias("term"), F.round("value", 6).alias("value")
    )


@query("e6_e8_tfidf_by_join", f"""
WITH {_TFIDF}
SELECT doc_id, term, round(value, 6) AS value FROM tfidf""")
def tfidf_by_join(spark, sf):
    return features.tfidf_by_join(_docs(spark, sf), _vocabulary(spark, sf), "doc_id").withColumn(
        "value", F.round("value", 6)
    )


@query("e9_keyword_flags", f"""
WITH {_NORMED}
SELECT doc_id, {", ".join(f"{_flag_sql(kws)} AS kw_{label}" for label, kws in GROUPS)} FROM n""")
def keyword_flags(spark, sf):
    rows = _docs(spark, sf).select("doc_id", tx.keyword_flags(tx.normalize(F.col("prompt")), GROUPS).alias("k"))
    return rows.select("doc_id", *[F.get("k", F.lit(i)).alias(f"kw_{label}") for i, (label, _) in enumerate(GROUPS)])


@query("j_contains_phrases", f"""
WITH n AS (SELECT page_id, {fr.sql_norm("html")} AS t FROM pages)
SELECT page_id FROM n WHERE contains(t, 'href') AND {_flag_sql(("&amp;", "&nbsp;", "***"))}""")
def contains_phrases(spark, sf):
    pages = texts(spark, sf, "pages").select("page_id", tx.normalize(F.col("html")).alias("t"))
    return pages.filter(F.contains("t", F.lit("href")) & tx.contains_any(F.col("t"), ["&amp;", "&nbsp;", "***"])).select("page_id")


@query("e10_e17_structural_documents", f"""
WITH {_NORMED}
SELECT doc_id, {", ".join(f"{sql} AS {name}" for name, sql in _STRUCT.items())} FROM n""")
def structural_documents(spark, sf):
    norm = _docs(spark, sf).select("doc_id", tx.normalize(F.col("prompt")).alias("t"))
    return norm.select("doc_id", *[c.alias(n) for n, c in zip(tx.STRUCTURAL_NAMES, tx.structural(F.col("t")))])


@query("e10_e17_structural_urls", f"""
WITH n AS (SELECT page_id, {fr.sql_norm("CASE page_id % 4 WHEN 0 THEN 'Open ' || url WHEN 1 THEN url || '/readme.MD' WHEN 2 THEN 'what is ' || url || '?' ELSE url END")} AS t FROM pages)
SELECT page_id, {", ".join(f"{sql} AS {name}" for name, sql in _STRUCT.items())} FROM n""")
def structural_urls(spark, sf):
    kind = F.col("page_id") % 4
    prompt = (
        F.when(kind == 0, F.concat(F.lit("Open "), "url"))
        .when(kind == 1, F.concat("url", F.lit("/readme.MD")))
        .when(kind == 2, F.concat(F.lit("what is "), "url", F.lit("?")))
        .otherwise(F.col("url"))
    )
    norm = texts(spark, sf, "pages").select("page_id", tx.normalize(prompt).alias("t"))
    return norm.select("page_id", *[c.alias(n) for n, c in zip(tx.STRUCTURAL_NAMES, tx.structural(F.col("t")))])


_ALL = _TFIDF + ", allf AS (\n  SELECT doc_id, idx, value FROM tfidf\n" + "\n".join(
    f"  UNION ALL SELECT doc_id, (SELECT count(*) FROM vocab) + {i}, CAST({_flag_sql(kws)} AS DOUBLE) FROM n"
    for i, (_, kws) in enumerate(GROUPS)
) + "\n" + "\n".join(
    f"  UNION ALL SELECT doc_id, (SELECT count(*) FROM vocab) + {len(GROUPS) + i}, {sql} FROM n"
    for i, sql in enumerate(_STRUCT.values())
) + ")"


@query("e18_feature_matrix", f"""
WITH {_ALL}
SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value FROM allf WHERE value <> 0""")
def feature_matrix(spark, sf):
    docs = _docs(spark, sf)
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    return features.features_long(features.encode(docs, space), space, ["doc_id"]).select(
        "doc_id", "idx", F.round("value", 6).alias("value")
    )


@query("e19_feature_registry", f"""
WITH {_VOCAB}
SELECT idx, term AS feature, 'tfidf' AS block FROM vocab
UNION ALL SELECT CAST((SELECT count(*) FROM vocab) + i AS INTEGER), f, b FROM (VALUES
{", ".join([f"({i}, 'keyword__{l}', 'keyword')" for i, (l, _) in enumerate(GROUPS)]
           + [f"({len(GROUPS) + i}, '{n}', 'structural')" for i, n in enumerate(tx.STRUCTURAL_NAMES)])}) AS v(i, f, b)""")
def feature_registry(spark, sf):
    return features.registry(_vocabulary(spark, sf), [l for l, _ in GROUPS])
