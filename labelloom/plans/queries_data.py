"""Queries over sources, adapters, quality and splits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.functions import text as tx
from labelloom.functions.columns import str_array
from labelloom.operators import adapters, metrics, quality, split
from labelloom.plans import fragments as fr
from labelloom.plans.registry import query, table, texts
from labelloom.session import work_path
from labelloom.sources import catalogs, prompts, runs

EVENT_TOOLS = ["view", "click", "purchase", "signup"]
FLAGS = ["A", "N", "R"]

_PAIRED = """
SELECT p.prompt, l.label, coalesce(m.y, 0)::INTEGER AS y
FROM (SELECT DISTINCT {key} AS prompt FROM {src} WHERE {tool} IN ({names})) p
CROSS JOIN (SELECT unnest([{names}]) AS label) l
LEFT JOIN (SELECT {key} AS prompt, {tool} AS label, max(CAST({cond} AS INTEGER)) AS y FROM {src} GROUP BY ALL) m
  ON m.prompt = p.prompt AND m.label = l.label"""


def _paired(key: str, src: str, tool: str, names: list[str], cond: str) -> str:
    return _PAIRED.format(key=key, src=src, tool=tool, names=", ".join(f"'{n}'" for n in names), cond=cond)


LINEITEM_SQL = _paired("CAST(l_orderkey AS VARCHAR)", "lineitem", "l_returnflag", FLAGS, "l_discount > 0.05")
EVENTS_SQL = _paired("CAST(user_id AS VARCHAR)", "events", "event_type", EVENT_TOOLS, "value > 150")


def _lineitem_pairs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("prompt"),
        F.col("l_returnflag").alias("tool"),
        (F.col("l_discount") > 0.05).cast("int").alias("label"),
    )


def _event_pairs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("prompt"),
        F.col("event_type").alias("tool"),
        (F.col("value") > 150).cast("int").alias("label"),
    )


def _long(df, labels, key="prompt"):
    return lb.to_long(df, labels, [key]).select(key, "label", "y")


# --- sources ---------------------------------------------------------------------------------

@query("a1_load_labelled_csv", LINEITEM_SQL)
def load_labelled_csv(spark, sf):
    path = work_path(spark, "pairs-csv")
    _lineitem_pairs(spark, sf).write.option("header", True).csv(path)
    return _long(prompts.load_labelled(spark, path, FLAGS, multiline=False), FLAGS)


_RECORDS_SQL = """
SELECT CASE WHEN doc_id % 7 = 0 THEN '' ELSE md5(text) END AS prompt_md5,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || ',' || source END AS tools, count(*) AS n
FROM documents GROUP BY ALL"""


def _records(spark, sf):
    return texts(spark, sf).select(
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("prompt"),
        F.when(F.col("doc_id") % 5 != 0, F.array("lang", "source")).alias("relevant_tools"))


def _counted(records):
    return records.groupBy(
        F.when(F.col("prompt") == "", "").otherwise(F.md5("prompt")).alias("prompt_md5"),
        F.array_join("relevant_tools", ",").alias("tools"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("a2_prompt_records", _RECORDS_SQL)
def prompt_records(spark, sf):
    path = work_path(spark, "records-json")
    _records(spark, sf).write.json(path)
    return _counted(prompts.read_prompt_records(spark, path))


@query("a2_prompt_record_lists", _RECORDS_SQL)
def prompt_record_lists(spark, sf):
    """Each file is one JSON list of records, on indented lines."""
    path = work_path(spark, "records-lists")

    def listed(batches):
        mark = "["
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": [f"{mark if i == 0 else ','}\n  {r}" for i, r in enumerate(
                batch.column(0).to_pylist())]})
            mark = "," if batch.num_rows else mark
        yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})

    _records(spark, sf).select(F.to_json(F.struct("prompt", "relevant_tools"))).mapInArrow(listed, "value string").write.text(path)
    return _counted(prompts.read_prompt_records(spark, path, multiline=True))


@query("a1_csv_with_line_breaks", """
SELECT md5(text) AS text_md5, lang, source, count(*) AS n FROM documents GROUP BY ALL""")
def csv_with_line_breaks(spark, sf):
    """Whole texts as quoted cells, commas, quotes and line breaks included."""
    path = work_path(spark, "texts-csv")
    texts(spark, sf).select("text", "lang", "source").write.option("header", True).option("escape", '"').option(
        "quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = prompts.read_table(spark, path, multiline=True)
    return found.groupBy(F.md5("text").alias("text_md5"), "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("a3_catalog_entries", """
SELECT p_partkey, 0 AS pos, p_name AS label, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS description,
       CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_brand END AS category,
       CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'v' || p_size END AS version
FROM part""")
def catalog_entries(spark, sf):
    part = table(spark, sf, "part")
    entry = F.to_json(
        F.struct(
            F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("description"),
            F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("category"),
        )
    )
    meta = F.to_json(F.struct(F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("v"), F.col("p_size"))).alias("version")))
    doc = F.concat(F.lit('{"__meta__":'), meta, F.lit(',"'), F.col("p_name"), F.lit('":'), entry,
                   F.lit(',"__draft":{"description":"x"}}'))
    files = part.select("p_partkey", doc.alias("value"))
    return catalogs.catalog_entries(files, "value", ["p_partkey"]).select(
        "p_partkey", "pos", "label", "description", "category", "version"
    )


def _half_unknown():
    """Part keys of line items, moved out of the catalog on odd lines."""
    return F.col("l_partkey") + F.col("l_linenumber") % 2 * 10_000_000


@query("a3_catalog_lookup", """
SELECT l_orderkey, l_linenumber, coalesce(p_name, '') AS description, coalesce(p_brand, 'unknown') AS category,
       p_partkey IS NOT NULL AS in_catalog
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + l_linenumber % 2 * 10000000""")
def catalog_lookup(spark, sf):
    catalog = table(spark, sf, "part").select(
        F.col("p_partkey").alias("label"), F.col("p_name").alias("description"), F.col("p_brand").alias("category")
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _half_unknown().alias("label"))
    return catalogs.describe_labels(rows, catalog).drop("label")


@query("a4_catalog_from_tools", """
WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS label, p_type, p_brand FROM part)
SELECT min(pos) AS pos, label, arg_max(p_type, pos) AS description, arg_max(p_brand, pos) AS category
FROM t WHERE label <> '' GROUP BY label""")
def catalog_from_tools(spark, sf):
    named = F.when(F.col("p_size") == 7, " \t ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t")))
    tools = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"), named.alias("name"),
        F.col("p_type").alias("description"), F.col("p_brand").alias("category"),
    )
    return catalogs.catalog_from_tools(tools)


@query("a5_catalog_from_keywords", """
SELECT p_brand AS label, 'Tool: ' || p_brand AS description, 'auto' AS category,
       string_agg(p_type, ',' ORDER BY p_partkey) AS keywords
FROM part GROUP BY p_brand""")
def catalog_from_keywords(spark, sf):
    pairs = table(spark, sf, "part").select(
        F.col("p_brand").alias("label"), F.col("p_type").alias("keyword"), F.col("p_partkey").alias("pos"))
    return catalogs.catalog_from_keywords(pairs).withColumn("keywords", F.array_join("keywords", ","))


@query("a6_long_table_sink", f"""
WITH {fr.LABELS}
SELECT label AS tool, count(*) AS rows, count(*) FILTER (d.lang = label OR d.source = label) AS positives
FROM documents d CROSS JOIN labs GROUP BY label""")
def long_table_sink(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    records = docs.select(F.col("doc_id").cast("string").alias("prompt"), F.array("lang", "source").alias("relevant_tools"))
    path = work_path(spark, "pairs")
    prompts.write_long_table(prompts.long_table(records, labels), path)
    return spark.read.parquet(path).groupBy("tool").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives")
    )


@query("a7_experiment_records", f"""
WITH {fr.METRICS}
SELECT 'hash' AS experiment_id, label, round(f1, 4) AS f1, tp, fp, tn, fn FROM scored""")
def experiment_records(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    rows = fr.scored(docs, labels)
    summary, per_label = _evaluated(rows, labels)
    path = work_path(spark, "runs")
    runs.append_run(
        path,
        summary.withColumns({"experiment_id": F.lit("hash"), "algorithm": F.lit("none")}),
        per_label.withColumns({"experiment_id": F.lit("hash"), "algorithm": F.lit("none")}),
    )
    _, stored = runs.read_runs(spark, path)
    return stored.select("experiment_id", "label", "f1", "tp", "fp", "tn", "fn")


def _evaluated(rows, labels):
    from labelloom.operators import thresholds

    cuts = thresholds.threshold_list(thresholds.tune(rows, labels), labels)
    return metrics.evaluate(rows, labels, cuts)


@query("a9_combined_sources", """
SELECT prompt, label, y, count(*) AS n FROM (
""" + LINEITEM_SQL + " UNION ALL " + LINEITEM_SQL.replace("l_discount > 0.05", "l_tax > 0.04") + """
) GROUP BY ALL""")
def combined_sources(spark, sf):
    pairs = _lineitem_pairs(spark, sf)
    taxed = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("prompt"),
        F.col("l_returnflag").alias("tool"),
        (F.col("l_tax") > 0.04).cast("int").alias("label"),
    )
    paths = {"synthetic": work_path(spark, "synthetic"), "manager": work_path(spark, "manager")}
    pairs.write.parquet(paths["synthetic"])
    taxed.write.parquet(paths["manager"])
    both = prompts.load_sources(spark, "combined", paths, FLAGS, "parquet")
    return _long(both, FLAGS).groupBy("prompt", "label", "y").agg(F.count(F.lit(1)).alias("n"))


@query("a10_run_record_source", f"""
WITH {fr.METRICS}
SELECT 'run' AS experiment_id, label, threshold, tp, fp, tn, fn FROM scored JOIN tuned USING (label)""")
def run_record_source(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    summary, per_label = _evaluated(fr.scored(docs, labels), labels)
    path = work_path(spark, "records")
    cell = F.struct("threshold", "precision", "recall", "f1", "auc", "tp", "fp", "tn", "fn")
    nested = per_label.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("label", cell))).alias("per_tool"))
    nested.select(F.lit("run").alias("experiment_id"), F.lit("none").alias("algorithm"), "per_tool").write.json(path)
    return runs.run_labels_of(runs.read_run_records(spark, path)).select(
        "experiment_id", "label", "threshold", "tp", "fp", "tn", "fn"
    )


# --- adapters --------------------------------------------------------------------------------

@query("b1_detect_schema", """
SELECT 'paired_rows' AS layout, count(*) AS n_rows FROM events
UNION ALL SELECT 'json_tools_col', count(*) FROM documents
UNION ALL SELECT 'canonical', count(*) FROM labels
UNION ALL SELECT 'unknown', count(*) FROM part""")
def detect_schema(spark, sf):
    docs = table(spark, sf, "documents")
    frames = [
        _event_pairs(spark, sf),
        docs.select(F.col("doc_id").alias("Prompt"), F.col("lang").alias("Tools")),
        table(spark, sf, "labels").withColumnRenamed("doc_id", "prompt"),
        table(spark, sf, "part"),
    ]
    out = None
    for df in frames:
        layout = adapters.detect_schema(df.columns, ["quality", "toxic"])
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(layout).alias("layout"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("b2_normalize_headers", """
SELECT event_type AS tool, count(*) AS n, count(*) FILTER (value > 150) AS label FROM events GROUP BY event_type""")
def normalize_headers(spark, sf):
    messy = _event_pairs(spark, sf).toDF("Prompt ", " TOOL", "Label")
    return adapters.normalize_headers(messy).groupBy("tool").agg(
        F.count("prompt").alias("n"), F.sum("label").alias("label")
    )


@query("b3_from_paired_rows", EVENTS_SQL)
def from_paired_rows(spark, sf):
    return _long(adapters.from_paired_rows(_event_pairs(spark, sf), EVENT_TOOLS), EVENT_TOOLS)


@query("b3_from_paired_rows_large", LINEITEM_SQL)
def from_paired_rows_large(spark, sf):
    return _long(adapters.from_paired_rows(_lineitem_pairs(spark, sf), FLAGS), FLAGS)


@query("b4_from_label_lists", f"""
WITH {fr.LABELS}
SELECT doc_id, label, CASE doc_id % 5
    WHEN 0 THEN CAST(lang = label OR source = label AS INTEGER)
    WHEN 1 THEN CAST(lang = label OR source = label AS INTEGER)
    WHEN 2 THEN CAST(lang = label AS INTEGER)
    WHEN 3 THEN CAST(source = label AS INTEGER)
    ELSE 0 END AS y
FROM documents CROSS JOIN labs""")
def from_label_lists(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    kind = F.col("doc_id") % 5
    cell = (
        F.when(kind == 0, F.concat(F.lit('["'), F.col("lang"), F.lit('", "'), F.col("source"), F.lit('"]')))
        .when(kind == 1, F.concat("lang", F.lit(" , ,"), "source", F.lit(",")))
        .when(kind == 2, F.concat(F.lit('"'), F.col("lang"), F.lit('"')))
        .when(kind == 3, F.concat(F.lit('{"'), F.col("source"), F.lit('": 1}')))
    )
    rows = docs.select("doc_id", F.col("text").alias("prompt"), cell.alias("tools"))
    return _long(adapters.from_label_lists(rows, labels, ["doc_id"]), labels, "doc_id")


@query("b5_validate_canonical", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(least(1, trunc(value / 100)) AS INTEGER)
                      WHEN event_id % 4 = 1 THEN 0 WHEN event_id % 4 = 2 THEN 0 ELSE 1 END AS y
FROM events WHERE event_id % 10 > 1""")
def validate_canonical(spark, sf):
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, (F.col("value") / 100).cast("string"))
        .when(kind == 1, F.concat(F.lit("-"), F.col("value").cast("string")))
        .when(kind == 2, F.lit("True"))
        .otherwise("Infinity")
    )
    blank = F.col("event_id") % 10
    prompt = F.when(blank == 1, " \t ").when(blank != 0, F.col("event_id").cast("string"))
    wide = table(spark, sf, "events").select("event_id", prompt.alias("prompt"), raw.alias("flagged"))
    valid = adapters.drop_blank(adapters.from_wide(wide, ["flagged"], ["event_id"]))
    return valid.select("event_id", F.get("y", F.lit(0)).alias("y"))


@query("b6_explode_labels", f"""
WITH {fr.LABELS}
SELECT doc_id, label AS tool, CAST(d.lang = label OR d.source = label AS INTEGER) AS label
FROM documents d CROSS JOIN labs""")
def explode_labels(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    records = docs.select("doc_id", F.col("text").alias("prompt"), F.array("lang", "source").alias("relevant_tools"))
    return prompts.long_table(records, labels, ["doc_id"]).select("doc_id", "tool", "label")


@query("b7_wide_projection", """
SELECT CAST(user_id AS VARCHAR) AS prompt,
       max(CAST(event_type = 'view' AND value > 150 AS INTEGER)) AS view,
       max(CAST(event_type = 'click' AND value > 150 AS INTEGER)) AS click,
       max(CAST(event_type = 'purchase' AND value > 150 AS INTEGER)) AS purchase,
       max(CAST(event_type = 'signup' AND value > 150 AS INTEGER)) AS signup
FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def wide_projection(spark, sf):
    return lb.to_wide(adapters.from_paired_rows(_event_pairs(spark, sf), EVENT_TOOLS), EVENT_TOOLS)


@query("b8_positive_view", """
SELECT CAST(user_id AS VARCHAR) AS prompt, event_type AS label FROM events
WHERE event_type <> 'error' AND value > 150 GROUP BY ALL""")
def positive_view(spark, sf):
    return lb.to_positive(adapters.from_paired_rows(_event_pairs(spark, sf), EVENT_TOOLS), EVENT_TOOLS, ["prompt"])


# --- joins -----------------------------------------------------------------------------------

@query("j_semi_known_labels", """
SELECT l_partkey + l_linenumber % 2 * 10000000 AS label, count(*) AS n FROM lineitem
WHERE l_partkey + l_linenumber % 2 * 10000000 IN (SELECT p_partkey FROM part) GROUP BY ALL""")
def semi_known_labels(spark, sf):
    catalog = table(spark, sf, "part").select(F.col("p_partkey").alias("label"))
    rows = table(spark, sf, "lineitem").select(_half_unknown().alias("label"))
    return adapters.known_only(rows, catalog).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("j_anti_unseen_texts", """
SELECT min(doc_id) AS seq, md5(text) AS text_md5 FROM documents
WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en')
GROUP BY text""")
def anti_unseen_texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("text").alias("prompt"), "lang", F.col("doc_id").alias("seq"))
    new = docs.filter("lang <> 'en'").select("prompt", "seq")
    return adapters.unseen_only(new, docs.filter("lang = 'en'")).select("seq", F.md5("prompt").alias("text_md5"))


# --- quality ---------------------------------------------------------------------------------

_QUALITY_INPUT = f"""raw AS (
  SELECT CASE WHEN doc_id % 50 = 3 THEN '' ELSE text END AS prompt, lang,
         CAST(lang = 'de' AS INTEGER) AS de, CAST(lang = 'fr' AND doc_id % 9 = 0 AS INTEGER) AS fr,
         CAST(CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 0 END AS INTEGER) AS odd, 0 AS none_, 1 AS all_
  FROM documents),
merged AS (SELECT prompt, max(de) AS de, max(fr) AS fr, max(odd) AS odd, max(none_) AS none_, max(all_) AS all_
  FROM raw WHERE {fr.sql_strip('prompt')} <> '' GROUP BY prompt),
cells AS (UNPIVOT merged ON de, fr, odd, none_, all_ INTO NAME label VALUE v)"""
QUALITY_LABELS = ["de", "fr", "odd", "none_", "all_"]


def _quality_input(spark, sf):
    docs = texts(spark, sf)
    return docs.select(
        F.when(F.col("doc_id") % 50 == 3, "").otherwise(F.col("text")).alias("prompt"),
        F.array(
            (F.col("lang") == "de").cast("int"),
            ((F.col("lang") == "fr") & (F.col("doc_id") % 9 == 0)).cast("int"),
            F.when(F.col("doc_id") % 11 == 0, 3).otherwise(0),
            F.lit(0),
            F.lit(1),
        ).alias("y"),
    )


@query("c1_c8_quality_report", f"""
WITH {_QUALITY_INPUT},
tot AS (SELECT (SELECT count(*) FROM raw) AS rows, (SELECT count(*) FROM raw WHERE prompt = '') AS blanks,
               (SELECT count(*) FROM merged) AS kept),
per AS (SELECT label, count(*) FILTER (v = 1) AS pos, count(*) FILTER (v = 0) AS neg,
               count(*) FILTER (v NOT IN (0, 1)) AS bad FROM cells GROUP BY label)
SELECT 1 AS check_no, NULL AS label, blanks AS n, 'Found ' || blanks || ' empty prompts — removed' AS message FROM tot WHERE blanks > 0
UNION ALL SELECT 2, NULL, rows - blanks - kept, 'Found ' || (rows - blanks - kept) || ' duplicate prompts — merged with OR logic' FROM tot WHERE rows - blanks > kept
UNION ALL SELECT 4, label, pos, 'Tool ''' || label || ''' has ZERO positive examples — model cannot learn it' FROM per WHERE pos = 0
UNION ALL SELECT 4, label, pos, 'Tool ''' || label || ''' has only ' || pos || ' positive examples — may underperform' FROM per WHERE pos IN (1, 2)
UNION ALL SELECT 5, label, neg, 'Tool ''' || label || ''' has ZERO negative examples — model cannot learn it' FROM per WHERE neg = 0
UNION ALL SELECT 6, label, bad, 'Tool ''' || label || ''' has ' || bad || ' invalid labels — clipped to 0/1' FROM per WHERE bad > 0
UNION ALL SELECT 7, NULL, rows - kept, 'Total rows removed: ' || (rows - kept) FROM tot WHERE rows > kept""")
def quality_report(spark, sf):
    return quality.quality_report(_quality_input(spark, sf), QUALITY_LABELS).select("check_no", "label", "n", "message")


@query("c8_rows_without_labels", f"""
WITH {_QUALITY_INPUT}, z AS (SELECT count(*) AS n FROM merged WHERE de = 0 AND fr = 0)
SELECT 3 AS check_no, NULL AS label, n, 'Found ' || n || ' prompts with no tool selected — kept (valid negative examples)' AS message
FROM z WHERE n > 0""")
def rows_without_labels(spark, sf):
    """The report's check for prompts without any label, on labels that leave some."""
    rows = _quality_input(spark, sf).withColumn("y", F.slice("y", 1, 2))
    report = quality.quality_report(rows, QUALITY_LABELS[:2])
    return report.filter("check_no = 3").select("check_no", "label", "n", "message")


@query("c1_blank_prompts", f"""
SELECT count(*) AS n_rows, count(*) FILTER ({fr.sql_strip("html")} = '') AS blank,
       count(*) FILTER ({fr.sql_strip("html")} <> '') AS kept
FROM (SELECT CASE WHEN page_id % 9 = 0 THEN chr(9) || ' ' ELSE html END AS html FROM pages)""")
def blank_prompts(spark, sf):
    pages = texts(spark, sf, "pages").select(
        F.when(F.col("page_id") % 9 == 0, "\t ").otherwise(F.col("html")).alias("prompt")
    )
    blank = tx.is_blank(F.col("prompt"))
    return pages.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(blank).alias("blank"), F.count_if(~blank).alias("kept")
    )


@query("c2_merge_duplicates", f"""
WITH {_QUALITY_INPUT}
SELECT md5(prompt) AS prompt_md5, label, CAST(greatest(0, least(1, v)) AS INTEGER) AS y FROM cells""")
def merge_duplicates(spark, sf):
    cleaned = quality.clean(_quality_input(spark, sf), QUALITY_LABELS).withColumn("prompt_md5", F.md5("prompt"))
    return _long(cleaned, QUALITY_LABELS, "prompt_md5")


@query("c3_no_label_prompts", """
SELECT count(*) AS prompts, count(*) FILTER (s = 0) AS without_label FROM (
  SELECT user_id, sum(CAST(value > 150 AS INTEGER)) AS s FROM events WHERE event_type <> 'error' GROUP BY user_id)""")
def no_label_prompts(spark, sf):
    rows = adapters.from_paired_rows(_event_pairs(spark, sf), EVENT_TOOLS)
    return rows.agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(quality.labels_per_row() == 0).alias("without_label")
    )


@query("c4_c7_quality_counts", f"""
WITH {_QUALITY_INPUT}
SELECT label, count(*) FILTER (v = 1) AS positives, count(*) FILTER (v = 0) AS negatives,
       count(*) FILTER (v NOT IN (0, 1)) AS invalid,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM merged) AS removed
FROM cells GROUP BY label""")
def quality_counts(spark, sf):
    return (
        quality.quality_counts(_quality_input(spark, sf), QUALITY_LABELS)
        .filter(F.col("pos") >= 0)
        .select(
            F.get(str_array(QUALITY_LABELS), F.col("pos")).alias("label"),
            F.col("one").alias("positives"),
            F.col("zero").alias("negatives"),
            "invalid",
            (F.col("rows") - F.col("prompts")).alias("removed"),
        )
    )


@query("c9_c11_describe_dataset", """
WITH p AS (SELECT (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents) AS k)
SELECT count(*) AS n_rows, any_value(k) + 1 AS n_columns, count(DISTINCT text) AS unique_prompts,
       count(*) - count(DISTINCT text) AS duplicate_prompts, 0::BIGINT AS missing_values, 2.0::DOUBLE AS avg_labels,
       2::BIGINT AS max_labels, count(*) AS multi_label_prompts
FROM documents, p""")
def describe_dataset(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    return quality.describe_dataset(fr.labelled(docs, labels), labels)


@query("c10_label_distribution", f"""
WITH {fr.TRUTH}
SELECT pos, label, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives,
       round(100.0 * sum(y) / count(*), 6) AS pct_positive
FROM truth GROUP BY pos, label""")
def label_distribution(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    return quality.label_distribution(fr.labelled(docs, labels), labels).withColumn(
        "pct_positive", F.round("pct_positive", 6)
    )


@query("c11_labels_per_prompt", """
WITH s AS (SELECT user_id, count(DISTINCT event_type) FILTER (value > 150) AS k FROM events
           WHERE event_type <> 'error' GROUP BY user_id)
SELECT count(*) AS n_rows, round(avg(k), 6) AS avg_labels, max(k) AS max_labels, count(*) FILTER (k > 1) AS multi_label_prompts FROM s""")
def labels_per_prompt(spark, sf):
    rows = adapters.from_paired_rows(_event_pairs(spark, sf), EVENT_TOOLS)
    return quality.describe_dataset(rows, EVENT_TOOLS).select(
        "n_rows", F.round("avg_labels", 6).alias("avg_labels"), "max_labels", "multi_label_prompts"
    )


@query("c12_row_sum", """
SELECT CAST(l_orderkey AS VARCHAR) AS prompt, count(DISTINCT l_returnflag) FILTER (l_discount > 0.05) AS held
FROM lineitem GROUP BY l_orderkey""")
def row_sum(spark, sf):
    rows = adapters.from_paired_rows(_lineitem_pairs(spark, sf), FLAGS)
    return rows.select("prompt", quality.labels_per_row().cast("long").alias("held"))


@query("c13_count_listed", """
SELECT label, count(*) AS n FROM (SELECT lang AS label FROM documents UNION ALL SELECT source FROM documents) GROUP BY label""")
def count_listed(spark, sf):
    return quality.count_listed(
        table(spark, sf, "documents").select(F.array("lang", "source").alias("relevant_tools"))
    )


# --- split -----------------------------------------------------------------------------------

@query("d1_hash_split", f"""
SELECT doc_id, CASE WHEN b < 200 THEN 'test' WHEN b < 300 THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, {fr.sql_bucket("'42|' || text")} AS b FROM documents)""")
def hash_split(spark, sf):
    docs = texts(spark, sf).select("doc_id", F.col("text").alias("prompt"))
    return split.with_split(docs).select("doc_id", "split")


def _exact_sql(part: str) -> str:
    return f"""
WITH r AS (SELECT {part} o_orderkey, row_number() OVER (PARTITION BY {part or "1,"} 1 ORDER BY md5('42|' || o_orderkey)) AS k,
                  count(*) OVER (PARTITION BY {part or "1,"} 1) AS n FROM orders),
s AS (SELECT *, ceil(round(n * 0.2::DOUBLE, 6)) AS t FROM r)
SELECT o_orderkey, CASE WHEN k <= t THEN 'test' WHEN k <= t + ceil(round((n - t) * 0.125::DOUBLE, 6)) THEN 'val' ELSE 'train' END AS split
FROM s"""


@query("d2_exact_split", _exact_sql(""))
def exact_split(spark, sf):
    return split.exact_split(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey")


@query("d2_exact_split_stratified", _exact_sql("o_orderpriority,"))
def exact_split_stratified(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.exact_split(rows, key="o_orderkey", stratum="o_orderpriority").select("o_orderkey", "split")
