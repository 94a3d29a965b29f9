"""Queries over selection, routing, coverage and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import coverage, features, routing, selection
from labelloom.plans import fragments as fr
from labelloom.plans.queries_model import LANGS, _fixed_model
from labelloom.plans.queries_text import _VOCAB, GROUPS, _flag_sql, _STRUCT, _vocabulary
from labelloom.plans.registry import query, table, texts
from labelloom.session import work_path
from labelloom.sources.catalogs import label_names
from labelloom.streaming import selection as stream

CUTS = {"de": 0.3, "en": 0.5, "es": 0.7}  # fr uses the default
CUT_LIST = [CUTS.get(l, 0.5) for l in LANGS]

# --- selection -----------------------------------------------------------------------------------
# Conversation turns; every 13th is blank, every 17th has no usable score.

_TURNS = f"""
WITH raw AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN (conv_id + turn) % 13 = 0 THEN chr(9) || ' '
    WHEN (conv_id + turn) % 11 <> 0 THEN CASE WHEN (conv_id + turn) % 7 = 0 THEN '  ' || text || chr(10) ELSE text END END AS prompt FROM conversations),
u AS (SELECT id, {fr.sql_strip("coalesce(prompt, '')")} AS prompt FROM raw),
l AS (SELECT * FROM (VALUES ('de', 0, 0.3::DOUBLE), ('en', 1, 0.5), ('es', 2, 0.7), ('fr', 3, 0.5)) AS v(label, pos, t)),
s AS (SELECT id, prompt, label, pos, t, {fr.sql_bucket("id || '|' || label")} / 1000.0::DOUBLE AS score,
             CASE WHEN prompt = '' THEN 'empty_prompt' WHEN id % 17 = 0 THEN 'scoring_error' END AS reason FROM u, l),
d AS (SELECT *, CASE WHEN reason IS NULL THEN score >= t END AS keep, CASE WHEN reason IS NULL THEN score ELSE -1.0 END AS shown FROM s)"""
_LISTS = """coalesce(string_agg(label || ':' || printf('%.4f', shown), ',' ORDER BY shown DESC, pos) FILTER ({sel}), '') AS selected,
       coalesce(string_agg(label || ':' || printf('%.4f', shown), ',' ORDER BY shown DESC, pos) FILTER ({rej}), '') AS rejected"""


def _turns(spark, sf):
    at = F.col("conv_id") + F.col("turn")
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(at % 13 == 0, "\t ").when(at % 11 == 0, F.lit(None)).when(at % 7 == 0, F.concat(F.lit("  "), "text", F.lit("\n")))
        .otherwise(F.col("text")).alias("prompt"),
    )
    broken = F.array(F.lit(0.1), F.lit(float("nan")), F.lit(0.2), F.lit(0.3))
    scores = F.when(F.col("id") % 17 == 0, broken).otherwise(fr.hash_scores(F.col("id"), LANGS))
    return rows.withColumn("scores", scores)


def _shown(column):
    return F.array_join(
        F.transform(F.col(column), lambda e: F.format_string("%s:%.4f", e["tool"], e["score"])), ","
    ).alias(column)


@query("i1_i4_select_labels", _TURNS + f"""
SELECT id, {_LISTS.format(sel="reason IS NOT NULL OR keep", rej="reason IS NULL AND NOT keep")},
       any_value(reason) IS NOT NULL AS fallback_used, any_value(reason) AS reason FROM d GROUP BY id""")
def select_labels(spark, sf):
    rows = selection.select_labels(_turns(spark, sf), LANGS, CUT_LIST)
    return rows.select("id", _shown("selected"), _shown("rejected"), "fallback_used", "reason")


def _strategy(name, sel, rej, strategy, defaults=()):
    sql = _TURNS + f"SELECT id, {_LISTS.format(sel=sel, rej=rej)} FROM d GROUP BY id"

    @query(name, sql)
    def run(spark, sf):
        rows = selection.select_labels(_turns(spark, sf), LANGS, CUT_LIST, strategy, defaults)
        return rows.select("id", _shown("selected"), _shown("rejected"))

    return run


_strategy("i5_fallback_select_none", "reason IS NULL AND keep", "reason IS NOT NULL OR NOT keep", "select_none")
_strategy(
    "i5_fallback_default_list", "CASE WHEN reason IS NULL THEN keep ELSE label IN ('en', 'fr') END",
    "CASE WHEN reason IS NULL THEN NOT keep ELSE label NOT IN ('en', 'fr') END", "select_default_tools", ("en", "fr"),
)


@query("i6_i9_result_record", _TURNS + """
SELECT id, CASE WHEN id % 3 = 0 THEN 'given-' || id ELSE substr(md5(prompt || '|' || id), 1, 12) END AS request_id,
       '2.0.0' AS model_version, 'none' AS algorithm, 3::BIGINT AS n_thresholds, any_value(reason) IS NOT NULL AS fallback_used,
       CASE WHEN id % 2 = 0 THEN '[' || length(prompt) || ' chars]' ELSE 'shown' END AS logged,
       count(*) FILTER (reason IS NOT NULL OR keep) AS n_selected
FROM d GROUP BY id, prompt""")
def result_record(spark, sf):
    rows = selection.select_labels(_turns(spark, sf), LANGS, CUT_LIST)
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit("given-"), F.col("id").cast("string")))
    rows = rows.withColumn("request_id", selection.request_id(given, F.col("prompt"), F.col("id")))
    record = rows.select("id", selection.result_record("2.0.0", "none", CUTS).alias("r"))
    hidden = selection.redact(F.col("r.prompt"), False)
    return record.select(
        "id", "r.request_id", "r.model_version", "r.algorithm",
        F.size("r.thresholds_used").cast("long").alias("n_thresholds"), "r.fallback_used",
        F.when(F.col("id") % 2 == 0, hidden).otherwise("shown").alias("logged"),
        F.size("r.selected_tools").cast("long").alias("n_selected"),
    )


@query("i7_explain", _TURNS + """, lines AS (
  SELECT id, prompt, any_value(reason) IS NOT NULL AS fb,
    coalesce(string_agg(printf('  %-10s %-25s score=%.4f  threshold=%.2f', '[SELECT]', label, shown, t), chr(10) ORDER BY shown DESC, pos) FILTER (reason IS NOT NULL OR keep) || chr(10), '') AS sel,
    coalesce(chr(10) || string_agg(printf('  %-10s %-25s score=%.4f  threshold=%.2f', '[DESELECT]', label, shown, t), chr(10) ORDER BY shown DESC, pos) FILTER (reason IS NULL AND NOT keep), '') AS rej
  FROM d GROUP BY id, prompt)
SELECT id, md5('Prompt      : ' || prompt || chr(10) || 'Model       : v2.0.0 (none)' || chr(10) || 'Fallback    : ' ||
  CASE WHEN fb THEN 'True' ELSE 'False' END || chr(10) || chr(10) || 'SELECTED TOOLS:' || chr(10) || sel || chr(10) || 'REJECTED TOOLS:' || rej) AS text_md5
FROM lines""")
def explain(spark, sf):
    rows = selection.select_labels(_turns(spark, sf), LANGS, CUT_LIST)
    return rows.select("id", F.md5(selection.explain("2.0.0", "none", CUTS)).alias("text_md5"))


# --- routing -------------------------------------------------------------------------------------

POLICY = dict(mandatory=("fr",), banned=("es",), dependencies=(("de", ("en", "xx")), ("en", ("es",))))

_SEL = f"""
WITH b AS (SELECT doc_id,
  {fr.sql_bucket("doc_id || '|de'")} >= 800 AS de0, {fr.sql_bucket("doc_id || '|en'")} >= 800 AS en0,
  {fr.sql_bucket("doc_id || '|es'")} >= 800 AS es0, {fr.sql_bucket("doc_id || '|fr'")} >= 800 AS fr0 FROM documents)"""


def _names(de: str, en: str, es: str, fr_: str) -> str:
    """Comma list of the labels whose conditions hold, in catalog order."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{l}' END" for l, c in zip(LANGS, (de, en, es, fr_)))
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def _log(*parts: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ';')"


def _chosen(spark, sf):
    scores = fr.hash_scores(F.col("doc_id"), LANGS)
    picked = F.transform(
        F.filter(F.arrays_zip(F.array(*[F.lit(l) for l in LANGS]).alias("l"), F.col("s").alias("s")), lambda c: c["s"] >= 0.8),
        lambda c: c["l"],
    )
    return table(spark, sf, "documents").select("doc_id", scores.alias("s")).select("doc_id", picked.alias("sel"))


def _routed(rows, policy, known=None):
    return routing.route(rows, LANGS, policy, F.col("sel"), known)


def _flat(rows):
    return rows.select(
        "doc_id",
        F.array_join("execute", ",").alias("execute"),
        F.array_join("skip", ",").alias("skip"),
        F.array_join("policy_overrides", ";").alias("overrides"),
    )


@query("k1_k3_k6_k7_route", _SEL + """,
r AS (SELECT *, de0 AND NOT en0 AS dep1, (en0 OR de0) AND NOT es0 AS dep2, NOT fr0 AS man FROM b)
SELECT doc_id, """ + _names("de0", "en0 OR de0", "false", "true") + """ AS execute,
       """ + _names("NOT de0", "NOT (en0 OR de0)", "true", "false") + """ AS skip,
       """ + _log("CASE WHEN dep1 THEN 'DEPENDENCY: en added because de selected' END",
                  "CASE WHEN dep2 THEN 'DEPENDENCY: es added because en selected' END",
                  "CASE WHEN man THEN 'MANDATORY: fr force-selected' END",
                  "CASE WHEN es0 OR dep2 THEN 'BANNED: es force-rejected' END") + " AS overrides FROM r")
def route(spark, sf):
    return _flat(_routed(_chosen(spark, sf), routing.Policy(**POLICY)))


@query("k1_dependency_order", _SEL + """
SELECT doc_id, """ + _names("de0", "en0 OR de0", "es0 OR en0", "fr0") + """ AS execute FROM b
WHERE de0 OR en0 OR es0 OR fr0""")
def dependency_order(spark, sf):
    """en -> es is declared before de -> en, so an en added for de no longer pulls in es."""
    policy = routing.Policy(dependencies=(("en", ("es",)), ("de", ("en",))))
    rows = _chosen(spark, sf).filter(F.size("sel") > 0)
    return _flat(_routed(rows, policy)).select("doc_id", "execute")


@query("k4_minimum_select_all", _SEL + """
SELECT doc_id, CASE WHEN de0 OR en0 OR fr0 THEN """ + _names("de0", "en0", "false", "fr0") + """ ELSE 'de,en,es,fr' END AS execute,
       """ + _log("CASE WHEN es0 THEN 'BANNED: es force-rejected' END",
                  "CASE WHEN NOT (de0 OR en0 OR fr0) THEN 'MINIMUM: no tools selected — selected all as fallback' END") + " AS overrides FROM b")
def minimum_select_all(spark, sf):
    return _flat(_routed(_chosen(spark, sf), routing.Policy(banned=("es",)))).select("doc_id", "execute", "overrides")


@query("k4_minimum_respecting_ban", _SEL + """
SELECT doc_id, CASE WHEN de0 OR en0 OR fr0 THEN """ + _names("de0", "en0", "false", "fr0") + """ ELSE 'de,en,fr' END AS execute FROM b""")
def minimum_respecting_ban(spark, sf):
    policy = routing.Policy(banned=("es",), respect_ban=True)
    return _flat(_routed(_chosen(spark, sf), policy)).select("doc_id", "execute")


@query("k5_minimum_default_tools", _SEL + """
SELECT doc_id, CASE WHEN de0 OR en0 OR es0 OR fr0 THEN """ + _names("de0", "en0", "es0", "fr0") + """ ELSE 'de,fr' END AS execute,
       CASE WHEN de0 OR en0 OR es0 OR fr0 THEN '' ELSE 'MINIMUM: selected defaults=de, fr' END AS overrides FROM b""")
def minimum_default_tools(spark, sf):
    policy = routing.Policy(fallback="select_default_tools", default_tools=("fr", "de", "xx"))
    return _flat(_routed(_chosen(spark, sf), policy)).select("doc_id", "execute", "overrides")


@query("k8_k9_decision_summary", _SEL + """,
r AS (SELECT doc_id, CASE WHEN de0 OR en0 OR es0 OR fr0 THEN list_filter([CASE WHEN de0 THEN 'de' END, CASE WHEN en0 THEN 'en' END, CASE WHEN es0 THEN 'es' END, CASE WHEN fr0 THEN 'fr' END], lambda x: x IS NOT NULL) ELSE ['de', 'en', 'es', 'fr'] END AS ex,
       NOT (de0 OR en0 OR es0 OR fr0) AS minimum FROM b),
q AS (SELECT doc_id, ex, list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(ex, x)) AS sk, minimum FROM r)
SELECT doc_id, len(ex) AS n_execute, 1.0 - len(ex) / 4.0::DOUBLE AS reduction,
  'EXECUTE (' || len(ex) || '): [' || array_to_string(list_transform(ex, lambda x: '''' || x || ''''), ', ') || ']' || chr(10) ||
  'SKIP    (' || len(sk) || '):    [' || array_to_string(list_transform(sk, lambda x: '''' || x || ''''), ', ') || ']' || chr(10) ||
  CASE WHEN minimum THEN 'POLICY OVERRIDES: [''MINIMUM: no tools selected — selected all as fallback'']' || chr(10) ELSE '' END ||
  printf('TOOL REDUCTION: %.1f%%', 100.0 * (1.0 - len(ex) / 4.0::DOUBLE)) AS summary
FROM q""")
def decision_summary(spark, sf):
    rows = _routed(_chosen(spark, sf), routing.Policy()).withColumns({
        "request_id": F.col("doc_id").cast("string"), "model_version": F.lit("2.0.0"),
        "algorithm": F.lit("none"), "fallback_used": F.lit(False),
    })
    rows = rows.withColumns({"summary": routing.summary_text(), "reduction": routing.reduction()})
    return rows.withColumn("d", routing.decision_record(F.col("sel"))).select(
        "doc_id", F.size("d.execute").cast("long").alias("n_execute"), "reduction", "summary"
    )


@query("k10_known_from_request", _SEL + """
SELECT doc_id, CASE WHEN de0 OR en0 THEN """ + _names("de0", "en0", "false", "false") + """ ELSE 'de,en' END AS execute FROM b""")
def known_from_request(spark, sf):
    """The request only mentions de and en, so a mandatory fr is unknown to it and not added."""
    rows = _chosen(spark, sf)
    asked = F.array(F.lit("de"), F.lit("en"))
    rows = rows.withColumn("sel", F.array_intersect("sel", asked)).withColumn("rej", F.array_except(asked, F.col("sel")))
    known = routing.known_from_request(F.col("sel"), F.col("rej"))
    return _flat(_routed(rows, routing.Policy(mandatory=("fr",)), known)).select("doc_id", "execute")


# --- coverage ------------------------------------------------------------------------------------
# Catalog: one label per verb and part name; positives: line items of its parts. A label is thin when
# it has fewer than the average label.

_VERBS = ("list", "create", "fork", "update", "edit", "delete", "dismiss", "unstar", "search", "run",
          "merge", "trigger", "add", "push", "star", "get", "find")
_LABEL_SQL = "list_element([" + ", ".join(f"'{v}'" for v in _VERBS) + f"], 1 + p_size % {len(_VERBS)}) || '_' || replace(p_name, ' ', '_')"
_CATALOG = f"""cat0 AS (SELECT {_LABEL_SQL} AS label, p_partkey, p_name, p_type, p_brand FROM part),
catalog AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos, any_value(p_name) AS name, lower(min(p_type)) || '_parts' AS category,
                   list_sort(list(DISTINCT lower(p_brand))) AS brands FROM cat0 GROUP BY label),
cnt AS (SELECT label, count(*) AS n FROM cat0 JOIN lineitem ON l_partkey = p_partkey GROUP BY label),
goal AS (SELECT CAST(ceil((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM catalog)::DOUBLE) AS BIGINT) AS target),
thin AS (SELECT c.*, coalesce(n, 0) AS have, target - coalesce(n, 0) AS need FROM catalog c LEFT JOIN cnt USING (label), goal WHERE coalesce(n, 0) < target)"""


def _catalog(spark, sf):
    part = table(spark, sf, "part")
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), F.lit(1) + F.col("p_size") % len(_VERBS))
    named = part.withColumn("label", F.concat(verb, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    grouped = named.groupBy("label").agg(
        F.first("p_name").alias("description"),
        F.concat(F.lower(F.min("p_type")), F.lit("_parts")).alias("category"),
        F.array_sort(F.collect_set(F.lower("p_brand"))).alias("capabilities"),  # at most 25 brands
    )
    # A catalog is a bounded dimension: 64 names times 17 verbs here.
    pos = spark.createDataFrame(list(enumerate(label_names(grouped))), "pos bigint, label string")
    return named, grouped.join(pos, "label").select("pos", "label", "description", "category", "capabilities")


def _thin(spark, sf):
    named, catalog = _catalog(spark, sf)
    sold = table(spark, sf, "lineitem")
    held = sold.join(named.select("p_partkey", "label"), F.col("l_partkey") == F.col("p_partkey"))
    counts = held.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return coverage.thin_labels(catalog, counts, -(-sold.count() // catalog.count()))


@query("l1_thin_labels", f"WITH {_CATALOG} SELECT label, have, need FROM thin")
def thin_labels(spark, sf):
    return _thin(spark, sf).select("label", "have", "need")


_NOUN = f"""variants AS (SELECT label, pos, category, brands, v FROM catalog, (SELECT unnest(range(12)) AS v)),
caps AS (SELECT *, list_filter(brands, lambda b: length(b) > 2) AS caps FROM variants),
words AS (SELECT label, pos, v, category, len(caps) AS k, unnest(caps) AS cap FROM caps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, v ORDER BY md5(v || '|' || cap)) AS r FROM words)"""


@query("l2_noun_phrases", f"""
WITH {_CATALOG}, {_NOUN}
SELECT label, CAST(v AS INTEGER) AS variant, string_agg(cap, ' ' ORDER BY r) FILTER (r <= 1 + v % least(3, k)) AS noun FROM ranked GROUP BY label, v""")
def noun_phrases(spark, sf):
    _, catalog = _catalog(spark, sf)
    rows = catalog.select("label", "category", "capabilities", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("variant"))
    return rows.select(
        "label", "variant",
        coverage.noun_phrase(F.col("capabilities"), F.col("category"), F.col("variant")).alias("noun"),
    )


_FAMILY_SQL = """CASE WHEN starts_with(label, 'list') THEN 'list' WHEN starts_with(label, 'create') OR starts_with(label, 'fork') THEN 'create'
  WHEN starts_with(label, 'update') OR starts_with(label, 'edit') THEN 'update'
  WHEN starts_with(label, 'delete') OR starts_with(label, 'dismiss') OR starts_with(label, 'unstar') THEN 'delete'
  WHEN starts_with(label, 'search') THEN 'search'
  WHEN contains(label, 'trigger') OR starts_with(label, 'run') OR starts_with(label, 'merge') THEN 'run'
  WHEN starts_with(label, 'add') OR starts_with(label, 'push') OR starts_with(label, 'star') THEN 'write' ELSE 'read' END"""


@query("l3_template_family", f"WITH {_CATALOG} SELECT label, {_FAMILY_SQL} AS family FROM catalog")
def template_family(spark, sf):
    _, catalog = _catalog(spark, sf)
    return catalog.select("label", coverage.template_family(F.col("label"), F.lit("read"), F.col("category")).alias("family"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(c) if isinstance(c, int) else "'" + c.replace("'", "''") + "'" for c in r) + ")" for r in rows)


def _sql_fill(noun: str, singular: str) -> str:
    lc = "lower(substr(name, 1, 1)) || substr(name, 2)"
    return (f"replace(replace(replace(replace(tpl, '{{desc_lc}}', {lc}), '{{desc}}', name), "
            f"'{{noun_singular}}', {singular}), '{{noun}}', {noun})")


_RENDER = f"""{_CATALOG}, fam AS (SELECT *, {_FAMILY_SQL} AS family FROM thin),
many AS (SELECT label, v, list_filter(brands, lambda b: length(b) > 2) AS caps FROM thin, (SELECT unnest(range(48)) AS v)),
nouns AS (SELECT label, v, string_agg(cap, ' ' ORDER BY r) FILTER (r <= 1 + v % least(3, k)) AS noun FROM (
  SELECT label, v, k, cap, row_number() OVER (PARTITION BY label, v ORDER BY md5(v || '|' || cap)) AS r
  FROM (SELECT label, v, len(caps) AS k, unnest(caps) AS cap FROM many)) GROUP BY label, v),
tpl AS (SELECT * FROM (VALUES {_values([(k, i, len(ts), t) for k, ts in coverage.TEMPLATES.items() for i, t in enumerate(ts)])}) AS v(family, i, k, tpl)),
own AS (SELECT pos, f.label, need, i + k * r AS attempt, {_sql_fill("noun", "split_part(noun, ' ', 1)")} AS x
        FROM (SELECT * FROM fam JOIN tpl USING (family), (SELECT unnest(range(6)) AS r)) AS f
        JOIN nouns ON nouns.label = f.label AND nouns.v = i + k * r),
extra AS (SELECT pos, label, need, 1000 + j AS attempt, {_sql_fill("''", "''")} AS x
          FROM fam, (VALUES {_values([(j, t) for j, t in enumerate(coverage.FALLBACK_TEMPLATES)])}) AS f(j, tpl)),
texts AS (
  SELECT pos, label, need, attempt, CASE WHEN regexp_matches(c, '[?.]$') THEN c ELSE c || '.' END AS text
  FROM (SELECT *, upper(substr(x, 1, 1)) || substr(x, 2) AS c FROM own)
  UNION ALL SELECT pos, label, need, attempt, upper(substr(x, 1, 1)) || substr(x, 2) FROM extra),
firsts AS (SELECT pos, label, need, text, min(attempt) AS attempt FROM texts GROUP BY ALL),
cands AS (SELECT * FROM firsts)"""


def _candidates(spark, sf):
    return coverage.render(_thin(spark, sf))


@query("l4_l5_render", f"WITH {_RENDER} SELECT label, CAST(attempt AS INTEGER) AS attempt, text FROM cands")
def render(spark, sf):
    return _candidates(spark, sf).select("label", F.col("attempt").cast("int").alias("attempt"), "text")


# The sequential rule itself: walk the labels in catalog order with the list of taken texts.
_PICK = f"""WITH RECURSIVE {_RENDER},
lists AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS k, label, need, list(text ORDER BY attempt) AS ts FROM cands GROUP BY pos, label, need),
walk AS (
  SELECT 0::BIGINT AS k, ''::VARCHAR AS label, []::VARCHAR[] AS added, (SELECT list(DISTINCT upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '.') FROM part) AS seen
  UNION ALL
  SELECT k, label, added, list_concat(seen, added) FROM (
    SELECT l.k, l.label, list_slice(list_filter(l.ts, lambda t: NOT list_contains(w.seen, t)), 1, l.need) AS added, w.seen
    FROM walk w JOIN lists l ON l.k = w.k + 1))"""


def _existing(spark, sf):
    """Prompts that exist already: the names of the parts."""
    part = table(spark, sf, "part")
    text = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2)), F.lit("."))
    return part.select(text.alias("prompt"), F.array(F.lit("part")).alias("relevant_tools")).dropDuplicates(["prompt"])


@query("l6_pick_new", _PICK + " SELECT label, unnest(added) AS text FROM walk WHERE k > 0")
def pick_new(spark, sf):
    return coverage.pick_new(_candidates(spark, sf), _existing(spark, sf)).select("label", "text")


@query("l7_merge_corpus", _PICK + """ SELECT text AS prompt, label AS tools FROM (SELECT label, unnest(added) AS text FROM walk WHERE k > 0)
UNION ALL SELECT DISTINCT upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '.', 'part' FROM part""")
def merge_corpus(spark, sf):
    existing = _existing(spark, sf)
    merged = coverage.merge_corpus(existing, coverage.pick_new(_candidates(spark, sf), existing))
    return merged.select("prompt", F.array_join("relevant_tools", ",").alias("tools"))


# --- streams -------------------------------------------------------------------------------------

_STREAM_SQL = f"""
WITH {_VOCAB},
u AS (SELECT conv_id * 1000 + turn AS prompt_id, {fr.sql_norm()} AS t FROM conversations),
uw AS (SELECT prompt_id, {fr.sql_words()} AS w FROM u),
ug AS (SELECT prompt_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM uw),
ux AS (SELECT prompt_id, idx, (1.0 + ln(count(*)::DOUBLE)) * any_value(idf) AS x FROM ug JOIN vocab USING (term) GROUP BY prompt_id, idx),
uf AS (SELECT prompt_id, idx, x / sqrt(sum(x * x) OVER (PARTITION BY prompt_id)) AS value FROM ux
{"".join(f"  UNION ALL SELECT prompt_id, (SELECT count(*) FROM vocab) + {i}, {sql} FROM u" + chr(10) for i, sql in enumerate(
    [f"CAST({_flag_sql(kws)} AS DOUBLE)" for _, kws in GROUPS] + list(_STRUCT.values())))}),
l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label),
m AS (SELECT prompt_id, label, sum(value * ({fr.sql_bucket("label || '|' || CAST(idx AS INTEGER)")} - 500) / 500.0::DOUBLE)
        + any_value(({fr.sql_bucket("label || '|b'")} - 500) / 500.0::DOUBLE) AS margin
      FROM uf, l WHERE value <> 0 GROUP BY prompt_id, label),
p AS (SELECT prompt_id, bool_or(label = 'de' AND margin >= 0) AS de, bool_or(label = 'es' AND margin >= 0) AS es,
             bool_or(label = 'fr' AND margin >= 0) AS fr FROM m GROUP BY prompt_id)
SELECT prompt_id, {_names("de", "true", "es", "fr")} AS execute, {_names("NOT de", "false", "NOT es", "NOT fr")} AS skip,
       false AS fallback_used FROM p"""


@query("i10_stream_selection_and_routing", _STREAM_SQL)
def stream_selection_and_routing(spark, sf):
    """Turns read as a stream, scored, selected, routed and written; the written table is the result."""
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt")
    )
    source = work_path(spark, "turns")
    turns.write.parquet(source)
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    incoming = spark.readStream.schema(turns.schema).parquet(source)
    out = work_path(spark, "decisions")
    policy = routing.Policy(mandatory=("en",))
    stream.start(incoming, space, _fixed_model(space), policy, out, work_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select(
        "prompt_id", F.array_join("execute", ",").alias("execute"), F.array_join("skip", ",").alias("skip"), "fallback_used"
    )
