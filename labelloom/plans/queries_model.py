"""Queries over scoring, training, thresholds and evaluation."""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.columns import str_array
from labelloom.functions.labels import to_long
from labelloom.operators import features, metrics, quality, scoring, split, thresholds, training
from labelloom.plans import experiment
from labelloom.plans import fragments as fr
from labelloom.plans.queries_text import _ALL, _VOCAB, GROUPS, _docs, _vocabulary
from labelloom.plans.registry import query, table, texts
from labelloom.session import work_path
from labelloom.sources import artifacts, runs

LANGS = ["de", "en", "es", "fr"]

# --- flagship: keyword scores against document labels ---------------------------------------------

FLAGSHIP = [
    ("quality", (" the ", " and ", " of ", " le ", " der ", " de ")),
    ("toxic", ("idiot", "stupid", "hate", "worthless")),
]
_FLAG_SCORE = {
    label: "(" + " + ".join(f"CAST(contains(t, '{k}') AS INTEGER)" for k in kws) + f") / {len(kws)}.0::DOUBLE"
    for label, kws in FLAGSHIP
}


@query("flagship_keyword_report", f"""
WITH n AS (SELECT l.doc_id, l.quality, l.toxic, {fr.sql_norm("d.text")} AS t FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT 'quality' AS label, quality AS y, {_FLAG_SCORE["quality"]} AS score, 0.5::DOUBLE AS threshold FROM n
      UNION ALL SELECT 'toxic', toxic, {_FLAG_SCORE["toxic"]}, 0.25::DOUBLE FROM n),
c AS (SELECT label, threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp,
             count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 0 AND score < threshold) AS tn,
             count(*) FILTER (y = 1 AND score < threshold) AS fn FROM s GROUP BY ALL)
SELECT label, threshold, tp, fp, tn, fn,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM c""")
def flagship_keyword_report(spark, sf):
    """Precision, recall and F1 per label of keyword scores: one shuffle to bring labels to documents."""
    names = [label for label, _ in FLAGSHIP]
    # Most documents have no label: their texts are dropped before anything is done to them.
    docs = texts(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    docs = docs.select(F.array(*names).alias("y"), tx.normalize(F.col("text")).alias("t"))
    shares = F.array(*[
        F.size(F.filter(str_array(kws), lambda k: F.contains(F.col("t"), k))) / F.lit(float(len(kws)))
        for _, kws in FLAGSHIP
    ])
    rows = docs.select("y", shares.alias("scores"))
    report = metrics.per_label(metrics.confusion(rows, names, [0.5, 0.25]))
    return report.select(
        "label", "threshold", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


# --- scoring with fixed coefficients -------------------------------------------------------------

def _fixed_weight(label: str, feature: int | str) -> float:
    return (int(md5(f"{label}|{feature}".encode()).hexdigest()[:8], 16) % 1000 - 500) / 500.0


_MARGINS = f"""
WITH {_ALL}, nz AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, value FROM allf WHERE value <> 0),
l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label),
coef AS (SELECT label, idx, ({fr.sql_bucket("label || '|' || idx")} - 500) / 500.0::DOUBLE AS w FROM l, (SELECT DISTINCT idx FROM nz)),
m AS (SELECT doc_id, label, sum(value * w) + any_value(({fr.sql_bucket("label || '|b'")} - 500) / 500.0::DOUBLE) AS margin
      FROM nz JOIN coef USING (idx) GROUP BY doc_id, label)"""


def _fixed_model(space):
    w = np.array([[_fixed_weight(l, i) for l in LANGS] for i in range(space.size)])
    return scoring.logistic_model(LANGS, w, np.array([_fixed_weight(l, "b") for l in LANGS]))


@query("f6_predict_proba", _MARGINS + "SELECT doc_id, label, round(1 / (1 + exp(-margin)), 6) AS score FROM m")
def predict_proba(spark, sf):
    docs = _docs(spark, sf)
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    scored = experiment.score(docs, space, _fixed_model(space))
    return to_long(scored.select("doc_id", F.col("scores").alias("y")), LANGS, ["doc_id"]).select(
        "doc_id", "label", F.round("y", 6).alias("score")
    )


@query("f6_predict_proba_in_blocks", _MARGINS + "SELECT doc_id, label, round(1 / (1 + exp(-margin)), 6) AS score FROM m")
def predict_proba_in_blocks(spark, sf):
    """Scores by the way that serves matrices beyond a broadcast."""
    docs = _docs(spark, sf)
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    encoded = features.encode(docs, space).select("doc_id", "indices", "values")
    scored = scoring.score_in_blocks(encoded, _fixed_model(space))
    return to_long(scored.select("doc_id", F.col("scores").alias("y")), LANGS, ["doc_id"]).select(
        "doc_id", "label", F.round("y", 6).alias("score"))


@query("j_spmv_score_by_join", _MARGINS + """
SELECT doc_id, label, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS score FROM m""")
def score_by_join(spark, sf):
    docs = _docs(spark, sf)
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    cells = features.features_long(features.encode(docs, space), space, ["doc_id"])
    rows = [(l, i, _fixed_weight(l, i)) for l in LANGS for i in range(space.size)]
    coef = spark.createDataFrame(rows, "label string, feature int, w double")
    bias = spark.createDataFrame([(l, _fixed_weight(l, "b")) for l in LANGS], "label string, b double")
    scored = scoring.score_by_join(cells.select("doc_id", F.col("idx").alias("feature"), "value"), coef, bias, "doc_id")
    return scored.select("doc_id", "label", F.round("margin", 6).alias("margin"), F.round("score", 6).alias("score"))


@query("f7_predict", _MARGINS + """
SELECT doc_id, label, CAST(1 / (1 + exp(-margin)) >= CASE label WHEN 'de' THEN 0.6 WHEN 'fr' THEN 0.4 ELSE 0.5 END AS INTEGER) AS selected FROM m""")
def predict(spark, sf):
    docs = _docs(spark, sf)
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    scored = experiment.score(docs, space, _fixed_model(space))
    chosen = scored.select("doc_id", scoring.predict(F.col("scores"), [0.6, 0.5, 0.5, 0.4]).alias("y"))
    return to_long(chosen, LANGS, ["doc_id"]).select("doc_id", "label", F.col("y").alias("selected"))


@query("f4_f5_class_weights", f"""
WITH {fr.TRUTH}, c AS (SELECT pos, label, count(*) FILTER (y = 1) AS positives, count(*) AS n FROM truth GROUP BY pos, label)
SELECT pos, label, positives, n - positives AS negatives, round(n / (2.0 * positives), 6) AS weight_pos,
       round(n / (2.0 * (n - positives)), 6) AS weight_neg, positives > 0 AND positives < n AS trainable FROM c""")
def class_weights(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    rows = scoring.class_weights(fr.labelled(docs, labels), labels)
    return rows.withColumns({c: F.round(c, 6) for c in ("weight_pos", "weight_neg")})


@query("j_lookup_thresholds", f"""
WITH {fr.TRUTH}
SELECT label, count(*) FILTER (score >= coalesce(CASE label WHEN 'de' THEN 0.3 WHEN 'src1' THEN 0.7 END, 0.5)) AS selected
FROM truth GROUP BY label""")
def lookup_thresholds(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    long = to_long(fr.scored(docs, labels).select("doc_id", F.col("scores").alias("y")), labels, ["doc_id"])
    given = spark.createDataFrame([("de", 0.3), ("src1", 0.7)], "label string, threshold double")
    joined = scoring.with_thresholds(long.withColumnRenamed("y", "score"), given)
    return joined.groupBy("label").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("selected"))


# --- training ------------------------------------------------------------------------------------

TRAIN_LABELS = [*LANGS, "quality", "toxic"]
TRAIN_GROUPS = [*GROUPS[:4], ("quality", FLAGSHIP[0][1]), ("toxic", FLAGSHIP[1][1])]


def training_rows(spark, sf):
    """(prompt, y): labelled documents with their language, quality and toxicity."""
    docs = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    flags = [(F.col("lang") == l).cast("int") for l in LANGS] + [F.col("quality"), F.col("toxic")]
    return docs.select(F.col("text").alias("prompt"), F.array(*flags).alias("y"))


def _trained(spark, sf, algorithm):
    rows = quality.clean(training_rows(spark, sf), TRAIN_LABELS)
    encoded, space = experiment.prepare(rows, TRAIN_GROUPS, max_features=3000)
    return experiment.run_experiment("run_" + algorithm, algorithm, encoded, space, TRAIN_LABELS)


_RUN_COLUMNS = ("label", "threshold", "precision", "recall", "f1", "auc", "tp", "fp", "tn", "fn")


@query("f1_f4_train_logistic")
def train_logistic(spark, sf):
    return _trained(spark, sf, "logistic_regression").per_label.select(*_RUN_COLUMNS)


@query("f2_f3_train_svm_calibrated")
def train_svm(spark, sf):
    return _trained(spark, sf, "linear_svm").per_label.select(*_RUN_COLUMNS)


@query("f5_training_report", """
WITH d AS (SELECT lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
y AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label, unnest([lang = 'de', lang = 'en', lang = 'es', lang = 'fr']) AS y FROM d
      UNION ALL SELECT 'quality', quality = 1 FROM d UNION ALL SELECT 'toxic', toxic = 1 FROM d
      UNION ALL SELECT 'never', false FROM d UNION ALL SELECT 'always', true FROM d),
c AS (SELECT label, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM y GROUP BY label)
SELECT label, positives, negatives, CASE WHEN least(positives, negatives) > 0 THEN 1 ELSE 0 END AS members,
       CASE WHEN least(positives, negatives) > 0 THEN true END AS converged FROM c""")
def training_report(spark, sf):
    """Labels with one class only get no member; the gradient shows how far each fit converged."""
    base = training_rows(spark, sf).select("prompt", F.concat("y", F.array(F.lit(0), F.lit(1))).alias("y"))
    labels = [*TRAIN_LABELS, "never", "always"]
    vocabulary = features.fit_vocabulary(base, max_features=3000)
    space = features.space_from_vocabulary(vocabulary, TRAIN_GROUPS)
    path = work_path(spark, "encoded")
    features.encode(base, space).write.parquet(path)
    _, report = training.fit_models(spark.read.parquet(path), labels, space.size)
    rows = [(r["label"], r["positives"], r["negatives"], r["members"],
             None if r["gradient"] is None else r["gradient"] <= 1e-4) for r in report]
    return spark.createDataFrame(rows, "label string, positives bigint, negatives bigint, members int, converged boolean")


@query("f3_calibration_folds", """
WITH d AS (SELECT doc_id, lang, quality, toxic, substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS h
           FROM documents JOIN labels USING (doc_id)),
y AS (SELECT doc_id, h, unnest([0, 1, 2, 3, 4, 5]) AS pos,
             unnest([lang = 'de', lang = 'en', lang = 'es', lang = 'fr', quality = 1, toxic = 1]) AS y FROM d)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
       CAST((row_number() OVER (PARTITION BY pos, y ORDER BY h, CAST(doc_id AS VARCHAR)) - 1) % 3 AS INTEGER) AS fold FROM y""")
def calibration_folds(spark, sf):
    docs = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    flags = [(F.col("lang") == l).cast("int") for l in LANGS] + [F.col("quality"), F.col("toxic")]
    rows = training.assign_folds(docs.select("doc_id", F.array(*flags).alias("y")), len(TRAIN_LABELS), "doc_id")
    return rows.select("doc_id", F.posexplode("fold").alias("pos", "fold"))


# Two yes/no features of the labelled documents, so that Newton steps run over a handful of cells.
_TWO = f"""d AS (SELECT doc_id, quality AS y, contains(t, ' the ')::INT AS x1, contains(t, '###')::INT AS x2,
             substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS h
      FROM (SELECT l.doc_id, l.quality, {fr.sql_norm("d.text")} AS t FROM documents d JOIN labels l ON l.doc_id = d.doc_id))"""


def _newton(p: str, slope: str, curve: str, free: int) -> str:
    """Newton steps on weighted cells (member, x1, x2, y, s): slope and curvature of the loss in the margin."""
    det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
    return f"""
nt AS (
  SELECT member, 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM (SELECT DISTINCT member FROM w)
  UNION ALL
  SELECT member, k + 1,
         a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / {det},
         b - (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / {det},
         c - (h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / {det}
  FROM (SELECT member, k, a, b, c, sum(d1 * x1) + a AS g1, sum(d1 * x2) + b AS g2, sum(d1) + {1 - free} * c AS g3,
               sum(d2 * x1) + 1 AS h11, sum(d2 * x1 * x2) AS h12, sum(d2 * x1) AS h13, sum(d2 * x2) + 1 AS h22,
               sum(d2 * x2) AS h23, sum(d2) + {1 - free} AS h33
        FROM (SELECT *, {slope} AS d1, {curve} AS d2
              FROM (SELECT *, {p} AS p FROM (SELECT nt.*, x1, x2, z, s, z * (a * x1 + b * x2 + c) AS m FROM nt JOIN w USING (member) WHERE k < 40)))
        GROUP BY member, k, a, b, c))"""


_SHOW_WEIGHTS = """
SELECT CAST(member AS INTEGER) AS member, round(a, 3) AS w1, round(b, 3) AS w2, round(c, 3) AS intercept FROM nt WHERE k = 40"""

_WEIGHTED = """, t AS (SELECT member, sum(n) AS n, sum(n) FILTER (y = 1) AS p FROM cells GROUP BY member),
w AS (SELECT member, x1, x2, 2 * y - 1 AS z, cells.n * t.n / (2.0::DOUBLE * CASE WHEN y = 1 THEN t.p ELSE t.n - t.p END) AS s
      FROM cells JOIN t USING (member)),"""


def _two_features(spark, sf, algorithm):
    docs = texts(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    docs = docs.select("doc_id", F.array("quality").alias("y"), tx.normalize(F.col("text")).alias("t"))
    flags = F.array(F.contains("t", F.lit(" the ")), F.contains("t", F.lit("###")))
    cells = F.filter(F.transform(flags, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    path = work_path(spark, "encoded")
    docs.select("doc_id", "y", cells.alias("indices")).withColumn(
        "values", F.transform("indices", lambda _: F.lit(1.0))).write.parquet(path)
    return training.fit_models(spark.read.parquet(path), ["quality"], 2, algorithm, key="doc_id", tol=1e-9)[0]


def _weights_of(spark, model):
    rows = [(m, *(round(float(x), 3) for x in (*model.weights[:, m], model.intercepts[m]))) for m in range(model.weights.shape[1])]
    return spark.createDataFrame(rows, "member int, w1 double, w2 double, intercept double")


@query("f1_logistic_weights", f"""
WITH RECURSIVE {_TWO}, cells AS (SELECT 0 AS member, x1, x2, y, count(*) AS n FROM d GROUP BY ALL){_WEIGHTED}
{_newton("1 / (1 + exp(m))", "-s * z * p", "s * p * (1 - p)", 1)}{_SHOW_WEIGHTS}""")
def logistic_weights(spark, sf):
    """Weights of a logistic regression on two features, against Newton steps in SQL."""
    return _weights_of(spark, _two_features(spark, sf, "logistic_regression"))


_SIGMOIDS = """
held AS (SELECT fold AS member, a * x1 + b * x2 + c AS m, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
         FROM f JOIN nt ON nt.member = f.fold AND k = 40 GROUP BY ALL),
size AS (SELECT member AS of_member, sum(p) AS all_p, sum(n) AS all_n FROM held GROUP BY member),
cal AS (SELECT member, m, p + n AS total, p * (all_p + 1.0::DOUBLE) / (all_p + 2) + n / (all_n + 2.0::DOUBLE) AS wanted
        FROM held JOIN size ON of_member = member),
st AS (
  SELECT of_member AS member, 0 AS step, 0.0::DOUBLE AS slope, ln((all_n + 1.0::DOUBLE) / (all_p + 1)) AS shift FROM size
  UNION ALL
  SELECT member, step + 1, slope - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), shift - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT member, step, slope, shift, sum(g * m) AS ga, sum(g) AS gb, sum(h * m * m) + 1e-10 AS haa, sum(h * m) AS hab, sum(h) + 1e-10 AS hbb
        FROM (SELECT *, wanted - total * q AS g, total * q * (1 - q) AS h
              FROM (SELECT st.*, m, total, wanted, 1 / (1 + exp(slope * m + shift)) AS q FROM st JOIN cal USING (member) WHERE step < 30))
        GROUP BY member, step, slope, shift))"""


_FOLD_CELLS = f"""
WITH RECURSIVE {_TWO},
f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY h, CAST(doc_id AS VARCHAR)) - 1) % 3 AS fold FROM d),
cells AS (SELECT member, x1, x2, y, count(*) AS n FROM f, (SELECT unnest([0, 1, 2]) AS member) WHERE fold <> member GROUP BY ALL){_WEIGHTED}
{_newton("greatest(1 - m, 0)", "-2 * s * z * p", "CASE WHEN p > 0 THEN 2 * s ELSE 0 END", 0)}"""


@query("f2_svm_weights", _FOLD_CELLS + _SHOW_WEIGHTS)
def svm_weights(spark, sf):
    """Weights of the three fold members of a squared-hinge SVM, against Newton steps in SQL."""
    return _weights_of(spark, _two_features(spark, sf, "linear_svm"))


@query("f3_calibration_sigmoids", _FOLD_CELLS + "," + _SIGMOIDS + """
SELECT CAST(member AS INTEGER) AS member, round(slope, 3) AS slope, round(shift, 3) AS offset_ FROM st WHERE step = 30""")
def calibration_sigmoids(spark, sf):
    """Slope and offset of the sigmoid of each fold member, against Newton steps in SQL on held-out margins."""
    model = _two_features(spark, sf, "linear_svm")
    rows = [(m, round(float(a), 3), round(float(b), 3)) for m, (a, b) in enumerate(zip(model.slope, model.offset, strict=True))]
    return spark.createDataFrame(rows, "member int, slope double, offset_ double")


_SVM_NEWTON = _newton("greatest(1 - m, 0)", "-2 * s * z * p", "CASE WHEN p > 0 THEN 2 * s ELSE 0 END", 0)
_LR_NEWTON = _newton("1 / (1 + exp(m))", "-s * z * p", "s * p * (1 - p)", 1)
# One label, two yes/no features: split, both fits, sweep, test, choice and evaluation of the chosen model.
_RUN = f"""
WITH RECURSIVE d AS (
  SELECT md5(text) AS key, y, contains(t, ' the ')::INT AS x1, contains(t, '###')::INT AS x2,
         CASE WHEN bucket < 200 THEN 'test' WHEN bucket < 300 THEN 'val' ELSE 'train' END AS part
  FROM (SELECT text, max(quality) AS y, {fr.sql_norm("text")} AS t, {fr.sql_bucket("'42|' || text")} AS bucket
        FROM documents JOIN labels USING (doc_id) GROUP BY text)),
folded AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY substr(md5(key), 1, 15), key) - 1) % 3 AS fold FROM d WHERE part = 'train'),
lr AS (WITH RECURSIVE cells AS (SELECT 0 AS member, x1, x2, y, count(*) AS n FROM folded GROUP BY ALL){_WEIGHTED}
{_LR_NEWTON} SELECT a, b, c FROM nt WHERE k = 40),
svm AS (WITH RECURSIVE f AS (SELECT * FROM folded), cells AS (SELECT member, x1, x2, y, count(*) AS n FROM f, (SELECT unnest([0, 1, 2]) AS member) WHERE fold <> member GROUP BY ALL){_WEIGHTED}
{_SVM_NEWTON},{_SIGMOIDS} SELECT a, b, c, slope, shift FROM nt JOIN st USING (member) WHERE k = 40 AND step = 30),
cell AS (SELECT DISTINCT x1, x2 FROM d),
model AS (SELECT 'logistic_regression' AS label, x1, x2, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS score FROM cell, lr
          UNION ALL SELECT 'linear_svm', x1, x2, avg(1 / (1 + exp(slope * (a * x1 + b * x2 + c) + shift))) FROM cell, svm GROUP BY x1, x2),
every AS (SELECT part, label, y, score FROM d JOIN model USING (x1, x2)),
truth AS (SELECT label, y, score FROM every WHERE part = 'val'), {fr.TUNED},
counted AS (SELECT label, threshold, part = 'test' AS tested, count(*) FILTER (score >= threshold AND y = 1) AS tp,
                   count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 0) AS tn,
                   count(*) FILTER (score < threshold AND y = 1) AS fn FROM every JOIN tuned USING (label) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM counted WHERE tested),
chosen AS (SELECT * FROM tested ORDER BY f1 DESC, label DESC LIMIT 1)"""


def _two_feature_run(spark, sf):
    """(rows, labels, encoded, space): whole texts once each, of whose features only two keywords train."""
    docs = texts(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    rows = docs.groupBy(F.col("text").alias("prompt")).agg(F.array(F.max("quality")).alias("y"))
    space = features.FeatureSpace((), (), (("the", (" the ",)), ("hashes", ("###",))))
    path = work_path(spark, "encoded")
    encoded = features.encode(split.with_split(rows), space)
    kept = F.filter(F.arrays_zip("indices", "values"), lambda c: (c["indices"] < 2) & (c["values"] != 0))
    encoded.withColumn("kept", kept).select(
        F.md5("prompt").alias("key"), "split", "y", F.col("kept.indices").alias("indices"), F.col("kept.values").alias("values")
    ).write.parquet(path)
    return rows, ["quality"], spark.read.parquet(path), space


@query("f8_choose_algorithm", _RUN + """
SELECT label AS algorithm, round(threshold, 6) AS threshold, f1, label = (SELECT label FROM chosen) AS chosen FROM tested""")
def choose_algorithm(spark, sf):
    """Both algorithms trained, tuned on the validation part and tested; the better one is chosen."""
    _, labels, encoded, space = _two_feature_run(spark, sf)
    best, meta = experiment.train_encoded(encoded, space, labels, work_path(spark, "model"), training.ALGORITHMS)
    rows = [(a, r["micro_f1"], a == best.algorithm) for a, r in meta["all_experiment_results"].items()]
    runs_of = spark.createDataFrame(rows, "algorithm string, f1 double, chosen boolean")
    cuts = []
    for a in training.ALGORITHMS:
        again = experiment.run_experiment("again", a, encoded, space, labels) if a != best.algorithm else best
        cuts.append((a, again.model.threshold_list()[0]))
    tuned = spark.createDataFrame(cuts, "algorithm string, threshold double")
    return runs_of.join(tuned, "algorithm").select("algorithm", F.round("threshold", 6).alias("threshold"), "f1", "chosen")


@query("h12_run_experiment", _RUN + """
SELECT label AS algorithm, 'quality' AS label, tp, fp, tn, fn,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp)::DOUBLE, 4) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn)::DOUBLE, 4) END AS recall, f1 FROM tested""")
def run_experiment(spark, sf):
    """Counts and metrics of both algorithms on the test part, as recorded and read back."""
    _, labels, encoded, space = _two_feature_run(spark, sf)
    out = work_path(spark, "runs")
    for a in training.ALGORITHMS:
        experiment.run_experiment(a, a, encoded, space, labels, out)
    found = runs.read_runs(spark, out)[1]
    return found.select("algorithm", "label", "tp", "fp", "tn", "fn", "precision", "recall", "f1")


@query("h14_evaluate_stored", _RUN + """
SELECT 'quality' AS label, any_value(threshold) AS threshold, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn
FROM counted WHERE label = (SELECT label FROM chosen)""")
def evaluate_stored(spark, sf):
    """The chosen model stored, read back and evaluated on all rows from their texts."""
    rows, labels, encoded, space = _two_feature_run(spark, sf)
    out = work_path(spark, "model")
    best, meta = experiment.train_encoded(encoded, space, labels, out, training.ALGORITHMS)
    artifacts.save_model(spark, out, space, best.model, meta)
    _, per_label = experiment.evaluate_stored(rows, out)
    return per_label.select("label", "threshold", "tp", "fp", "tn", "fn")


@query("f8_h12_h14_compare_train_evaluate")
def compare_train_evaluate(spark, sf):
    """Both algorithms, the better one stored, read back and evaluated on all labelled documents."""
    out = work_path(spark, "model")
    rows = training_rows(spark, sf)
    experiment.train(rows, TRAIN_LABELS, TRAIN_GROUPS, out, "compare", max_features=3000)
    _, per_label = experiment.evaluate_stored(rows, out)
    return per_label.select(*_RUN_COLUMNS)


@query("a8_model_artifact", """
WITH l AS (SELECT lang AS label, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS member FROM (SELECT DISTINCT lang FROM documents)),
i AS (SELECT unnest(range((SELECT count(*) + 13 FROM vocab))) AS idx)
SELECT label, member, 0.25::DOUBLE AS threshold, count(*) AS weights,
       round(sum(w), 6) AS weight_sum, round(sum(w * idx), 3) AS weight_moment
FROM (SELECT label, member, idx, (BUCKET - 500) / 500.0::DOUBLE AS w FROM l, i) GROUP BY label, member""".replace(
    "BUCKET", fr.sql_bucket("label || '|' || idx")).replace("WITH l AS", f"WITH {_VOCAB}, l AS"))
def model_artifact(spark, sf):
    """Save a model built on the table's vocabulary, read it back, list its members and thresholds."""
    space = features.space_from_vocabulary(_vocabulary(spark, sf), GROUPS)
    path = work_path(spark, "model")
    fixed = _fixed_model(space)
    tuned = spark.createDataFrame([(l, 0.25) for l in LANGS], "label string, threshold double")
    artifacts.save_model(spark, path, space, artifacts.with_threshold_table(fixed, tuned), {"source": "fixed"})
    again, model, _ = artifacts.load_model(spark, path)
    assert again == space and np.array_equal(model.weights, fixed.weights)
    members = artifacts.coefficient_table(spark, path).groupBy("member", "label_pos").agg(
        F.count(F.lit(1)).alias("weights"), F.round(F.sum("w"), 6).alias("weight_sum"),
        F.round(F.sum(F.col("w") * F.col("idx")), 3).alias("weight_moment"))
    names = spark.read.parquet(f"{path}/labels").select(F.col("pos").alias("label_pos"), "label", "threshold")
    return members.join(names, "label_pos").select("label", "member", "threshold", "weights", "weight_sum", "weight_moment")


# --- thresholds ----------------------------------------------------------------------------------

def _scored(spark, sf):
    docs = table(spark, sf, "documents")
    labels = fr.document_labels(docs)
    return fr.scored(docs, labels), labels


@query("g1_g2_tune_thresholds", f"""
WITH {fr.TRUTH}, {fr.TUNED}
SELECT label, threshold, round(f1, 6) AS best_f1 FROM tuned JOIN (SELECT label, f1 FROM best WHERE r = 1) USING (label)""")
def tune_thresholds(spark, sf):
    rows, labels = _scored(spark, sf)
    return thresholds.tune(rows, labels).select("label", "threshold", F.round("best_f1", 6).alias("best_f1"))


@query("g3_tune_without_floor", f"""
WITH {fr.TRUTH}, {fr.SWEEP}
SELECT label, t AS threshold, round(f1, 6) AS best_f1 FROM best WHERE r = 1""")
def tune_without_floor(spark, sf):
    rows, labels = _scored(spark, sf)
    return thresholds.tune(rows, labels, floor=0.0).select("label", "threshold", F.round("best_f1", 6).alias("best_f1"))


@query("g4_override", f"""
WITH {fr.TRUTH}, {fr.TUNED}
SELECT label, CASE WHEN label LIKE 'src1%' THEN 0.5::DOUBLE ELSE threshold END AS threshold,
       CASE WHEN label LIKE 'src1%' THEN 'set by hand' END AS note FROM tuned""")
def override(spark, sf):
    rows, labels = _scored(spark, sf)
    manual = spark.createDataFrame([(l, 0.5) for l in labels if l.startswith("src1")], "label string, threshold double")
    return thresholds.override(thresholds.tune(rows, labels), manual, "set by hand")


@query("g5_configured", """
SELECT source AS label, CASE WHEN avg(n_chars) > 2500 THEN round(avg(n_chars) / 2600, 6) ELSE 0.5 END AS threshold,
       CASE WHEN avg(n_chars) > 2500 THEN round(avg(n_chars) / 2600, 6) < 1 ELSE true END AS valid
FROM documents GROUP BY source""")
def configured(spark, sf):
    docs = table(spark, sf, "documents").groupBy(F.col("source").alias("label")).agg(F.avg("n_chars").alias("a"))
    config = docs.filter("a > 2500").select("label", F.round(F.col("a") / 2600, 6).alias("threshold"))
    return thresholds.configured(docs, config)


# --- metrics -------------------------------------------------------------------------------------

@query("h1_h2_per_label", f"""
WITH {fr.METRICS}
SELECT label, threshold, tp, fp, tn, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1
FROM scored JOIN tuned USING (label)""")
def per_label(spark, sf):
    rows, labels = _scored(spark, sf)
    cuts = thresholds.threshold_list(thresholds.tune(rows, labels), labels)
    found = metrics.per_label(metrics.confusion(rows, labels, cuts))
    return runs.recorded(found).select("label", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1")


_AUC = """, ranked AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score)
    + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM truth),
auc AS (SELECT label, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN
    (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auc
  FROM ranked GROUP BY label)"""


@query("h3_roc_auc", f"WITH {fr.TRUTH}{_AUC} SELECT label, round(auc, 6) AS auc FROM auc")
def roc_auc(spark, sf):
    rows, labels = _scored(spark, sf)
    return metrics.roc_auc(rows, labels).select("label", F.round("auc", 6).alias("auc"))


@query("h3_roc_auc_unguarded", f"""
WITH {fr.TRUTH}{_AUC} SELECT label, round(auc, 6) AS auc FROM auc
UNION ALL SELECT 'never', NULL UNION ALL SELECT 'always', -1.0""")
def roc_auc_unguarded(spark, sf):
    """Without the guard for labels of one class: no positives give null, no negatives NaN (shown as -1)."""
    rows, labels = _scored(spark, sf)
    both = rows.select(
        F.concat("y", F.array(F.lit(0), F.lit(1))).alias("y"), F.concat("scores", F.array(F.lit(0.5), F.lit(0.5))).alias("scores"))
    found = metrics.roc_auc(both, [*labels, "never", "always"], single_class_null=False)
    return found.select("label", F.when(F.isnan("auc"), -1.0).otherwise(F.round("auc", 6)).alias("auc"))


@query("h4_h11_summary", f"""
WITH {fr.METRICS}, exact AS (
  SELECT avg(CAST(ok AS DOUBLE)) AS e, count(*) AS n FROM (
    SELECT doc_id, bool_and((score >= threshold) = (y = 1)) AS ok FROM truth JOIN tuned USING (label) GROUP BY doc_id))
SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(f1), 6) AS macro_f1,
       round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1,
       round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS micro_precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS micro_recall,
       round(any_value(e), 6) AS exact_match, round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS tool_selection_accuracy,
       round(sum(tn) / sum(tn + fn)::DOUBLE, 6) AS tool_rejection_accuracy,
       round(1 - sum(tp + fp) / sum(tp + fp + tn + fn)::DOUBLE, 6) AS tool_reduction,
       round(sum(tp + fp) / any_value(n)::DOUBLE, 6) AS avg_tools_per_prompt
FROM scored, exact""")
def summary(spark, sf):
    rows, labels = _scored(spark, sf)
    cuts = thresholds.threshold_list(thresholds.tune(rows, labels), labels)
    out = metrics.summary(metrics.confusion(rows, labels, cuts))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_RUNS_SQL = f"WITH {fr.TRUTH}, th AS (SELECT unnest([0.2, 0.5, 0.8, 0.95])::DOUBLE AS threshold), " + """
c AS (SELECT threshold, label, count(*) FILTER (score >= threshold AND y = 1) AS tp,
             count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn
      FROM truth, th GROUP BY ALL),
m AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c),
r AS (SELECT 'run_' || threshold AS experiment_id, row_number() OVER (ORDER BY threshold) AS run_no,
             2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, avg(f1) AS macro_f1 FROM m GROUP BY threshold)"""


def _threshold_runs(spark, sf):
    """Runs that differ in one common threshold, with their per-label counts."""
    rows, labels = _scored(spark, sf)
    summaries, tables = [], []
    for i, t in enumerate((0.2, 0.5, 0.8, 0.95)):
        counts = metrics.confusion(rows, labels, [t] * len(labels))
        name = F.lit(f"run_{t}").alias("experiment_id")
        summaries.append(metrics.summary(counts).select(name, F.lit(i + 1).cast("long").alias("run_no"), "micro_f1", "macro_f1"))
        tables.append(metrics.per_label(counts).select(name, "label", "f1", "tp", "fn"))
    union = lambda a, b: a.unionByName(b)
    return reduce(union, summaries), reduce(union, tables)


@query("h13_best_run", _RUNS_SQL + """
SELECT experiment_id, run_no, round(micro_f1, 4) AS micro_f1, round(macro_f1, 4) AS macro_f1
FROM r ORDER BY round(r.micro_f1, 4) DESC, round(r.macro_f1, 4) DESC, run_no LIMIT 1""")
def best_run(spark, sf):
    summaries, _ = _threshold_runs(spark, sf)
    return runs.best_run(summaries)


@query("h15_weak_labels", _RUNS_SQL + """
SELECT 'run_' || threshold AS experiment_id, count(*) AS labels, count(*) FILTER (f1 = 0) AS labels_f1_zero,
       count(*) FILTER (f1 > 0) AS labels_with_signal, count(*) FILTER (tp + fn = 0) AS labels_without_positives
FROM m GROUP BY threshold""")
def weak_labels(spark, sf):
    _, tables = _threshold_runs(spark, sf)
    return runs.weak_labels(tables)
