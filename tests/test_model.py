import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import features, metrics, scoring, thresholds, training
from labelloom.operators.features import FeatureSpace
from labelloom.plans import experiment
from labelloom.sources import artifacts, runs


def brute_tfidf(texts, terms, idf):
    import re

    out = []
    for t in texts:
        w = re.findall(r"(?u)\b\w+\b", t.lower())
        grams = w + [" ".join(p) for p in zip(w, w[1:])]
        v = np.array([(1 + np.log(grams.count(x))) * i if grams.count(x) else 0.0 for x, i in zip(terms, idf)])
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return np.array(out)


TEXTS = ["Find the file", "find find the the class", "run tests now", "ü", "", "the file is in src/main.py"]


def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, prompt string")


def test_vocabulary_and_encoding(spark):
    voc = features.fit_vocabulary(docs(spark), max_features=8)
    rows = voc.orderBy("idx").collect()
    assert [r["term"] for r in rows] == sorted(r["term"] for r in rows) and len(rows) == 8
    top = {r["term"]: (r["cf"], r["df"]) for r in rows}
    assert top["the"] == (4, 3) and top["find"] == (3, 2) and rows[0]["n_docs"] == 6
    space = features.space_from_vocabulary(voc, [("f", ["fil"]), ("t", ["test"])])
    got = np.zeros((6, space.size))
    for r in features.encode(docs(spark), space).collect():
        assert len(r["indices"]) == len(set(r["indices"]))
        got[r["id"], r["indices"]] = r["values"]
    assert got[:, :8] == pytest.approx(brute_tfidf(TEXTS, space.terms, space.idf))
    assert got[:, 8].tolist() == [1, 0, 0, 0, 0, 1] and got[:, 9].tolist() == [0, 0, 1, 0, 0, 0]
    assert got[5, 10 + 6] == 1 and got[0, 10 + 7] == 1 and not np.isnan(got).any()
    assert len(space.names) == space.size == 18


@pytest.mark.parametrize("sample, sure, cells", [(1, 1, 1 << 18), (2, 1, 64), (1, 10**6, 64), (4, 1, 1 << 18)])
def test_vocabulary_by_cells(spark, monkeypatch, sample, sure, cells):
    """Whatever the guess, the same terms; a guess too high is noticed."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30) if x < 500) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string").repartition(3)
    plain = [[tuple(r) for r in features.fit_vocabulary(df, max_features=n, min_df=m).orderBy("idx").collect()]
             for n, m in ((40, 1), (40, 30), (10**5, 1))]
    for name, value in (("PRUNE_FROM_BYTES", 0), ("SAMPLE", sample), ("SURE", sure), ("CELLS", cells)):
        monkeypatch.setattr(features, name, value)
    assert plain == [[tuple(r) for r in features.fit_vocabulary(df, max_features=n, min_df=m).orderBy("idx").collect()]
                     for n, m in ((40, 1), (40, 30), (10**5, 1))]


def test_min_df_and_unseen_terms(spark):
    voc = features.fit_vocabulary(docs(spark), min_df=2)
    assert {r["term"] for r in voc.collect()} == {"find", "the", "file", "find the", "the file"}
    space = FeatureSpace(("zebra",), (1.0,))
    cells = features.features_long(features.encode(docs(spark), space), space, ["id"])
    assert cells.filter("idx = 0").isEmpty()
    bare = features.encode(docs(spark), FeatureSpace((), ()))
    assert bare.count() == 6


def dataset(spark, n=240, f=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, f)) * (rng.random((n, f)) < 0.5)
    w = rng.normal(size=(f, 2))
    y = (x @ w + 0.7 * rng.normal(size=(n, 2)) > 0.4).astype(int)
    y = np.hstack([y, np.zeros((n, 1), int), np.ones((n, 1), int)])
    rows = [
        (str(i), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]], [int(v) for v in y[i]])
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "prompt string, indices array<int>, values array<double>, y array<int>")
    return df.repartition(3), x, y


def solve(x, y, hinge, keep):
    """Reference optimum by damped Newton steps on the dense problem."""
    x, y = np.hstack([x, np.ones((len(x), 1))])[keep], y[keep]
    z, n, p = 2.0 * y - 1, len(y), y.sum()
    s = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    reg = np.eye(x.shape[1])
    if not hinge:
        reg[-1, -1] = 0

    def at(w):
        m = z * (x @ w)
        if hinge:
            h = np.maximum(0, 1 - m)
            return 0.5 * w @ reg @ w + (s * h * h).sum(), reg @ w - 2 * x.T @ (s * z * h), reg + 2 * (x.T * (s * (h > 0))) @ x
        q = 1 / (1 + np.exp(m))
        return 0.5 * w @ reg @ w + (s * np.logaddexp(0, -m)).sum(), reg @ w - x.T @ (s * z * q), reg + (x.T * (s * q * (1 - q))) @ x

    w = np.zeros(x.shape[1])
    for _ in range(200):
        f, g, h = at(w)
        step, t = np.linalg.solve(h, -g), 1.0
        while at(w + t * step)[0] > f + 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        w = w + t * step
    return w


def platt(m, y):
    p = y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (len(y) - p + 2))
    a = np.array([0.0, np.log((len(y) - p + 1) / (p + 1))])
    u = np.vstack([m, np.ones_like(m)]).T
    for _ in range(100):
        q = 1 / (1 + np.exp(u @ a))
        a = a - np.linalg.solve((u.T * (q * (1 - q))) @ u + 1e-12 * np.eye(2), u.T @ (t - q))
    return a


@pytest.fixture(params=["tasks", "passes", "by index", "passes by index", "one by one"])
def solver(request, monkeypatch):
    """All ways to multiply and to share out the work; they differ in plan only."""
    if request.param.startswith("passes"):
        monkeypatch.setattr(training, "LOCAL_VALUES", 0)
    if request.param in ("by index", "one by one"):
        monkeypatch.setattr(training, "LOCAL_CELLS", 0)
    if request.param == "passes by index":
        monkeypatch.setattr(training, "SPARSE_BELOW", 2)
    if request.param != "one by one":
        monkeypatch.setattr(training, "FEW", 0)


def test_logistic_regression_reaches_the_optimum(spark, solver):
    df, x, y = dataset(spark)
    model, report = training.fit_models(df, ["a", "b", "none", "all"], 12, tol=1e-7)
    for j in (0, 1):
        w = solve(x, y[:, j], False, np.ones(len(x), bool))
        assert model.weights[:, j] == pytest.approx(w[:-1], abs=1e-4) and model.intercepts[j] == pytest.approx(w[-1], abs=1e-4)
    assert [r["members"] for r in report] == [1, 1, 0, 0]
    scored = scoring.score_vectors(df, model).select("scores").collect()
    assert all(r[0][2] == 0.0 and r[0][3] == 0.0 and 0 < r[0][0] < 1 for r in scored)


def test_logistic_regression_agrees_with_mllib(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    df, x, y = dataset(spark, n=120)
    p = y[:, 0].sum()
    s = [len(y) / (2 * p) if v else len(y) / (2 * (len(y) - p)) for v in y[:, 0]]
    ml = spark.createDataFrame([(Vectors.dense(r), float(v), float(w)) for r, v, w in zip(x, y[:, 0], s)], ["features", "label", "w"])
    other = LogisticRegression(regParam=1.0 / len(y), standardization=False, weightCol="w", tol=1e-10, maxIter=500).fit(ml)
    model, _ = training.fit_models(df, ["a", "b", "none", "all"], 12, tol=1e-7)
    assert model.weights[:, 0] == pytest.approx(other.coefficients.toArray(), abs=1e-3)
    assert model.intercepts[0] == pytest.approx(other.intercept, abs=1e-3)


def test_calibrated_svm(spark, solver):
    df, x, y = dataset(spark)
    dealt = {r["prompt"]: r["fold"] for r in training.assign_folds(df, 4).collect()}
    folds = np.array([dealt[str(i)] for i in range(len(x))])
    model, _ = training.fit_models(df, ["a", "b", "none", "all"], 12, "linear_svm", tol=1e-7)
    assert model.member_label.tolist() == [0, 0, 0, 1, 1, 1]
    for member, (j, f) in enumerate((j, f) for j in (0, 1) for f in range(3)):
        fold = folds[:, j]
        w = solve(x, y[:, j], True, fold != f)
        assert model.weights[:, member] == pytest.approx(w[:-1], abs=1e-3)
        ab = platt((x @ model.weights[:, member] + model.intercepts[member])[fold == f], y[fold == f, j])
        assert (model.slope[member], model.offset[member]) == pytest.approx(tuple(ab), abs=1e-3)
    expected = [
        np.mean([1 / (1 + np.exp(model.slope[m] * (r @ model.weights[:, m] + model.intercepts[m]) + model.offset[m])) for m in range(3)])
        for r in x
    ]
    got = {r["prompt"]: r["scores"][0] for r in scoring.score_vectors(df, model).collect()}
    assert [got[str(i)] for i in range(len(x))] == pytest.approx(expected)


def test_folds_are_balanced_whatever_the_number_of_cells(spark, monkeypatch):
    df, _, y = dataset(spark)
    found = []
    for together in (512, 3):
        monkeypatch.setattr(training, "RANKED_TOGETHER", together)
        got = training.assign_folds(df, 4).select("prompt", "y", "fold").collect()
        found.append(sorted((r["prompt"], r["fold"]) for r in got))
        for j in (0, 1):
            for v in (0, 1):
                sizes = np.bincount([r["fold"][j] for r in got if r["y"][j] == v], minlength=3)
                assert sizes.max() - sizes.min() <= 1
    assert found[0] == found[1]


def test_partial_sums_added_on_executors(spark, monkeypatch):
    monkeypatch.setattr(training, "LOCAL_VALUES", 0)
    df, *_ = dataset(spark, n=60)
    direct, _ = training.fit_models(df, ["a", "b", "none", "all"], 12)
    monkeypatch.setattr(training, "DIRECT_PARTIALS", 1)
    monkeypatch.setattr(training, "SLICE_CELLS", 5)
    monkeypatch.setattr(training, "GROUP_CELLS", 13)
    staged, _ = training.fit_models(df, ["a", "b", "none", "all"], 12)
    assert staged.weights == pytest.approx(direct.weights, abs=1e-8)
    with pytest.raises(ValueError):
        training.fit_models(df, ["a"], 12, "tree")


@pytest.mark.parametrize("algorithm", training.ALGORITHMS)
def test_few_passes_on_features_of_unlike_size(spark, monkeypatch, algorithm):
    monkeypatch.setattr(training, "LOCAL_VALUES", 0)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 30)) * 10.0 ** rng.uniform(-1.5, 1.0, 30)
    y = (x @ rng.normal(size=30) + 3.0 * rng.normal(size=600) > 0).astype(int)
    rows = [(str(i), [*range(30)], [float(v) for v in x[i]], [int(y[i])]) for i in range(600)]
    df = spark.createDataFrame(rows, "prompt string, indices array<int>, values array<double>, y array<int>").repartition(3)
    model, report = training.fit_models(df, ["a"], 30, algorithm, tol=1e-6, max_passes=500)
    assert report[0]["gradient"] <= 1e-6 and report[0]["passes"] <= 40
    if algorithm == "logistic_regression":
        want = solve(x, y, False, np.ones(600, bool))
        assert np.append(model.weights[:, 0], model.intercepts[0]) == pytest.approx(want, abs=1e-2)


def test_inverse_factor_of_any_matrix(monkeypatch):
    monkeypatch.setattr(training, "CURVED_LINES", 3)
    x = np.random.default_rng(2).normal(size=(20, 8))
    for matrix in (x.T @ x, np.ones((8, 8)), np.zeros((8, 8))):
        held, factor = np.zeros((8, 8)), np.zeros((8, 8))
        for a in range(0, 8, 3):
            held[a:a + 3, :a + 3] = matrix[a:a + 3, :a + 3]
        for a, lines in training.inverse_factor(held):
            factor[a:a + len(lines), :lines.shape[1]] = lines
        assert np.isfinite(factor).all() and np.linalg.matrix_rank(factor) == 8
        if np.linalg.matrix_rank(matrix) == 8:
            assert factor.T @ factor @ matrix == pytest.approx(np.eye(8), abs=1e-9)


@pytest.mark.parametrize("hinge", [False, True])
def test_estimated_curvature_is_the_whole_one_if_all_rows_are_drawn(spark, monkeypatch, hinge):
    monkeypatch.setattr(training, "CURVED_ROWS", 10_000)
    monkeypatch.setattr(training, "CURVED_LINES", 5)
    df, x, y = dataset(spark)
    if hinge:
        df = training.assign_folds(df, 4)
    blocks = training.Blocks(training.pack(df, 12), 3, 12, 4, 240, int((x != 0).sum()))
    label, ones = np.array([1, 0]), np.ones(2)
    spec = {"label": label, "held_out": np.array([255, 255]), "w_pos": 2.0 * ones, "w_neg": ones}
    curvature = training.Curvature.of(blocks, spec, hinge, 0.5)
    vectors, theta = np.random.default_rng(1).normal(size=(2, 2, 13))
    assert (curvature.times(vectors, np.arange(2)) == vectors).all()
    curvature.estimate(theta, np.arange(2))
    found = curvature.times(vectors[[1, 0, 1]], np.array([1, 0, 1]))
    x1 = np.hstack([x, np.ones((240, 1))])
    for got, j in zip(found, (1, 0, 1), strict=True):
        z = 2.0 * y[:, label[j]] - 1
        m, s = z * (x1 @ theta[j]), np.where(z > 0, 2.0, 1.0)
        q = 1 / (1 + np.exp(-m))
        h = 0.5 * (2 * s * (m < 1) if hinge else s * q * (1 - q))
        reg = np.eye(13)
        reg[-1, -1] = hinge
        assert got == pytest.approx(np.linalg.solve((x1.T * h) @ x1 + reg, vectors[j]), rel=1e-4, abs=1e-5)
    curvature.close()
    curvature.estimate(np.tile([0.0] * 12 + [1e6], (2, 1)), np.arange(2))  # labels of flat losses, or of few curved rows
    assert np.isfinite(curvature.times(vectors, np.arange(2))).all()
    curvature.close()


def test_driver_gets_one_vector_a_pass(spark, monkeypatch):
    monkeypatch.setattr(training, "LOCAL_VALUES", 0)
    monkeypatch.setattr(training, "DIRECT_CELLS", 10)
    df, *_ = dataset(spark, n=60)
    kind, got = type(df), []
    collect = kind.collect

    def seen(frame):
        rows = collect(frame)
        if "sums" in frame.columns:
            got.append(sum(len(r["sums"]) for r in rows) // 8)
        return rows

    monkeypatch.setattr(kind, "collect", seen)
    training.fit_models(df.repartition(4), ["a", "b", "none", "all"], 12)
    assert got and max(got) == 2 * (12 + 2)


def test_margins_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, 40)
    starts = np.concatenate([[0], np.cumsum(counts)])
    idx, val, w = rng.integers(0, 9, starts[-1]), rng.normal(size=starts[-1]), rng.normal(size=(9, 3))
    dense = np.zeros((40, 9))
    np.add.at(dense, (np.repeat(np.arange(40), counts), idx), val)
    for size in (1, 7, 10_000):
        monkeypatch.setattr(scoring, "_CHUNK_CELLS", size)
        assert scoring.margins(idx, val, starts, w) == pytest.approx(dense @ w)


def scored(spark, y, s):
    return spark.createDataFrame([([int(a)], [float(b)]) for a, b in zip(y, s)], "y array<int>, scores array<double>")


def test_threshold_ties_floor_and_single_class(spark):
    tied = scored(spark, [1, 1, 0], [0.95, 0.92, 0.05])
    assert thresholds.tune(tied, ["a"], floor=0.0).first()["threshold"] == 0.10
    assert thresholds.tune(tied, ["a"]).first()["threshold"] == 0.30
    high = scored(spark, [1, 0, 0], [0.75, 0.7, 0.65])
    assert thresholds.tune(high, ["a"]).first()["threshold"] == 0.75
    for y in ([0, 0], [1, 1]):
        r = thresholds.tune(scored(spark, y, [0.1, 0.9]), ["a"]).first()
        assert r["threshold"] == 0.5 and not r["swept"]


@pytest.mark.parametrize(
    "score,threshold,selected",
    [(0.91, 0.5, 1), (0.5, 0.5, 1), (0.499, 0.5, 0), (0.7, 0.7, 1), (0.699, 0.7, 0), (1.0, 0.5, 1), (0.0, 0.5, 0)],
)
def test_threshold_is_inclusive(spark, score, threshold, selected):
    df = scored(spark, [0], [score])
    assert df.select(scoring.predict(F.col("scores"), [threshold])).first()[0] == [selected]


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    s[:100] = 0.5  # one score holds a third of the rows
    s[100:200] = 0.5 + 1e-7 * np.arange(100)  # and many share a grid cell
    pos, neg = s[y == 1], s[y == 0]
    exact = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert metrics.roc_auc(scored(spark, y, s), ["a"]).first()["auc"] == pytest.approx(exact)
    assert metrics.roc_auc(scored(spark, [1, 1], [0.2, 0.3]), ["a"]).first()["auc"] is None


def test_summary_edge_cases(spark):
    none = metrics.summary(metrics.confusion(scored(spark, [1, 0], [0.1, 0.2]), ["a"], [0.5])).first()
    assert none["tool_selection_accuracy"] is None and none["micro_f1"] == 0.0 and none["tool_reduction"] == 1.0
    all_ = metrics.summary(metrics.confusion(scored(spark, [1, 0], [0.6, 0.7]), ["a"], [0.5])).first()
    assert all_["tool_rejection_accuracy"] is None and all_["avg_tools_per_prompt"] == 1.0 and all_["exact_match"] == 0.5


def test_training_run_and_artifact(spark, tmp_path):
    words = {"find": "a", "run": "b"}
    rows = [(f"{w} item {i} {'x' * (i % 5)}", [int(w == "find"), int(w == "run")]) for i in range(60) for w in words]
    df = spark.createDataFrame(rows, "prompt string, y array<int>")
    out = str(tmp_path / "model")
    meta = experiment.train(df, ["a", "b"], [("a", ["find"]), ("b", ["run"])], out, "compare", max_features=20)
    assert meta["evaluation_metrics"]["micro_f1"] == 1.0 and set(meta["all_experiment_results"]) == set(training.ALGORITHMS)
    assert meta["algorithm"] == "logistic_regression"  # first on a tie
    space, model, details = artifacts.load_model(spark, out)
    assert details["run_id"] == meta["run_id"] and space.size == meta["feature_count"]
    assert set(model.thresholds.values()) <= {0.3, *thresholds.CUTS}
    summary, per_label = experiment.evaluate_stored(df, out)
    assert summary.first()["exact_match"] == 1.0 and per_label.count() == 2
    stored, stored_labels = runs.read_runs(spark, f"{out}/experiments")
    assert stored.count() == 2 and stored_labels.count() == 4
    with pytest.raises(artifacts.ModelNotFound):
        artifacts.load_model(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        experiment.train(df, ["a", "b"], [], out, "forest")
