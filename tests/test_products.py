"""Products in blocks against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import products, scoring


@pytest.fixture(params=[(4096, 512, 1 << 26), (7, 3, 1 << 26), (5, 4, 200)])
def sizes(request, monkeypatch):
    """Blocks wider than the matrix, many small ones, and rows of a slice dealt to several tasks."""
    for name, value in zip(("FEATURES", "MEMBERS", "GROUP_BYTES"), request.param):
        monkeypatch.setattr(products, name, value)
    monkeypatch.setattr(products, "ROW_BITS", 4)
    monkeypatch.setattr(products, "ROWS", 16)


def rows_of(spark, n=90, f=20):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, f)) * (rng.random((n, f)) < 0.3)
    x[7] = 0
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id int, indices array<int>, values array<double>").repartition(3)


def test_scores_of_a_matrix_in_blocks(spark, sizes, monkeypatch):
    x, df = rows_of(spark)
    rng = np.random.default_rng(6)
    model = scoring.LinearModel(
        ("a", "b", "none", "c"), rng.normal(size=(20, 8)), rng.normal(size=8), np.array([0, 0, 0, 1, 3, 3, 3, 1]),
        -1 + rng.random(8) / 4, rng.random(8))
    plain = {r["id"]: r["scores"] for r in scoring.score_vectors(df, model).collect()}
    monkeypatch.setattr(scoring, "MAX_MODEL_CELLS", 10)
    got = scoring.score_vectors(df.withColumn("row", F.lit("mine")), model)
    assert got.columns == ["id", "indices", "values", "row", "scores"]
    found = got.collect()
    assert len(found) == 90 and all(r["row"] == "mine" for r in found)
    for r in found:
        assert r["scores"] == pytest.approx(plain[r["id"]], abs=1e-12) and r["scores"][2] == 0.0


def test_join_of_tables(spark, sizes):
    x, df = rows_of(spark)
    rng = np.random.default_rng(7)
    w, b = rng.normal(size=(18, 5)), rng.normal(size=5)
    long = df.select("id", F.explode(F.arrays_zip(F.col("indices").alias("f"), F.col("values").alias("v"))).alias("c")).select(
        "id", F.col("c.f").alias("feature"), F.col("c.v").alias("value"))
    coef = spark.createDataFrame([(f"l{j}", i, float(w[i, j])) for i in range(18) for j in range(5)], "label string, feature int, w double")
    bias = spark.createDataFrame([(f"l{j}", float(b[j])) for j in range(5)] + [("other", 1.0)], "label string, b double")
    got = {(r["id"], r["label"]): (r["margin"], r["score"]) for r in scoring.score_by_join(long, coef, bias, "id").collect()}
    held = [i for i in range(90) if x[i, :18].any()]
    assert set(got) == {(i, f"l{j}") for i in held for j in range(5)}
    for (i, l), (m, s) in got.items():
        expected = x[i, :18] @ w[:, int(l[1])] + b[int(l[1])]
        assert m == pytest.approx(expected) and s == pytest.approx(1 / (1 + np.exp(-expected)))


def test_no_rows(spark):
    _, df = rows_of(spark)
    model = scoring.logistic_model(["a"], np.ones((20, 1)), np.zeros(1))
    assert scoring.score_in_blocks(df.limit(0), model).collect() == []


def test_groups_are_sized_by_all_that_packets_hold(spark):
    rows = spark.createDataFrame([(i, list(range(50)), [1.0] * 50) for i in range(30)], "row long, indices array<int>, values array<double>")
    packets = products._packets(rows)
    held = sum(len(p["pos"]) + len(p["idx"]) + len(p["val"]) for p in packets.collect())
    assert packets.select(products.packet_bytes().alias("n")).agg({"n": "sum"}).first()[0] == held == 30 * 50 * 16
