"""Importance resampling against a plain version."""

import random

import brute
import pytest
from pyspark.sql import functions as F
from test_operators import plain, rows

from labelloom.llm import importance

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.fixture(scope="module")
def items(spark, docs):
    found = [(1, docs[0][1] or "x y"), (2, None), (3, ""), (None, "An entry without id"), (4, docs[7][1])]
    return found, spark.createDataFrame([(*x, 5) for x in found], "item_id long, text string, score int")


@pytest.mark.parametrize("order, percent", [(1, 10), (3, 60), (2, 100)])
def test_every_row(frame, docs, items, order, percent, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 1000)
    got = importance.resample(frame, items[1], order=order, percent=percent)
    expected = brute.importance(docs, items[0], order, percent=percent)
    found, plainly = rows(got, *COLUMNS), plain(expected)
    # Rows of one key and score share their ranks in any order.
    assert [x[:4] for x in found] == [x[:4] for x in plainly]
    for a, b in ((found, plainly),):
        def shared(x):
            return sorted((r[0] is None, r[0] or 0, r[3], r[4] or 0) for r in x)
        assert shared(a) == shared(b)
    drawn = [r[4] for r in found if r[4] is not None]
    assert sorted(drawn) == list(range(1, len(drawn) + 1)) and drawn


def test_one_key_and_one_text_in_most_rows(spark, items):
    rng = random.Random(3)
    found = [(7, "again and " * 15) for _ in range(300)] + [(None, "again and " * 15) for _ in range(200)]
    found += [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60)))) for i in range(100, 400)]
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(5)
    got = rows(importance.resample(df, items[1], percent=50), "doc_id", "score", "rank")
    expected = [(r[0], r[3], r[4]) for r in brute.importance(found, items[0], percent=50)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_columns_carried_and_empty_tables(spark, frame, items, nothing):
    clashing = frame.withColumns({"deal": F.lit("d"), "place": F.lit("p"), "number": F.lit("n"), "ahead": F.lit("a")})
    got = importance.resample(clashing, items[1], more=("text", "lang", "n_words", "deal", "place", "number", "ahead"))
    assert got.columns == ["doc_id", "text", "lang", "deal", "number", "ahead", "n_words", "n_features", "weight", "score", "rank"]
    assert {tuple(r) for r in got.select("deal", "number", "ahead").collect()} == {("d", "n", "a")}
    assert importance.resample(nothing, items[1]).collect() == []
    free = importance.resample(frame, items[1].limit(0))
    assert free.filter("rank is not null").count() > 0


def test_cross_text_runs_are_masked():
    texts = [b"A b", b"", b"c", b"d e F"]
    blocks = list(importance.features(texts, 2, 1 << 32))
    owner = [int(x) for b in blocks for x in b[1]]
    assert sorted(owner) == [0, 0, 0, 2, 3, 3, 3, 3, 3]
