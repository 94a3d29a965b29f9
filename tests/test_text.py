import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.operators import features


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given,expected",
    [
        (None, ""), ("", ""), (" \t\n", ""), ("  FIND   x ", "find x"), ("A  B", "a b"),
        ("\x1cÉA\x85", "éa"), ("a​b", "a​b"),
    ],
)
def test_normalize(spark, given, expected):
    assert one(spark, given, tx.normalize(F.col("s"))) == expected
    if given is not None:
        assert expected == re.sub(r"\s+", " ", given.lower().strip())


@pytest.mark.parametrize("given", ["Héllo wörld_1 x", "a-b c.d", "ü", "x²", "ño", "١٢ ab"])
def test_words_are_unicode_words(spark, given):
    assert one(spark, given, tx.words(F.col("s"))) == re.findall(r"(?u)\b\w+\b", given)


@pytest.mark.parametrize(
    "given,n,expected",
    [("one", 2, ["one"]), ("", 2, []), ("a b c", 2, ["a", "b", "c", "a b", "b c"]),
     ("a b c", 3, ["a", "b", "c", "a b", "b c", "a b c"])],
)
def test_ngrams(spark, given, n, expected):
    assert one(spark, given, tx.ngrams(tx.words(F.col("s")), 1, n)) == expected


@pytest.mark.parametrize(
    "given,expected",
    [
        ("", [0.0, 0.0, 0, 0, 0, 0, 0, 0]),
        ("find users.py", [13 / 200, 2 / 30, 0, 1, 0, 0, 1, 1]),
        ("is get_user() here?", [19 / 200, 3 / 30, 1, 0, 1, 1, 0, 0]),
        ("x" * 500, [1.0, 1 / 30, 0, 0, 0, 0, 0, 0]),
        ("readme.md please", [16 / 200, 2 / 30, 0, 1, 0, 0, 0, 0]),
        ("finder.TXT", [10 / 200, 1 / 30, 0, 1, 0, 0, 1, 0]),
    ],
)
def test_structural(spark, given, expected):
    got = one(spark, given, F.array(*tx.structural(F.col("s"))))
    assert got == pytest.approx([float(x) for x in expected])


def test_keywords_match_substrings(spark):
    groups = [("dir", ["LS", "list"]), ("web", ["internet"]), ("under", ["_"])]
    assert one(spark, "Tools", tx.keyword_flags(F.col("s"), groups)) == [True, False, False]
    assert one(spark, "a_b", tx.keyword_flags(F.col("s"), groups)) == [False, False, True]


@pytest.mark.parametrize(
    "cell,expected",
    [
        ('["a"]', ["a"]), ('["a", "b"]', ["a", "b"]), ("a, b,", ["a", "b"]), (None, []), ('"a"', ["a"]),
        ('{"a":1}', ["a"]), ("", []), ("  ", []), ("5", []), ("-1.5e3", []), ("null", []), ("true", []),
        ("[]", []), ("[broken, x", ["[broken", "x"]), ("a b", ["a b"]), ('"a, b"', ["a, b"]),
    ],
)
def test_label_cells(spark, cell, expected):
    assert one(spark, cell, tx.parse_label_cell(F.col("s"))) == expected


def test_blank(spark):
    for value, blank in [(None, True), ("", True), ("\t  ", True), (" x", False)]:
        assert one(spark, value, tx.is_blank(F.col("s"))) is blank


ODD = [None, "", " \t", "a", "A a a b", "x-y_z  x-y_z x", "ß É é 日本 ١٢ ½ é", "b a b a b " * 400, "İst Σ Σ", "a b c a b c d"]


@pytest.mark.parametrize("spans", [(1, 2), (2, 3), (1, 4)])
def test_counts_of_slices_add_up(spark, monkeypatch, spans):
    """A row per n-gram and slice, the same sums as of the n-grams of every text, and the same counts by key."""
    monkeypatch.setattr(features, "SLICE_BYTES", 40)
    df = spark.createDataFrame([(i % 4 or None, t) for i, t in enumerate(ODD * 3)], "id int, prompt string").repartition(2)
    grams = df.select("id", features.grams_of(F.col("prompt"), spans).alias("g")).collect()
    cf = Counter(g for r in grams for g in r["g"])
    df_of = Counter(g for r in grams for g in set(r["g"]))
    expected = {(g, cf[g], df_of[g]) for g in cf} | {(features.DOCUMENTS, len(grams), len(grams))}
    assert {tuple(r) for r in features.term_counts(df, "prompt", spans).collect()} == expected
    assert features.gram_rows(df, "prompt", spans).count() < sum(cf.values())
    by_key = Counter((r["id"], g) for r in grams for g in r["g"])
    found = features.grams_by_key(df, "id", "prompt", spans).groupBy("id", "term").agg(F.sum("tf"))
    assert {tuple(r) for r in found.collect()} == {(*k, n) for k, n in by_key.items()}


@pytest.mark.parametrize("spans", [(1, 1), (1, 2), (2, 3)])
def test_encoding_looks_up_terms_of_any_length(spark, monkeypatch, spans):
    monkeypatch.setattr(features, "SLICE_BYTES", 40)
    terms = ("a", "a b", "b a b", "d", "é", "never seen", "x", "y_z x", "日本")
    space = features.FeatureSpace(terms, (1.0,) * len(terms), (), spans, False)
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, prompt string").repartition(2)
    counted = {r["id"]: Counter(g for g in r["g"] if g in terms) for r in df.select(
        "id", features.grams_of(F.col("prompt"), spans).alias("g")).collect()}
    assert sum(map(len, counted.values())) > 4
    for r in features.encode(df, space).collect():
        held = counted[r["id"]]
        length = sum(n * n for n in held.values()) ** 0.5
        cells = [(i, v) for i, v in zip(r["indices"], r["values"]) if i < len(terms)]
        assert cells == [(i, pytest.approx(held[t] / length)) for i, t in enumerate(terms) if t in held]


def test_counts_by_key_have_parts_as_the_input_grows(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(ODD * 20)], "id int, prompt string").repartition(2).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    vocabulary = features.fit_vocabulary(df, max_features=9)
    expected = {(r["id"], r["term"]): r["value"] for r in features.tfidf_by_join(df, vocabulary, "id").collect()}
    monkeypatch.setattr(features, "KEY_BYTES", 64)
    found = features.tfidf_by_join(df, vocabulary, "id")
    assert found.rdd.getNumPartitions() == features.key_parts(df) > 10
    assert {(r["id"], r["term"]): r["value"] for r in found.collect()} == pytest.approx(expected)
    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    grams = Counter((r["id"], g) for r in df.select("id", features.grams_of(F.col("prompt")).alias("g")).collect() for g in r["g"])
    assert expected.keys() == {k for k in grams if k[1] in idf}
    assert features.key_parts(spark.createDataFrame(df.rdd, df.schema)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
