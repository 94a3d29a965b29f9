import pytest
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.functions.sizing import TooLarge, bounded_rows
from labelloom.operators import adapters, features, quality, split
from labelloom.sources import catalogs, prompts

L = ["a", "b", "c"]


def rows(df):
    return {r["prompt"]: list(r["y"]) for r in df.collect()}


@pytest.mark.parametrize(
    "columns,expected",
    [
        (["Prompt ", " TOOL", "Label"], "paired_rows"), (["prompt", "a", "b", "c"], "canonical"),
        (["prompt", "tools"], "json_tools_col"), (["PROMPT", "Relevant_Tools"], "json_tools_col"),
        (["text", "tool", "label"], "unknown"), (["prompt", "a"], "unknown"),
        (["prompt", "a", "b", "c", "tool", "label"], "canonical"),
    ],
)
def test_detect_schema(columns, expected):
    assert adapters.detect_schema(columns, L) == expected


def test_paired_rows(spark):
    df = spark.createDataFrame(
        [("p", "a", "0"), ("p", "a", "1"), ("p", "b", "x"), ("q", "zzz", "1"), ("r", "c", None), ("s", "c", "5"),
         ("t", "b", "0"), ("t", "c", None), (None, "a", "1")],
        "`Prompt ` string, ` TOOL` string, Label string",
    )
    assert rows(adapters.to_canonical(df, L)) == {"p": [1, 0, 0], "s": [0, 0, 1], "t": [0, 0, 0]}


def test_large_paired_rows_fold_in_parts_that_grow_in_number(spark, monkeypatch, tmp_path):
    spark.range(4000).selectExpr(
        "if(id % 3 = 0, 'often', concat('p', id % 700)) AS prompt", "element_at(array('a', 'b', 'c', 'zzz'), int(id % 4) + 1) AS tool",
        "if(id % 11 = 0, null, int(id % 5 = 0)) AS label").repartition(3).write.parquet(str(tmp_path / "pairs"))
    df = spark.read.parquet(str(tmp_path / "pairs"))
    small = adapters.from_paired_rows(df, L)
    want = rows(small)
    expected = {}
    for r in df.collect():
        if r["tool"] in L and r["label"] is not None:
            expected.setdefault(r["prompt"], [0, 0, 0])[L.index(r["tool"])] |= r["label"]
    assert want == expected
    monkeypatch.setattr(features, "KEY_BYTES", 64)
    large = adapters.from_paired_rows(df, L)
    assert rows(large) == expected and large.count() == len(expected)
    # No step gathers the prompts of a whole input split: rows are dealt into the parts before they are folded.
    parts = features.key_parts(df)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert parts > 100 and large.rdd.getNumPartitions() == parts
    below = plan[plan.rindex("hashpartitioning(prompt"):]
    assert "_origin" in below.splitlines()[0] and "Aggregate" not in below


def test_paired_rows_with_many_labels(spark):
    labels = [f"l{i:03d}" for i in range(200)]
    pairs = [(f"p{i % 7}", labels[i], 1) for i in range(0, 200, 3)] + [("p0", labels[1], 0)]
    got = rows(adapters.from_paired_rows(spark.createDataFrame(pairs, "prompt string, tool string, label int"), labels))
    for p, y in got.items():
        assert {labels[i] for i, v in enumerate(y) if v} == {t for q, t, v in pairs if q == p and v}


def test_label_lists_keep_prompts_without_known_tool(spark):
    df = spark.createDataFrame([("p", '["a","zzz"]'), ("q", "zzz"), ("r", None), (" ", "a")], "prompt string, relevant_tools string")
    assert rows(adapters.to_canonical(df, L)) == {"p": [1, 0, 0], "q": [0, 0, 0], "r": [0, 0, 0]}
    arrays = spark.createDataFrame([("p", ["b"]), ("q", None)], "prompt string, tools array<string>")
    assert rows(adapters.to_canonical(arrays, L)) == {"p": [0, 1, 0], "q": [0, 0, 0]}


def test_coercion(spark):
    given = ["0.7", "1.9", "-1", "abc", "5", "True", None, "inf", "NaN", " 1 "]
    df = spark.createDataFrame([(g,) for g in given], "v string")
    assert [r[0] for r in df.select(lb.coerce(F.col("v"))).collect()] == [0, 1, 0, 0, 1, 0, 0, 1, 0, 1]


def test_unknown_schema_and_missing_columns(spark):
    df = spark.createDataFrame([("x", 1)], "text string, z int")
    with pytest.raises(ValueError, match="Unknown schema"):
        adapters.to_canonical(df, L)
    with pytest.raises(ValueError, match="Missing columns"):
        adapters.from_wide(df.withColumnRenamed("text", "prompt"), L)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('prompt,tool,label\n"line one\nline ""two""",a,1\nplain,b,1\nplain,a,0\n')
    assert rows(prompts.load_labelled(spark, path, L, multiline=True)) == {'line one\nline "two"': [1, 0, 0], "plain": [0, 1, 0]}
    with pytest.raises(Exception):
        prompts.load_labelled(spark, str(tmp_path / "none.csv"), L)
    with pytest.raises(ValueError):
        prompts.load_sources(spark, "nope", {}, L)


def test_prompt_records(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('[{"prompt": " hi ", "relevant_tools": ["a"]}, {"relevant_tools": ["b"]}, {"prompt": "x"}]')
    records = prompts.read_prompt_records(spark, str(path))
    assert sorted((r[0], list(r[1])) for r in records.collect()) == [("", ["b"]), (" hi ", ["a"]), ("x", [])]
    long = prompts.long_table(records, L)
    assert long.count() == 6
    assert {(r["prompt"], r["tool"]) for r in long.filter("label = 1").collect()} == {("hi", "a")}


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"z": {"description": "Z", "category": "k", "use_when": "u"}, "a": {}, "__x": {}, "__meta__": {"version": "3"}}')
    cat = catalogs.read_catalog(spark, str(path))
    got = [(r["label"], r["description"], r["category"], r["version"]) for r in cat.orderBy("pos").collect()]
    assert got == [("z", "Z", "k", "3"), ("a", "", "unknown", "3")]
    assert catalogs.ordered_labels(cat) == ["z", "a"]
    looked = catalogs.describe_labels(spark.createDataFrame([("z",), ("q",)], "label string"), cat)
    assert {tuple(r) for r in looked.collect()} == {("z", "Z", "k", True), ("q", "", "unknown", False)}


def test_tool_list(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"tools": [{"name": " a ", "description": "old"}, {"name": ""}, {"name": "b"}, {"name": "a", "description": "new", "category": "c"}]}')
    got = catalogs.catalog_from_tools(catalogs.read_tool_list(spark, str(path))).orderBy("pos").collect()
    assert [(r["label"], r["description"], r["category"]) for r in got] == [("a", "new", "c"), ("b", "", "unknown")]


def test_bounded_rows(spark):
    assert len(bounded_rows(spark.range(5), 5, "x")) == 5
    with pytest.raises(TooLarge):
        bounded_rows(spark.range(6), 5, "x")


def test_quality(spark):
    df = spark.createDataFrame(
        [("p", [0, 1, 1]), ("p", [1, 0, 1]), ("q", [0, 0, 1]), (" \t", [1, 1, 1]), ("r", [0, 0, 1]), ("s", [4, 0, 1])],
        "prompt string, y array<int>",
    )
    assert rows(quality.clean(df, L)) == {"p": [1, 1, 1], "q": [0, 0, 1], "r": [0, 0, 1], "s": [1, 0, 1]}
    many = [f"l{i}" for i in range(130)]
    wide = spark.createDataFrame([("a", [int(i % 7 == k) for i in range(130)]) for k in (0, 3)] + [("b", [2] * 130)],
                                 "prompt string, y array<int>")
    assert rows(quality.clean(wide, many)) == {"a": [int(i % 7 in (0, 3)) for i in range(130)], "b": [1] * 130}
    assert rows(quality.clean(wide.selectExpr("prompt", "array() AS y"), [])) == {"a": [], "b": []}
    messages = [r["message"] for r in quality.quality_report(df, L).orderBy("check_no", "pos").collect()]
    assert messages == [
        "Found 1 empty prompts — removed",
        "Found 1 duplicate prompts — merged with OR logic",
        "Tool 'a' has only 1 positive examples — may underperform",
        "Tool 'b' has only 1 positive examples — may underperform",
        "Tool 'c' has ZERO negative examples — model cannot learn it",
        "Tool 'a' has 1 invalid labels — clipped to 0/1",
        "Total rows removed: 2",
    ]
    clean = spark.createDataFrame([("x", [0, 0, 0])], "prompt string, y array<int>")
    texts = [r["message"] for r in quality.quality_report(clean, L).collect()]
    assert "Found 1 prompts with no tool selected — kept (valid negative examples)" in texts


def test_describe_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "prompt string, y array<int>")
    assert quality.describe_dataset(empty, L).first()["n_rows"] == 0
    df = spark.createDataFrame([("p", [1, 1, 0]), ("p", [0, None, 0]), (None, [0, 0, 0])], "prompt string, y array<int>")
    r = quality.describe_dataset(df, L).first()
    assert (r["n_rows"], r["unique_prompts"], r["duplicate_prompts"], r["missing_values"]) == (3, 1, 1, 2)
    assert (r["max_labels"], r["multi_label_prompts"]) == (2, 1)


@pytest.mark.parametrize("n", [1, 5, 409, 1039, 20000])
def test_exact_split_sizes(spark, n):
    df = spark.range(n).withColumn("prompt", F.col("id").cast("string"))
    got = {r["split"]: r["count"] for r in split.exact_split(df).groupBy("split").count().collect()}
    train, val, test = split.split_sizes(n)
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == (train, val, test)
    if n in (409, 1039):
        assert test == {409: 82, 1039: 208}[n]


def test_hash_split_is_stable_and_keeps_copies_together(spark):
    df = spark.createDataFrame([(f"t{i % 500}",) for i in range(1000)], "prompt string")
    parts = split.with_split(df)
    assert parts.groupBy("prompt").agg(F.count_distinct("split").alias("k")).filter("k > 1").isEmpty()
    assert parts.exceptAll(split.with_split(df.repartition(3))).isEmpty()


def test_unseen_only_keeps_the_first_copy(spark):
    new = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, "c")], "prompt string, seq int, tool string")
    old = spark.createDataFrame([("y",)], "prompt string")
    assert [tuple(r) for r in adapters.unseen_only(new, old).collect()] == [("x", 1, "a")]
