"""The pipeline's stages, each on its own input, against plain versions."""

import random

import brute
import pytest
from test_operators import VOCABULARY

import __spark_entry__ as driver
import corpus_pipeline as pipeline
from labelloom.llm import set_dedup


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(docs)],
                          "doc_id long, text string, chunk string, n_chars long").write.parquet(f"{path}/documents.parquet")
    passage = next(t for i, t in docs if i == 3003)
    spark.createDataFrame([(1, " ".join(passage.split()[22:40])), (2, None)],
                          "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert "pipeline" in driver.queries()


def test_each_stage(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = df.columns, [df.count()]
    for name, stage in pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in df.collect()]
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        after = df.collect()
        counts.append(len(after))
        if name != "bpe":
            assert df.columns == columns
        if name == "quality_rules":
            failed = [x[0] for x in brute.quality(before) if x[-1]]
            assert not {r["doc_id"] for r in after} & {i for i in failed if i is not None and failed.count(i) == 1}
            assert {5004, 1000} <= {r["doc_id"] for r in after}
        elif name == "line_dedup":
            expected = [(i, t) for i, _, gone, t in brute.lines(before) if not gone or brute.words(t)]
            assert sorted(((r["doc_id"], r["text"]) for r in after), key=repr) == sorted(expected, key=repr)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_dedup":
            expected = {c for i, c in brute.jaccard(before) if i is not None}
            assert {r["doc_id"] for r in after} - {None} == expected
            assert len(after) == len(expected) + sum(i is None for i, _ in before)
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            expected = [i for i, _, hit, _ in brute.contaminated(before, items) if not hit]
            assert sorted((r["doc_id"] for r in after), key=repr) == sorted(expected, key=repr)
            assert len(after) < len(before)
        else:
            library = Tokenizer.from_file(VOCABULARY)
            expected = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in before), key=repr)
            assert sorted(((r["doc_id"], r["ids"]) for r in after), key=repr) == expected
            assert all(r["round_trip"] for r in after)
    assert counts == sorted(counts, reverse=True)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_finds_every_pair_of_similarity(spark):
    rng = random.Random(11)
    found, number = [], 0
    for length in (3, 12, 60, 60, 60, 200, 900):
        base = [f"{length}w{rng.randint(0, 9999)}" for _ in range(length)]
        passage = [f"common{k}" for k in range(30)] if length == 60 else []
        for share in (0, 0, 0.01, 0.01, 0.02, 0.02, 0.03, 0.05):
            changed = [f"x{rng.randint(0, 9999)}" if rng.random() < share else w for w in base]
            number += 7
            found.append((None if number % 11 == 0 else number % 200, " ".join(changed + passage)))
    found += [(500, None), (501, ""), (502, " \n")]
    expected = brute.jaccard(found)
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in set_dedup.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, df, "").collect()}
    assert kept - {None} == {c for i, c in expected if i is not None and i == c}


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_near_dedup_of_texts_with_one_frequent_shingle(spark, rounds, monkeypatch):
    """Different texts that share a passage, near copies of one of them, a very long text and names of its own columns."""
    monkeypatch.setattr(set_dedup, "SAMPLE", 1)
    rng = random.Random(12)
    passage = [f"often{k}" for k in range(20)]

    def text(n):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]

    found = [(n, " ".join([*passage, *text(rng.randint(1, 6))])) for n in range(120)]
    whole = [*text(60), *passage, *text(60)]
    found += [(200 + n, " ".join(w if rng.random() > 0.01 * (n % 4) else f"x{rng.randint(0, 10**6)}" for w in whole)) for n in range(60)]
    long = text(40_000)
    found += [(300, " ".join(long)), (301, " ".join(long[:39_000])), (302, " ".join(long[:30_000])), (None, " ".join(long[10:]))]
    df = spark.createDataFrame([(i, t, 1, "n", [1]) for i, t in found], "fp long, text string, n int, token string, tokens array<int>")
    got = [tuple(r) for r in set_dedup.near_duplicates(df.repartition(3), "fp", rounds=rounds).collect()]
    expected = brute.jaccard(found)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert len({c for _, c in expected}) < 150


def test_near_dedup_sends_small_batches(spark):
    """What a worker holds does not follow how many rows a partition has, and the session's own setting comes back."""
    import pyarrow as pa

    def sizes(batch, raw):
        held = [len(raw.buffers()[2]), sum(map(len, raw.to_pylist()))]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=["batch", "slice"])

    set_dedup.ship(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 256) AS text").coalesce(1)
    files = set_dedup.Files(spark)
    found = files.store(set_dedup._mapped(docs, "text", sizes, "batch long, slice long", []), "sizes").collect()
    assert sum(r["slice"] for r in found) == docs.selectExpr("sum(octet_length(text))").first()[0] > 12 << 20
    assert max(r["batch"] for r in found) < 5 << 20 and max(r["slice"] for r in found) <= 1 << 19
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_near_dedup_workers_give_back_what_earlier_tasks_held(spark):
    import pyarrow as pa

    def fill(batches):
        for batch in batches:
            held = [pa.array([bytes(1 << 16)] * 16) for _ in range(128)]
            del held
            yield batch

    def private(batch, raw):
        lines = open("/proc/self/smaps_rollup").read().split("\n")
        return pa.RecordBatch.from_arrays([pa.array([sum(int(x.split()[1]) for x in lines if x.startswith("Private_Dirty"))])], names=["kb"])

    set_dedup.ship(spark)
    spark.range(0, 64, 1, 8).mapInArrow(fill, "id long").collect()
    docs = spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", "'a b c' AS text")
    found = set_dedup._mapped(docs, "text", private, "kb long", []).collect()
    assert len(found) == 8 and max(r["kb"] for r in found) < 100_000


def test_bounds_never_drop_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        assert set_dedup.common_bound(set_dedup.sketch(x), len(x), set_dedup.sketch(y), len(y)) >= common


def test_near_dedup_takes_simhash_candidates(spark, monkeypatch):
    """Fingerprints of the stage's shingles are compared, and what the sets confirm is linked before the prefix join."""
    rng = random.Random(13)
    words = [f"w{n}" for n in range(400)]
    near = [" ".join(w if k != at else f"x{at}" for k, w in enumerate(words)) for at in (5, 200)]
    found = [(1, " ".join(words)), (2, near[0]), (3, near[1]), (4, " ".join(rng.sample(words, 400)))]
    asked, linked = [], []
    link, check = set_dedup.simhash.link_fingerprints, set_dedup._similar

    def compared(distinct, radius):
        asked.append(sorted(r["fp"] for r in distinct.collect()))
        return link(distinct, radius)

    def confirmed(*args):
        out = check(*args)
        linked.append(out.count())
        return out

    monkeypatch.setattr(set_dedup.simhash, "link_fingerprints", compared)
    monkeypatch.setattr(set_dedup, "_similar", confirmed)
    df = spark.createDataFrame(found, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, df, "").collect())
    assert kept == [1, 4]
    prints = [r["fp"] for r in set_dedup.simhash.fingerprints(df, out="fp", shingle=set_dedup.SHINGLE).collect()]
    assert asked == [sorted(set(prints))]
    differ = [bin((prints[0] ^ p) & (2**64 - 1)).count("1") for p in prints]
    assert linked[0] == sum(0 <= d <= set_dedup.simhash.RADIUS for d in differ[1:3]) > 0
