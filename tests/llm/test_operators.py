"""The ten operators against plain versions, on odd and on empty input."""

import os
import random

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelloom.llm import bpe, chunks, decontaminate, license_texts, licenses, line_dedup, ngram_lm, quality, secrets, simhash, substring_dedup
from labelloom.llm import trigrams, url_filter, words
from labelloom.llm.packing import pack, pack_flags, pack_sorted, shard_bounds, unpack, unpack_flags, unpack_sorted
from labelloom.llm.vocabularies import vocabulary

SMALL = {"chunk_bytes": 20_000, "shard_bytes": 30_000}
VOCABULARY = vocabulary("byte_bpe_50k.json")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plain(found):
    return sorted(found, key=repr)


def test_substring_dedup(frame, docs, nothing):
    got = substring_dedup.remove_repeats(frame, **SMALL)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == plain(brute.substring(docs))
    for r in got.filter("n_removed > 0").collect():
        assert sum(x["stop"] - x["start"] for x in r["repeats"]) == r["n_removed"]
    assert substring_dedup.digest(substring_dedup.remove_repeats(nothing)).collect() == []


@pytest.mark.parametrize("window", [2, 5, 7])
def test_substring_dedup_short_windows(frame, docs, window):
    few = [d for d in docs if d[0] is None or d[0] < 5000]
    df = frame.filter("doc_id is null or doc_id < 5000")
    got = substring_dedup.remove_repeats(df, window=window, **SMALL)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == plain(brute.substring(few, window))


def test_line_dedup(frame, docs, nothing):
    got = line_dedup.drop_lines(frame, more=("lang",), **SMALL)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept") == plain(brute.lines(docs))
    assert {r["lang"] for r in got.collect()} == {"en"}
    assert line_dedup.drop_lines(nothing).collect() == []


@pytest.fixture(scope="module")
def crowded():
    """A third of the rows without a key and a third under one, with lines and passages in common."""
    rng = random.Random(3)
    few = [" ".join(f"{rng.choice('abcdef')}{rng.randint(0, 99)}" for _ in range(60)) for _ in range(30)]
    return [([None, 7, n][n % 3], f"{rng.choice(few)}\n{rng.choice(few)}\nown words {n}") for n in range(240)]


def test_no_chunk_holds_all_rows_of_a_key(spark, crowded):
    df = spark.createDataFrame(crowded, "doc_id long, text string").repartition(3)
    layout = chunks.lay_out(df, chunk_bytes=8_000, shard_bytes=30_000)
    held = [r["n"] for r in layout.docs.groupBy("chunk").agg(F.sum(F.octet_length("raw")).alias("n")).collect()]
    assert sum(held) == sum(len(t) for _, t in crowded) and max(held) <= 3 * 8_000


def test_long_documents_are_no_large_keys(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 500) AS text")
    monkeypatch.setattr(chunks, "small_side", lambda df: pytest.fail("a list of keys was made"))
    layout = chunks.lay_out(df, chunk_bytes=8_000, shard_bytes=30_000)
    assert layout.chunks > 100 and layout.docs.filter("split").isEmpty()


def test_rows_between_chunks_and_shards_are_bounded():
    for size in (0, 1, 10**8, 10**10, 3 * 10**10, 15 * 10**10):
        made, shards = chunks.counts_of(size, chunks.CHUNK_BYTES, chunks.SHARD_BYTES)
        assert made >= 1 and shards >= 1 and made * shards <= 1.01 * chunks.MOST_ROWS
    assert chunks.counts_of(5 * 10**8, chunks.CHUNK_BYTES, chunks.SHARD_BYTES) == (60, 30)


def test_keys_dealt_to_several_chunks(spark, crowded):
    sizes = {"chunk_bytes": 8_000, "shard_bytes": 30_000}
    df = spark.createDataFrame(crowded, "doc_id long, text string").repartition(3)
    for least in (2, 3, 12):
        got = line_dedup.drop_lines(df, min_docs=least, **sizes)
        assert rows(got, "doc_id", "n_lines", "n_dropped", "kept") == plain(brute.lines(crowded, least))
    got = substring_dedup.remove_repeats(df, **sizes)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == plain(brute.substring(crowded))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    perfect = line_dedup.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys)) == list(range(len(keys)))
    assert line_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_simhash(frame, docs, nothing):
    got = simhash.digest(simhash.near_duplicates(frame, tile=16))
    assert rows(got, "doc_id", "fingerprint", "component_id") == plain(brute.simhash(docs))
    assert simhash.near_duplicates(nothing).collect() == []


def test_tiles_find_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    flips = [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(7)]
    prints = np.unique(np.concatenate(flips))
    prints = prints[np.lexsort((prints, *simhash.quarter_counts(prints).T[::-1]))]
    half = len(prints) // 2

    def classes(links):
        root = {int(p): int(p) for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(int(a))] = find(int(b))
        found = {}
        for p in root:
            found.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, found.values()))

    tiled = []
    for x, y, same in ((prints[:half],) * 2 + (True,), (prints[half:],) * 2 + (True,), (prints[:half], prints[half:], False)):
        tiled += zip(*simhash.compare_tiles(x, y, 4, same))
    exact = [(a, b) for a in prints for b in prints if int(a ^ b).bit_count() <= 4]
    assert classes(tiled) == classes(exact)


def test_long_chain_of_components(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    labels = spark.createDataFrame([(i, 1000 + (i * 37) % (n + 1)) for i in range(n + 1)], "fp long, label long")
    assert {r["component"] for r in simhash.components(links, labels).collect()} == {1000}


def test_fingerprints_sharing_a_label_stay_apart(spark):
    none = 2**63 - 1
    label = {1: none, 2: none, 3: none, 4: none, 5: 7, 6: none, 7: none, 8: 9, 9: 3, 10: 9, 11: 12}
    pairs = [(1, 2), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11)]
    links = spark.createDataFrame(pairs, "a long, b long")
    labels = spark.createDataFrame(list(label.items()), "fp long, label long")
    got = {}
    for r in simhash.components(links, labels).collect():
        got.setdefault(r["fp"], []).append(r["component"])
    assert got == {1: [none], 2: [none], 3: [none], 4: [7], 5: [7], 6: [none], 7: [none], 8: [3], 9: [3], 10: [9], 11: [9]}


def test_tile_pairs_are_those_of_near_boxes(spark):
    rng = np.random.default_rng(4)
    low = rng.integers(0, 14, (40, 4))
    box = np.hstack([low, low + rng.integers(0, 3, (40, 4))])
    boxes = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(box)], "tile long, box array<long>")
    for radius in (0, 4, 9):
        expected = {(i, j) for i in range(40) for j in range(i, 40)
                    if simhash._apart(box[i, :4], box[i, 4:], box[j, :4], box[j, 4:]) <= radius}
        assert {tuple(r) for r in simhash.near_tiles(boxes, radius).collect()} == expected


def test_labels_of_hot_keys(spark, monkeypatch):
    data = spark.range(300).selectExpr("id AS doc", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS fp")
    labels = data.select("fp").distinct().selectExpr("fp", "fp * 10 AS component")
    for share in (2, 50, 1000):
        monkeypatch.setattr(simhash, "HOT_SHARE", share)
        got = simhash.with_labels(data, labels).collect()
        assert sorted((r["doc"], r["component"]) for r in got) == [(i, 70 if i % 3 == 0 else 10 * i) for i in range(300)]


def test_simhash_of_repeated_and_missing_ids(spark):
    def near(word, n):
        text = " ".join(f"{word}{k}" for k in range(400))
        return [f"{text} end{i}" for i in range(n)]

    found = [(None, t) for t in near("a", 5) + near("b", 2)] + [(9, t) for t in near("c", 4) + near("d", 2)]
    found += [(3, near("d", 3)[2]), (7, near("b", 3)[2]), (None, near("e", 1)[0])]
    got = simhash.digest(simhash.near_duplicates(spark.createDataFrame(found, "doc_id long, text string"), tile=16))
    assert rows(got, "doc_id", "fingerprint", "component_id") == plain(brute.simhash(found))


def test_keep_one(frame, docs):
    kept = simhash.keep_one(frame).select("doc_id").collect()
    expected = {c for i, _, c in brute.simhash(docs) if i is not None}
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert ids.count(None) == sum(i is None for i, _ in docs)


ITEMS = [(1, None), (2, ""), (None, "lost item")]


def test_decontamination(spark, frame, docs, nothing):
    passage = next(t for i, t in docs if i == 3003).split()
    items = [*ITEMS, (3, " ".join(passage[30:45]).upper()), (3, " ".join(passage[30:45])), (4, docs[0][1] or "x y z"),
             (5, " ".join(passage[40:43])), (6, "not there at all but long enough to be one window"),
             (None, " ".join(docs[3][1].split()[:12]) if docs[3][1] else "lost"), (None, " ".join(passage[5:16]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminate(frame, table)
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == plain(brute.contaminated(docs, items))
    assert got.filter("contaminated != (n_hit > 0)").count() == 0
    blocks = decontaminate.contaminate(frame, table, block_words=10)
    assert rows(blocks, "doc_id", "n_words", "n_hit", "items") == plain(brute.contaminated(docs, items))
    assert decontaminate.contaminate(nothing, table).collect() == []
    none = decontaminate.contaminate(frame, table.limit(0))
    assert rows(none, "doc_id", "n_words", "n_hit", "items") == plain(brute.contaminated(docs, []))


def test_bpe(spark, frame, docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    got = bpe.encode_decode(frame, VOCABULARY)
    assert set(got.columns) == {*frame.columns, "ids", "decoded"}
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in docs]
    assert rows(got, "doc_id", "ids", "decoded") == plain(expected)
    again = bpe.decode(got.select("doc_id", "ids"), VOCABULARY)
    assert rows(again, "doc_id", "decoded") == plain([(i, t or "") for i, t in docs])
    assert bpe.encode_decode(nothing, VOCABULARY).collect() == []


def test_tree_concatenation_equals_the_library(monkeypatch):
    import random

    from tokenizers import Tokenizer

    vocabulary = open(VOCABULARY, encoding="utf-8").read()
    tree, library = bpe.TreeEncoder(vocabulary, leaf=8), Tokenizer.from_str(vocabulary)
    joins = []
    monkeypatch.setattr(tree, "_tokens", lambda ids, text, of=tree._tokens: joins.append(text) or of(ids, text))
    rng = random.Random(5)
    pieces = ["a", "the", " ", "  ", "\n", "\x1c", "!", "'re", "'s", "é", "日本", "<|endoftext|>", "<|endof", "1", "\u00a0",
              "\u2009", "\x85", "😀", "\t", "_", "א", "Ω", "x" * 9]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert tree.encode(text).tolist() == expected
        assert tree.decode(tree.encode(text)) == library.decode(expected, skip_special_tokens=False)
    for letters in ("ab", "abcdefghij", "0123456789", "éèa", "日本語", "!?.", "theinrano"):
        for _ in range(100):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(50, 400)))
            assert tree.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    # Halves did meet inside of words and special tokens, where a window decides.
    assert len(joins) > 1000 and any("<|end" in t for t in joins)


def test_language_model(frame, docs, nothing):
    got = ngram_lm.score_texts(frame, s2=20.0, s3=3.0, chunk_bytes=20_000, shard_bytes=15_000).collect()

    def place(r):
        return r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 3), round(r[6], 3)

    expected = sorted(brute.language_model(docs, 20.0, 3.0), key=place)
    for r, e in zip(sorted(map(tuple, got), key=place), expected, strict=True):
        assert r[:5] == e[:5]
        assert r[5] == pytest.approx(e[5], abs=1e-6) and r[6] == pytest.approx(e[6], abs=0.001 * r[2] + 0.01)
    assert ngram_lm.score_texts(nothing).collect() == []


def test_frequent_words_are_salted(monkeypatch, frame, docs):
    monkeypatch.setattr(ngram_lm, "SPLIT", 50)
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score_texts(frame, chunk_bytes=20_000, shard_bytes=15_000).collect()}
    for i, _, n, _, _, _, score in brute.language_model(docs, ngram_lm.STRENGTH_2, ngram_lm.STRENGTH_3):
        if i is not None:
            assert got[i] == pytest.approx(score, abs=0.001 * n + 0.01)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for count, universe in ((0, 10), (1, 1), (500, 600), (500, 10**9), (64, 2**40)):
        values = np.sort(rng.integers(0, universe, count)) if count else np.empty(0, np.int64)
        values = np.unique(values)
        coded = ngram_lm.EliasFano(len(values), universe, ngram_lm.EliasFano.encode(values, universe))
        assert coded.find(values).tolist() == list(range(len(values)))
        others = np.setdiff1d(rng.integers(0, universe, 50), values)
        assert (coded.find(others) == -1).all()


def test_quality(frame, docs, nothing):
    got = quality.quality(frame)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got, *names) == plain(brute.quality(docs))
    assert got.filter("base_failed and kept").count() == 0
    assert quality.quality(nothing).collect() == []


def test_quality_verdicts_follow_from_votes_alone(frame):
    more = frame.withColumnRenamed("chunk", "q_source").withColumn("q_kept", F.lit("mine"))
    judged = quality.judge(more).withColumns({f"vote {n}": c for n, c in quality.votes().items()})
    assert {"q_source", "lang", "n_words"} <= set(judged.columns) and judged.columns.count("q_kept") == 1
    found = judged.collect()
    plainly = brute.vote_posteriors([[r[f"vote {n}"] for n in quality.votes()] for r in found])
    for r, p in zip(found, plainly):
        assert r["q_posterior"] == pytest.approx(p, abs=1e-9)
        assert r["q_kept"] == (not r["q_base_failed"] and p >= 0.5)
    assert {r["q_kept"] for r in found} == {True, False}
    alone = rows(quality.quality(more), "doc_id", "kept")
    assert alone == plain((r["doc_id"], r["q_kept"]) for r in found)


def test_votes_find_the_bad_documents(spark):
    import random

    rng = random.Random(1)
    data = []
    for n in range(600):
        bad = n % 6 == 0
        vote = [(-1 if rng.random() < (0.9 if bad else 0.02) else 1) if rng.random() < 0.8 else 0 for _ in range(4)]
        data.append((*vote, int(not bad)))
    voted = spark.createDataFrame(data, "a int, b int, c int, d int, good int")
    model = quality.fit_votes(voted, list("abcd"))
    assert abs(model.prior - 5 / 6) < 0.05
    judged = voted.withColumn("p", model.posterior({r: F.col(r) for r in "abcd"}))
    assert judged.filter("(p >= 0.5) = (good = 1)").count() > 0.97 * len(data)


def test_secrets(frame, docs, nothing):
    got = secrets.digest(secrets.scan(frame))
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == plain(brute.secrets(docs))
    more = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert "private_key:0:31" in more[6002] and "github:32:" in more[6002]
    assert secrets.digest(secrets.scan(nothing)).collect() == []


def test_trigram_queries():
    by_kind = {r.kind: r.trigram_query() for r in secrets.RULES}
    assert by_kind["hex"] == []
    assert by_kind["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in by_kind["assign"] and len(by_kind["assign"]) == 6
    assert sorted(map(sorted, by_kind["github"])) == [sorted([f"gh{c}", f"h{c}_"]) for c in "oprsu"]
    assert by_kind["jwt"] == [frozenset({"eyj", ".ey"})]
    assert trigrams.trigram_query("ab|secret") == [] and trigrams.trigram_query("(secret)?x") == []
    assert {*trigrams.trigram_query("se(cr|r)et{2}")} == {
        frozenset({"sec", "ecr", "cre", "ret", "ett"}), frozenset({"ser", "ere", "ret", "ett"})}
    with pytest.raises(ValueError):
        trigrams.trigram_query("(ab")


def random_pattern(rng, depth=3):
    """A pattern and a function that makes strings it matches."""
    kind = rng.choice(["literal", "class", "sequence", "sequence", "choice", "repeat"] if depth else ["literal", "class"])
    if kind == "literal":
        text = "".join(rng.choice("abcXYZ._- é") for _ in range(rng.randint(1, 5)))
        return "".join(c if c.isalnum() or c == "_" else f"\\x{ord(c):02x}" if rng.random() < 0.5 else "\\" + c for c in text), lambda: text
    if kind == "class":
        chars = rng.choice(["ab", "a-c", "A-Z0-9", "x_.", "^a", "a-"])
        members = {"ab": "ab", "a-c": "abc", "A-Z0-9": "AQZ059", "x_.": "x_.", "^a": "bcZ. ", "a-": "a-"}[chars]
        return f"[{chars}]", lambda: rng.choice(members)
    if kind == "repeat":
        inner, make = random_pattern(rng, depth - 1)
        mark, low, high = rng.choice([("*", 0, 3), ("+", 1, 3), ("?", 0, 1), ("{2}", 2, 2), ("{1,3}", 1, 3), ("{6,}", 6, 8), ("{0,2}", 0, 2)])
        return f"(?:{inner}){mark}", lambda: "".join(make() for _ in range(rng.randint(low, high)))
    parts = [random_pattern(rng, depth - 1) for _ in range(rng.randint(1, 4))]
    if kind == "choice":
        return "(" + "|".join(p for p, _ in parts) + ")", lambda: rng.choice(parts)[1]()
    return "".join(p for p, _ in parts), lambda: "".join(m() for _, m in parts)


def test_every_match_holds_a_derived_alternative():
    import re

    rng, told = random.Random(8), 0
    for _ in range(3000):
        pattern, make = random_pattern(rng)
        query = trigrams.trigram_query(pattern)
        told += bool(query)
        for _ in range(5):
            text = make()
            assert re.fullmatch(pattern, text)
            assert not query or any(all(t in text.lower() for t in a) for a in query), (pattern, text, query)
    assert told > 800


def test_many_matches_and_wide_ids(spark):
    import time

    wide = 2**59
    found = [(wide * (i % 7) + i * i, f"x {i} token=abcdef{i} end" if i % 3 else f"plain {i}") for i in range(300)]
    found += [(None, "token=abcdef1"), (None, "nothing"), (5, ("0123456789abcdef" * 2 + " ") * 100_000)]
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(3)
    index = secrets.postings(df, "doc_id", "text", secrets.RULES, df.count())
    assert index.agg(F.sum(F.length("bits"))).first()[0] <= 4096 * len(secrets.trigrams(secrets.RULES))
    begun = time.time()
    got = secrets.digest(secrets.scan(df))
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == plain(brute.secrets(found))
    assert time.time() - begun < 60


def test_licenses(spark, nothing):
    texts = [(1, "RELEASED under the MIT licence"), (2, "words\n  Licensed under CC BY-NC 4.0!\nCopyright 2020 x\nwords"),
             (3, None), (4, ""), (5, "Copyright (c) 2001 Someone\nReleased under the MIT License."), (None, "nothing"),
             (1, "RELEASED under the MIT licence"), (6, "Released under the MIT License. And more.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, license string")
    got = licenses.scan(df)
    assert rows(got, "doc_id", "license", "n_notices", "notices") == plain([
        (1, "MIT", 1, "MIT"), (1, "MIT", 1, "MIT"), (2, None, 1, "CC-BY-NC-4.0"), (3, None, 0, ""), (4, None, 0, ""),
        (5, "MIT", 1, "MIT"), (None, None, 0, ""), (6, None, 0, "")])
    assert licenses.scan(nothing).collect() == []


def test_whole_licenses(spark):
    mit, isc = license_texts.MIT, license_texts.ISC
    bsd = {n: b for n, b in license_texts.WHOLE if n.startswith("BSD") and b.startswith("Redist") and ":\n\n1. " in b}
    owner = "Copyright (c) 2020 Some One\n\n"
    texts = [(1, owner + mit), (2, "MIT License\n\n" + owner + mit), (3, owner + isc), (4, "ISC License\n\n" + owner + isc),
             (5, "BSD 2-Clause License\n\n" + owner + bsd["BSD-2-Clause"]), (6, owner + bsd["BSD-3-Clause"]),
             (7, owner + license_texts.ZLIB), (8, license_texts.UNLICENSE), (9, mit.replace("free of charge", "for money")),
             (10, "\n\n".join(" ".join(p.split()) for p in isc.split("\n\n")))]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["license"] for r in got.collect()} == {
        1: "MIT", 2: "MIT", 3: "ISC", 4: "ISC", 5: "BSD-2-Clause", 6: "BSD-3-Clause", 7: "Zlib", 8: "Unlicense", 9: None,
        10: "ISC"}


PUBLISHED = "/usr/share/common-licenses"


def test_the_sql_counterpart_has_the_same_catalog(spark, nothing):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    texts = [(n, f"Copyright (c) 2021 A\n\n{body.upper()}") for n, (_, body) in enumerate([*licenses.KNOWN, *license_texts.WHOLE])]
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    found = con.execute(licenses.oracle()).fetchall()
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(got, *got.columns) == plain(found) and all(r[2] for r in found)
    with pytest.raises(ValueError):
        licenses.scan(nothing, known=[("X", "All rights reserved.")])


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="published texts are not here")
def test_digests_of_published_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
             "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    texts = []
    for number, name in enumerate(names):
        with open(f"{PUBLISHED}/{name}", encoding="utf-8") as f:
            texts.append((number, f.read()))
    whole = texts[0][1]
    texts += [(100, whole[:whole.index("   APPENDIX:")]), (101, whole.replace("License", "LICENSE").replace(",", " ,")), (102, whole[:500])]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(names.values())), 100: "Apache-2.0", 101: "Apache-2.0", 102: None}


def test_urls(spark):
    urls = [("https://A.example.net/en/x?porn", "a.example.net", "/en/x", "example.net/en/", "allow"),
            ("https://a.example.net", "a.example.net", "", None, "allow"),
            ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
            ("http://example.com/de/y#top", "example.com", "/de/y", "example.com/de/", "block"),
            ("http://x.org/fr/cheap-pills", "x.org", "/fr/cheap-pills", "org/fr/", "allow"),
            ("http://cheap-pills.example.org/en/1", "cheap-pills.example.org", "/en/1", None, "block"),
            ("http://x.org/free/download/free", "x.org", "/free/download/free", None, "block"),
            ("http://x.org/free/free", "x.org", "/free/free", None, "allow"),
            ("http://x.org/carefree/pornografia", "x.org", "/carefree/pornografia", None, "allow"),
            ("no scheme porn", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
            ("a://b://c/d?e", "b:", "//c/d", None, "allow"), ("http://" + "x" * 100_000, "x" * 100_000, "", None, "allow")]
    df = spark.createDataFrame([(n, u[0], "mine") for n, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(df)
    assert rows(got, "url", "host", "path", "rule", "verdict") == plain(urls)
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_url_terms_from_a_table(spark):
    rng = random.Random(6)
    terms = [(f"Term{n}", rng.choice([1, 1, 1, 2, 3])) for n in range(3000)] + [("c++", 2), (None, 2), ("", 2), ("off", 0), ("term1", 3)]
    found = url_filter.Vocabulary.of_table(spark.createDataFrame(terms, "term string, weight int"))
    assert len(found.strict) + len(found.soft) == 3001 and "term1" in found.strict and "c++" in found.strict
    weight = {t.lower(): w for t, w in terms if t}
    urls = [(n, "http://a.b/" + "/".join(f"term{rng.randint(0, 6000)}" for _ in range(rng.randint(0, 4)))) for n in range(400)]
    urls.append((400, "http://a.b/c++"))
    got = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), vocabulary=found)
    for r in got.collect():
        held = {t for t in r["url"].split("/")[3:] if weight.get(t, 0) > 0}
        hard = sum(t == "term1" or weight[t] >= 2 for t in held)
        assert (r["n_strict"], r["n_soft"]) == (hard, len(held) - hard)
        assert r["verdict"] == ("block" if hard or len(held) > 1 else "allow")


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all() and (unpack(pack(keys)) == keys).all()
    assert len(unpack(pack(keys[:0]))) == len(unpack_sorted(pack_sorted(keys[:0]))) == 0
    flags = keys % np.uint64(3) == 0
    assert (unpack_flags(pack_flags(flags), len(flags)) == flags).all()
    bounds = shard_bounds(keys, 7)
    assert bounds[0] == 0 and bounds[-1] == len(keys) and (np.diff(bounds) > 80).all()


def test_words_are_those_of_each_text():
    import pyarrow as pa

    texts = [b"a b", b"c", b"", None, b" d\xc3\xa9 ", b"x" * 200 + b" a"]
    data, offsets = words.buffers(pa.array(texts, pa.binary()))
    found = words.split_words(data, offsets)
    got = [data[a:b].tobytes() for a, b in zip(found.start, found.end)]
    assert got == [w for t in texts for w in (t or b"").split()]
    hashed = words.word_hashes(data, found)
    assert hashed[0] == hashed[-1] and len(set(hashed.tolist())) == len(set(got))
    assert np.diff(found.first).tolist() == [2, 1, 0, 0, 1, 2]


def test_fingerprint_hash_is_the_engines_hash(spark):
    texts = ["", "a b c d", "é" * 40]
    got = [r[0] % 2**64 for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]
