"""Cross-tokenizer alignment against a plain version."""

import random

import brute
import numpy as np
from test_operators import plain, rows

from labelloom.llm import alignment
from labelloom.llm.vocabularies import vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts():
    rng = random.Random(4)
    bits = ["the ", "house", " ", "  ", "\n", "\t", "日本語", "é", "ß", "😀", "<s>", "<|endoftext|>", "<0x0A>", "123", "'re", "▁",
            "\x00", " ", "x" * 40, "ﬁ", "é", ". ", "א"]
    return [(20_000 + n, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))) for n in range(200)]


def test_every_row(spark, frame, docs, nothing):
    more = odd_texts()
    df = frame.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    expected = plain(brute.alignment([*docs, *more], *PATHS))
    assert any(x[1] == 0 for x in expected[:-1]) and any(x[3] < min(x[1:3]) for x in expected)
    assert rows(alignment.agreement(df, *PATHS), *COLUMNS) == expected
    assert alignment.agreement(nothing, *PATHS).collect() == []


def test_slices_of_pairs_give_the_same_sums(frame, docs):
    got = alignment.agreement(frame, *PATHS, slice_pairs=3000)
    assert rows(got, *COLUMNS) == plain(brute.alignment(docs, *PATHS))


def test_groups_and_other_columns(frame):
    got = alignment.align(frame.withColumnRenamed("chunk", "a_ids"), *PATHS)
    assert set(got.columns) == {"doc_id", "text", "lang", "n_words", "n_chars", *alignment.RESULTS}
    for r in got.filter("size(a_ids) > 0").limit(30).collect():
        assert len(r["a_ends"]) == len(r["b_ends"]) and r["a_ends"][-1] == len(r["a_ids"]) and r["b_ends"][-1] == len(r["b_ids"])


def test_shared_cuts():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.3, 0.9):
        a, b = (np.flatnonzero(rng.random(3000) < share) for _ in range(2))
        a, b = (np.unique(np.append(x, 3000)) for x in (a, b))
        edge = np.sort(rng.integers(0, len(a), 5))
        low, high = np.array([0, *edge]), np.array([*edge, len(a)])
        assert alignment.shared_cuts(a, b, low, high).tolist() == np.flatnonzero(np.isin(a, b)).tolist()
