"""Personal data and revealing terms against plain versions."""

import random
import time

import brute
import pytest
from test_operators import plain, rows

from labelloom.llm import sanitise

ALPHABET = list("aZ09.@+-_% ()é\n") + ["4111 1111 1111 1111", "+1 (377) 555-0271", "a.b@c.de", "1.2.3.4", "256.1.1.1", "00.01.2.255",
                                       "4111-1111-1111-1111-", "@", "..", "+49", "0" * 16]


def base(docs):
    out = []
    for i, t in docs:
        found = brute.personal_spans(t)
        out.append((i, *[sum(k == kind for _, _, k, _ in found) for kind in sanitise.KINDS],
                    brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        expected = [(a, o, b) for a, o, _, b in brute.personal_spans(text)]
        assert sanitise.base_spans(text) == expected, text


@pytest.mark.parametrize("part", ["a", "1", "1.", "+1", "@", "a@", "a@b", "1 ", "+1(", "a.b@c.d"])
def test_time_grows_with_the_length_of_a_text(part):
    begun = time.time()
    sanitise.base_spans(part * 200_000)
    assert time.time() - begun < 10


NAMES = ("Zebedee", "Zebulon")


def planted_text(n):
    """Random words around a name and its address; the name is nowhere else."""
    rng = random.Random(n)
    a, b, c, d = ("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(4))
    return f"Mail {a} {NAMES[n % 2]} writes {b} zeb.{n % 2}@example.org {c} about {d} things"


PLANTED = [planted_text(n) for n in range(60)]


def planted(docs):
    """The odd documents and a name that never occurs far from one of two addresses; copies make no evidence."""
    rng = random.Random(9)
    found = docs + [(9000 + n, t) for n, t in enumerate(PLANTED)]
    found += [(9100 + n, f"Copied oncemore text with +1 (377) 555-02{n % 3}1 in it") for n in range(30)]
    return found + [(9200 + n, f"writes about things {rng.random()}") for n in range(200)]


@pytest.fixture(scope="module")
def texts(docs):
    return planted(docs)


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in texts], "doc_id long, text string, spans string, term double"
                                 ).repartition(3)


def test_every_row(table, texts, nothing):
    got = sanitise.digest(sanitise.find(table))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == plain(base(texts))
    assert sanitise.digest(sanitise.find(nothing)).collect() == []


def test_terms_of_the_plain_count(spark, table, texts):
    plainly, share = {}, {}
    for (_, w), (contexts, d) in brute.disclosures(texts, sanitise.REACH).items():
        plainly.setdefault(w, []).append(d)
        share[w] = max(share.get(w, 0), contexts)
    names = sorted(plainly)
    by_hash = {h: w for w in names for h in sanitise.Terms([w], [[]]).hashes.tolist()}
    told = sanitise.disclosures(table).collect()
    assert {by_hash[r["term"]] for r in told} >= {"zebulon", "writes", "about"}
    for r in told:
        assert min(abs(r["disclosure"] - d) for d in plainly[by_hash[r["term"]]]) < 1e-9
        assert sanitise.SUPPORT <= r["contexts"] <= share[by_hash[r["term"]]]
    assert "oncemore" not in {by_hash[r["term"]] for r in told}
    marked = {r["doc_id"]: r for r in sanitise.find(table).filter("exists(spans, s -> s.kind = 'term')").collect()}
    assert set(marked) == set(range(9000, 9060))
    for r in marked.values():
        terms = [s for s in r["spans"] if s["kind"] == "term"]
        assert NAMES[r["doc_id"] % 2] in {r["text"][s["start"]:s["end"]] for s in terms}
        assert not {"writes", "about", "things"} & {r["text"][s["start"]:s["end"]] for s in terms}


def test_slices_of_terms_and_sanitised_texts(spark, table):
    whole = rows(sanitise.digest(sanitise.find(table, generalise=0.5)), "doc_id", "spans")
    assert rows(sanitise.digest(sanitise.find(table, generalise=0.5, slice_terms=1)), "doc_id", "spans") == whole
    got = sanitise.sanitise(table, remove=2.0)
    assert got.columns == ["doc_id", "text", "term", "spans"]
    texts = {r["doc_id"]: r["text"] for r in got.filter("doc_id >= 9000").collect()}
    assert "zeb." not in texts[9003] and "<email>" in texts[9003] and "<name>" in texts[9003] and "Zebulon" not in texts[9003]
    assert texts[9100] == "Copied oncemore text with <phone> in it"
    gone = sanitise.sanitise(table, remove=0.0).filter("doc_id = 9003").first()["text"]
    assert "<name>" not in gone and "Zebulon" not in gone


def test_rewrite_of_overlapping_spans():
    spans = [{"kind": "card", "start": 2, "end": 8, "disclosure": None}, {"kind": "phone", "start": 5, "end": 9, "disclosure": None}]
    assert sanitise.rewrite("a 1234567 b", spans, 1) == "a <card> b"
