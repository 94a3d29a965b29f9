import pytest
from pyspark.sql import functions as F

from labelloom.operators import coverage, routing, selection
from labelloom.operators.features import FeatureSpace
from labelloom.operators.scoring import logistic_model
from labelloom.streaming import selection as stream

L = ["grep", "code", "web"]


def selected(spark, rows, thresholds=(0.5, 0.5, 0.5), **kw):
    df = spark.createDataFrame(rows, "prompt string, scores array<double>")
    return selection.select_labels(df, L, list(thresholds), **kw).collect()


def pairs(entries):
    return [(e["tool"], e["score"]) for e in entries]


def test_ranking_rounds_and_keeps_catalog_order_on_ties(spark):
    r = selected(spark, [("x", [0.70001, 0.9, 0.70002])])[0]
    assert pairs(r["selected"]) == [("code", 0.9), ("grep", 0.7), ("web", 0.7)] and r["rejected"] == []
    r = selected(spark, [("x", [0.49999, 0.5, 0.1])])[0]
    assert pairs(r["selected"]) == [("code", 0.5)] and pairs(r["rejected"]) == [("grep", 0.5), ("web", 0.1)]
    assert not r["fallback_used"] and r["reason"] is None


@pytest.mark.parametrize("prompt", [None, "", " ", "\t\n"])
def test_blank_prompts_fall_back_to_everything(spark, prompt):
    r = selected(spark, [(prompt, [0.1, 0.2, 0.3])])[0]
    assert pairs(r["selected"]) == [(l, -1.0) for l in L] and r["rejected"] == []
    assert r["fallback_used"] and r["reason"] == "empty_prompt"


@pytest.mark.parametrize("scores", [None, [0.1], [0.1, None, 0.2], [0.1, float("nan"), 0.2]])
def test_unusable_scores_fall_back(spark, scores):
    r = selected(spark, [("x", scores)])[0]
    assert r["fallback_used"] and r["reason"] == "scoring_error" and len(r["selected"]) == 3


def test_fallback_strategies(spark):
    none = selected(spark, [("", [1.0] * 3)], strategy="select_none")[0]
    assert none["selected"] == [] and len(none["rejected"]) == 3
    some = selected(spark, [("", [1.0] * 3)], strategy="select_default_tools", defaults=["web", "zzz"])[0]
    assert pairs(some["selected"]) == [("web", -1.0)] and pairs(some["rejected"]) == [("grep", -1.0), ("code", -1.0)]
    with pytest.raises(ValueError):
        selected(spark, [("", [1.0] * 3)], strategy="maybe")


def test_explanation(spark):
    df = spark.createDataFrame([("hi", [0.75, 0.2, 0.1])], "prompt string, scores array<double>")
    text = selection.select_labels(df, L, [0.3, 0.5, 0.5]).select(selection.explain("2.0", "lr", {"grep": 0.3})).first()[0]
    assert text.split("\n") == [
        "Prompt      : hi", "Model       : v2.0 (lr)", "Fallback    : False", "", "SELECTED TOOLS:",
        "  [SELECT]   " + "grep".ljust(25) + " score=0.7500  threshold=0.30", "", "REJECTED TOOLS:",
        "  [DESELECT] " + "code".ljust(25) + " score=0.2000  threshold=0.50",
        "  [DESELECT] " + "web".ljust(25) + " score=0.1000  threshold=0.50",
    ]


def test_redaction_and_request_ids(spark):
    df = spark.createDataFrame([("secret", "rid", 1), ("secret", None, 2)], "prompt string, given string, k int")
    ids = [r[0] for r in df.select(selection.request_id(F.col("given"), F.col("prompt"), F.col("k"))).collect()]
    assert ids[0] == "rid" and len(ids[1]) == 12
    assert df.select(selection.redact(F.col("prompt"), False)).first()[0] == "[6 chars]"


def route(spark, chosen, policy, known=None):
    df = spark.createDataFrame([(chosen,)], "sel array<string>")
    return routing.route(df, L, policy, F.col("sel"), known).first()


def test_plain_routing_accounts_for_every_label(spark):
    r = route(spark, ["code", "zzz"], routing.Policy())
    assert r["execute"] == ["code"] and r["skip"] == ["grep", "web"] and r["policy_overrides"] == []


def test_policies(spark):
    r = route(spark, ["grep"], routing.Policy(mandatory=("web", "nope"), banned=("code",), dependencies=(("grep", ("code",)),)))
    assert r["execute"] == ["grep", "web"]
    assert r["policy_overrides"] == [
        "DEPENDENCY: code added because grep selected", "MANDATORY: web force-selected", "BANNED: code force-rejected",
    ]
    assert route(spark, ["web"], routing.Policy(mandatory=("web",), banned=("web",)))["execute"] == L  # minimum wins
    assert route(spark, ["grep"], routing.Policy(dependencies=(("code", ("web",)),)))["execute"] == ["grep"]


@pytest.mark.parametrize(
    "rules,expected",
    [((("grep", ("code",)), ("code", ("web",))), L), ((("code", ("web",)), ("grep", ("code",))), ["grep", "code"])],
)
def test_dependencies_are_applied_once_in_order(spark, rules, expected):
    assert route(spark, ["grep"], routing.Policy(dependencies=rules))["execute"] == expected


def test_minimum_guarantee(spark):
    r = route(spark, [], routing.Policy(banned=("web",)))
    assert r["execute"] == L and r["policy_overrides"][-1].startswith("MINIMUM")
    assert route(spark, [], routing.Policy(banned=("web",), respect_ban=True))["execute"] == ["grep", "code"]
    assert route(spark, [], routing.Policy(fallback="none"))["execute"] == []
    r = route(spark, [], routing.Policy(fallback="select_default_tools", default_tools=("web", "zzz")))
    assert r["execute"] == ["web"]


def candidates(spark, table):
    rows = [(pos, f"l{pos}", need, i, t) for pos, need, texts in table for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pos bigint, label string, need bigint, attempt int, text string")


def walk(table, seen):
    seen, out = set(seen), set()
    for pos, need, texts in table:
        added = 0
        for t in texts:
            if t in seen or added >= need:
                continue
            seen.add(t)
            out.add((f"l{pos}", t))
            added += 1
    return out


def test_picking_follows_the_sequential_rule(spark):
    import random

    rng = random.Random(5)
    table = [(p, rng.randint(1, 4), rng.sample("abcdefghijklm", 8)) for p in range(12)]
    chain = [(p, 1, [f"t{p - 1}", f"t{p}"]) for p in range(6)]  # every label's choice moves the next one's
    alone = [(100 + p, 2, [f"u{p}", f"v{p}", f"w{p}"]) for p in range(5)]
    for case, existing in ((table, ["a", "m"]), (chain, []), (chain, ["t-1"]), (alone, []), (table + alone + [(200, 0, ["a", "b"])], ["u1"])):
        old = spark.createDataFrame([(e,) for e in existing], "prompt string")
        got = coverage.pick_new(candidates(spark, case), old)
        assert {(r["label"], r["text"]) for r in got.collect()} == walk(case, existing)


def test_picking_takes_as_many_jobs_for_a_long_chain(spark):
    chain = [(p, 1, [f"t{p - 1}", f"t{p}"]) for p in range(300)]
    old = spark.createDataFrame([], "prompt string")
    status, jobs = spark.sparkContext.statusTracker(), []
    for case in (chain[:6], chain):
        spark.sparkContext.setJobGroup(f"pick {len(case)}", "")
        got = {(r["label"], r["text"]) for r in coverage.pick_new(candidates(spark, case), old).collect()}
        assert got == walk(case, [])
        jobs.append(len(status.getJobIdsForGroup(f"pick {len(case)}")))
    assert abs(jobs[0] - jobs[1]) <= 3


def test_rendering(spark):
    thin = spark.createDataFrame(
        [(0, "list_stars", "List stars.", "repository_stars", 3, None), (1, "get_x", "Get the thing", "a_b", 40, ["read", "commit", "ab"])],
        "pos bigint, label string, description string, category string, need bigint, capabilities array<string>",
    )
    got = coverage.render(thin).orderBy("pos", "attempt").collect()
    first = [r["text"] for r in got if r["pos"] == 0]
    assert first == ["List stars.", "List repository stars.", "Show all repository stars.", "What repository stars exist?",
                     "Give me every repository.", "Could you list stars?", "I'd like to list stars.", "Please list stars.",
                     "Can you help me list stars?", "I need you to list stars.", "Would you list stars?",
                     "Go ahead and list stars.", "For this repo, list stars.", "Right now I need to list stars."]
    second = [r["text"] for r in got if r["pos"] == 1]
    assert second[:4] == ["Get the thing.", "Can you get the thing?", "Show me commit.", "What is commit?"]
    assert len(second) == len(set(second)) and all(t[-1] in "?." for t in second)


def test_occupied_candidates_do_not_leave_a_label_short(spark):
    thin = spark.createDataFrame(
        [(0, "list_stars", "List {noun} stars.", "repository_stars", 2)],
        "pos bigint, label string, description string, category string, need bigint")
    rendered = coverage.render(thin).orderBy("attempt").collect()
    assert all("{noun} stars" in r["text"] for r in rendered if "stars" in r["text"] and "epository stars" not in r["text"])
    old = spark.createDataFrame([(r["text"],) for r in rendered[:12]], "prompt string")
    got = coverage.pick_new(coverage.render(thin), old).collect()
    assert {r["text"] for r in got} == {r["text"] for r in rendered[12:14]} and len(got) == 2


def test_thin_labels_and_merge(spark):
    catalog = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos bigint, label string")
    counts = spark.createDataFrame([("a", 12), ("b", 9)], "label string, n bigint")
    assert {(r["label"], r["have"], r["need"]) for r in coverage.thin_labels(catalog, counts).collect()} == {("b", 9, 1), ("c", 0, 10)}
    old = spark.createDataFrame([("x", ["a"])], "prompt string, relevant_tools array<string>")
    new = spark.createDataFrame([("b", "x"), ("b", "y")], "label string, text string")
    assert {(r[0], tuple(r[1])) for r in coverage.merge_corpus(old, new).collect()} == {("x", ("a",)), ("y", ("b",))}


@pytest.mark.parametrize(
    "name,category,operation,family",
    [
        ("list_x", "c", "read", "list"), ("get_list", "repository_stars", "read", "list"), ("get_list", "c", "read", "read"),
        ("fork_x", "c", "read", "create"), ("edit_file", "c", "read", "update"), ("unstar_x", "c", "read", "delete"),
        ("star_x", "c", "read", "write"), ("search_x", "c", "read", "search"), ("x_trigger", "c", "read", "run"),
        ("issue_write", "c", "read", "write"), ("get_x", "c", "write", "write"), ("GET_x", "c", "read", "read"),
    ],
)
def test_template_family(spark, name, category, operation, family):
    got = spark.range(1).select(coverage.template_family(F.lit(name), F.lit(operation), F.lit(category))).first()[0]
    assert got == family


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    import numpy as np

    space = FeatureSpace(("find", "web"), (1.0, 1.5), (("grep", ("find",)),))
    weights = np.zeros((space.size, 3))
    weights[0, 0], weights[1, 2], weights[2, 1] = 2.0, 3.0, -1.0
    model = logistic_model(L, weights, np.array([-0.5, -0.1, -1.0]))
    policy = routing.Policy(dependencies=(("grep", ("code",)),))
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "find it"), (2, "the web"), (3, " "), (4, None)], "prompt_id bigint, prompt string")
    rows.coalesce(1).write.parquet(source)
    incoming = spark.readStream.schema(rows.schema).parquet(source)
    stream.start(incoming, space, model, policy, out, state).awaitTermination()
    spark.createDataFrame([(5, "find web")], rows.schema).coalesce(1).write.mode("append").parquet(source)
    stream.start(incoming, space, model, policy, out, state).awaitTermination()
    got = {r["prompt_id"]: (r["execute"], r["reason"]) for r in spark.read.parquet(out).collect()}
    batch = stream.decide(spark.read.parquet(source), space, model, policy)
    assert got == {r["prompt_id"]: (r["execute"], r["reason"]) for r in batch.collect()} and len(got) == 5
    assert got[1] == (["grep", "code"], None) and got[3] == (L, "empty_prompt") and "web" in got[5][0]
