"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one text and votes good (1), bad (-1) or abstains (0). Documents are folded to
their distinct vote patterns before any iteration, so fitting works on at most 3^rules rows however
long the table is. The posterior probability of good quality decides, in place of a conjunction in
which one weak rule could reject a document.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import let
from labelloom.functions.sizing import bounded_rows
from labelloom.session import durable_dir, work_path

SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")
SYMBOLS = tuple("#*$%&|<>")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_stop_words", "ends_sentence")

# Frequent short words of the four languages; two different ones mark running text.
STOP_WORDS = ("the", "and", "of", "to", "in", "le", "la", "les", "de", "et", "der", "die", "und", "ein", "mit", "el",
              "los", "que", "con", "por")


def _without(text: Column, chars: tuple[str, ...]) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(grams: Column) -> Column:
    """Positions covered by windows of three whose hash occurs twice, from the hashes in text order."""

    def covered(positions: Column) -> Column:
        return F.aggregate(
            F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, x: a + x,
        )

    def repeated(ordered: Column) -> Column:
        return F.transform(
            F.filter(
                F.transform(ordered, lambda e, i: F.struct(
                    e["at"].alias("at"),
                    F.coalesce(F.get(ordered, i - 1)["gram"] == e["gram"], F.lit(False)).alias("before"),
                    F.coalesce(F.get(ordered, i + 1)["gram"] == e["gram"], F.lit(False)).alias("after"),
                )),
                lambda e: e["before"] | e["after"],
            ),
            lambda e: e["at"],
        )

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))))
    return let(ordered, lambda o: let(F.sort_array(repeated(o)), covered))


def with_features(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """Add the rules' measures as columns ``prefix`` + name; null text counts as no words."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(t, F.lit("".join(SPACES)))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def measure(w: Column) -> Column:
        grams = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
                _repeat_words(g))).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(F.transform(F.array_distinct(w), F.lower), F.array(*map(F.lit, STOP_WORDS))))
            .cast("long").alias("n_stop_words"),
        )

    per_text = F.struct(
        let(words, measure).alias("w"),
        F.length(_without(t, SPACES)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
        F.substring(trimmed, -3, 3).rlike("[.!?\"')]").cast("long").alias("ends_sentence"),
    )
    m = f"{prefix}measured"
    of = {"n_words": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    out = docs.withColumn(m, per_text)
    names = [*FEATURES, *EXTRA]
    return out.withColumns({
        f"{prefix}{n}": F.col(m)[of[n]][n] if n in of else F.col(m)[n] for n in names
    }).drop(m)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(prefix: str = "q_") -> dict[str, Column]:
    """The rules, by name; each is a column of -1, 0 or 1 on the measures."""
    c = {n: F.col(prefix + n) for n in (*FEATURES, *EXTRA)}
    per_word = F.try_divide(c["word_chars"], c["n_words"])
    symbols = F.coalesce(F.try_divide(c["n_symbols"], c["n_words"]), F.lit(0.0))
    per_char = F.coalesce(F.try_divide(c["n_symbols"], c["word_chars"]), F.lit(0.0))
    dup_lines = F.coalesce(F.try_divide(c["n_dup_lines"], c["n_lines"]), F.lit(0.0))
    repeats = F.coalesce(F.try_divide(c["n_repeat_words"], c["n_words"]), F.lit(0.0))
    return {
        "length": _vote(c["n_words"] >= 50, c["n_words"] < 20),
        "word_length": _vote(per_word.between(3, 10), F.coalesce(~per_word.between(2, 15), F.lit(True))),
        "symbols": _vote(symbols <= 0.1, symbols > 0.3),
        "markup": _vote(per_char <= 0.02, per_char > 0.05),
        "lines": _vote(dup_lines <= 0.1, (dup_lines > 0.5) & (c["n_dup_lines"] >= 3)),
        "repeats": _vote(repeats <= 0.2, repeats > 0.5),
        "stop_words": _vote(c["n_stop_words"] >= 2, (c["n_stop_words"] == 0) & (c["n_words"] >= 20)),
        "sentence": _vote(c["ends_sentence"] == 1, F.lit(False)),
    }


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents; per rule, how often its votes are right on good and on bad documents."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def posterior(self, columns: dict[str, Column]) -> Column:
        """Probability of good quality given vote columns by rule name; an abstention says nothing."""
        weight = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, a in self.on_good.items():
            b = self.on_bad[name]
            weight = weight + F.when(columns[name] == 1, F.lit(math.log(a / (1 - b)))).when(
                columns[name] == -1, F.lit(math.log((1 - a) / b))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-weight))


def fit_votes(voted: DataFrame, rules: list[str], passes: int = 100, least: float = 0.001) -> VoteModel:
    """Expectation-maximisation over the vote columns of all rows.

    Each rule has an accuracy on good and one on bad documents, kept ``least`` away from certainty
    and jointly above chance, so no rule can turn round; the share of good documents is kept between
    0.05 and 0.95, so that a table of one kind does not silence all rules. One aggregation folds all rows to their
    vote patterns, 3 ** len(rules) at most; the passes run over those counts. An empty table gives
    the start values.
    """
    counts = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n"))
    patterns = [(row["n"], [row[r] for r in rules]) for row in bounded_rows(counts, 3 ** len(rules), "vote patterns")]
    total = sum(n for n, _ in patterns)
    prior, on_good, on_bad = 0.85, [0.95] * len(rules), [0.5] * len(rules)
    for _ in range(passes if total else 0):
        odds = [_odds(prior, on_good, on_bad, v) for _, v in patterns]
        good = [n * math.exp(min(o, 0)) / (1 + math.exp(-abs(o))) for (n, _), o in zip(patterns, odds, strict=True)]
        before, prior = prior, min(max(sum(good) / total, 0.05), 0.95)
        for j in range(len(rules)):
            cast = [(n, g, v[j]) for (n, v), g in zip(patterns, good, strict=True) if v[j]]
            # One vote of each kind is added, so an unseen one is rare, not impossible.
            right = (sum(g for _, g, x in cast if x > 0) + 1) / (sum(g for _, g, _ in cast) + 2)
            caught = (sum(n - g for n, g, x in cast if x < 0) + 1) / (sum(n - g for n, g, _ in cast) + 2)
            on_good[j] = min(right, 1 - least)
            on_bad[j] = min(max(caught, 1 - on_good[j] + least), 1 - least)
        if abs(prior - before) < 1e-9:
            break
    return VoteModel(prior, dict(zip(rules, on_good, strict=True)), dict(zip(rules, on_bad, strict=True)))


def _odds(prior: float, on_good: list[float], on_bad: list[float], pattern: list[int]) -> float:
    """Log odds of good quality for one vote pattern."""
    odds = math.log(prior / (1 - prior))
    for a, b, x in zip(on_good, on_bad, pattern, strict=True):
        if x:
            odds += math.log(a / (1 - b)) if x > 0 else math.log((1 - a) / b)
    return odds


def _verdict(measured: DataFrame, threshold: float, prefix: str) -> DataFrame:
    """Verdict columns next to written measures; the fit and the verdict read the same table."""
    rules = votes(prefix)
    model = fit_votes(measured.select(*[c.alias(n) for n, c in rules.items()]), list(rules))
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (words < 50) | (100 * repeats > 50 * words)
    return measured.withColumns({
        f"{prefix}base_failed": failed, f"{prefix}posterior": model.posterior(rules),
    }).withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= threshold))


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    durable_dir(spark)
    path = work_path(spark, "quality")
    df.write.parquet(path)
    return spark.read.parquet(path)


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, prefix: str = "q_") -> DataFrame:
    """Add measures, ``q_base_failed``, ``q_posterior`` and ``q_kept`` to every row.

    The rows are written to the shared folder with their measures once. Null and empty texts have no
    words, fail the base rule and are not kept; a very long text is measured like any other. Repeated
    rows count as often as they occur. Columns named like the results are replaced, others stay.
    """
    made = {f"{prefix}{n}" for n in (*FEATURES, *EXTRA, "measured", "base_failed", "posterior", "kept")}
    return _verdict(_written(with_features(docs.drop(*(made & set(docs.columns))), text, prefix)), threshold, prefix)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One verdict per row: key, measures, base_failed, kept, posterior. Texts are not written."""
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    judged = _verdict(_written(with_features(plain).drop("text")), 0.5, "q_")
    return judged.select(F.col("key").alias(key), *[F.col(f"q_{n}").alias(n) for n in (*FEATURES, "base_failed", "kept", "posterior")])
