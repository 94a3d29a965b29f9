"""URL filter: a weighted vocabulary found by Aho-Corasick, and host and path rules.

The vocabulary has strict terms, of which one rejects a url, and soft terms, of which several
different ones do. A term counts where it is bounded by characters that are neither ASCII letters
nor digits, or by the ends of the url. Rules of (host, path prefix) override the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.sizing import bounded_rows
from labelloom.llm.shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)

#: Terms a vocabulary table may have: an automaton of some hundred megabytes in every worker.
MAX_TERMS = 1_000_000

STRICT = ("spam-farm", "cheap-pills", "porn", "xxx", "viagra", "casino", "warez", "malware", "phishing", "escort")
SOFT = ("adult", "bet", "betting", "bonus", "buy", "cheap", "cracked", "dating", "download", "free", "gambling", "hot",
        "jackpot", "keygen", "loan", "nude", "pharmacy", "pills", "poker", "prize", "sex", "slots", "torrent", "win")


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case; ``limit`` different soft ones reject."""

    strict: Sequence[str] = STRICT
    soft: Sequence[str] = SOFT
    limit: int = 2

    @classmethod
    def of_table(cls, terms: DataFrame, limit: int = 2, bound: int = MAX_TERMS) -> Vocabulary:
        """Terms from a table (term, weight): a weight of ``limit`` or more makes one strict, a lower positive one soft.

        Case does not matter; null and empty terms and weights of zero or less are left out, the highest weight
        of a repeated term counts.
        """
        lowered = F.translate("term", UPPER, LOWER).alias("term")
        held = terms.select(lowered, "weight").filter((F.col("term") != "") & (F.col("weight") > 0))
        rows = bounded_rows(held.groupBy("term").agg(F.max("weight").alias("weight")), bound, "url terms")
        strict, soft = (sorted(r["term"] for r in rows if (r["weight"] >= limit) == hard) for hard in (True, False))
        return cls(tuple(strict), tuple(soft), limit)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term in self.soft:
            found.add_word(term, (len(term), term, False))
        for term in self.strict:
            found.add_word(term, (len(term), term, True))
        found.make_automaton()
        return found


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with its subdomains and a path prefix, written ``host`` + ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, null when none does; of equally long ones the first by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def count_terms(url: str | None, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """(different strict terms, different soft terms) bounded in the lower-cased url."""
    if not url or not len(automaton):
        return 0, 0
    text = url.translate(TO_LOWER)
    strict, soft = set(), set()
    for end, (size, term, hard) in automaton.iter(text):
        before, after = text[end - size:end - size + 1] if end >= size else "", text[end + 1:end + 2]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            (strict if hard else soft).add(term)
    return len(strict), len(soft)


def judge_urls(
    pages: DataFrame, url: str = "url", vocabulary: Vocabulary | None = None, rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Add host, path, n_strict, n_soft, rule and verdict (allow or block) to every row.

    A null or empty url, or one without ``://``, has an empty host and path, fits no rule, and is
    judged by its terms alone (null: none, so it is allowed); a very long one is scanned once. A term listed
    as strict and soft is strict. An empty vocabulary rejects nothing. Rows are independent; other columns pass through, those named like results are replaced.
    """
    ship(pages.sparkSession)
    vocabulary = vocabulary or Vocabulary()
    results = ("host", "path", "n_strict", "n_soft", "rule", "verdict")
    kept = [c for c in pages.columns if c == url or c not in results]
    source = pages.select(*[F.col(f"`{c}`") for c in kept])
    types = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "n_strict long", "n_soft long"])
    at = kept.index(url)
    shared = pages.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            counts = [count_terms(u, automaton) for u in batch.column(at).to_pylist()]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, "n_strict", "n_soft"])

    host, path = url_parts(F.col(f"`{url}`"))
    judged = source.mapInArrow(run, schema).withColumns({"host": host, "path": path})
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= vocabulary.limit), "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, r.verdict).otherwise(verdict)
    return judged.withColumn("verdict", verdict)


def oracle(vocabulary: Vocabulary | None = None, rules: Sequence[Rule] = RULES) -> str:
    """SQL counterpart over ``pages``."""
    vocabulary = vocabulary or Vocabulary()

    def bounded(term: str) -> str:
        plain = re.escape(term).replace("'", "''")
        return f"regexp_matches(t, '(^|[^a-z0-9]){plain}([^a-z0-9]|$)')"

    strict = " OR ".join(bounded(t) for t in vocabulary.strict)
    soft = " + ".join(f"{bounded(t)}::INT" for t in vocabulary.soft if t not in vocabulary.strict)
    rows = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    lower = f"'{UPPER}', '{LOWER}'"
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), {lower}) AS t,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, t, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (SELECT * FROM (VALUES {rows}) AS x(rule_host, rule_path, rule_verdict)),
f AS (
  SELECT h.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN {strict} OR {soft} >= {vocabulary.limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE k = 1
"""
