"""License scans by canonical digests.

A text, and each of its lines, is brought to a canonical form: case, punctuation, copyright lines
and equivalent spellings no longer count. The digest of the whole form is looked up among the
digests of known license texts and notices by a hash join; nothing is matched approximately.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.license_digests import DIGESTS
from labelloom.llm.license_texts import WHOLE

# Spellings that license guidelines treat as equal, longer words first.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("licenced", "licensed"),
    ("licence", "license"), ("favour", "favor"), ("honour", "honor"), ("whilst", "while"),
)

# Notices and short license texts in their published wording.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
             "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
             "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
             "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
             "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Fair", "Usage of the works is permitted provided that this instrument is retained with the works, so that any "
             "entity that uses the works is notified of this instrument.\nDISCLAIMER: THE WORKS ARE WITHOUT WARRANTY."),
    ("FSFAP", "Copying and distribution of this file, with or without modification, are permitted in any medium "
              "without royalty provided the copyright notice and this notice are preserved. This file is offered "
              "as-is, without any warranty."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?im)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"
# A line without one of these letter runs cannot be a known notice; known entries are checked against it.
NOTICE_SIGN = r"(?i)(licen[sc]|permitted|permission|warrant)"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null gives ''."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")
    out = F.btrim(F.regexp_replace(F.translate(out, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def known_digests(
    docs: DataFrame, known: Sequence[tuple[str, str]] = (*KNOWN, *WHOLE), digests: Sequence[tuple[str, str]] = DIGESTS,
) -> DataFrame:
    """(digest, license) of known texts and digests, one row per digest; as many rows as the catalog at most."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(list(known), "license string, body string")
    made = rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license")
    given = spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license")
    return made.unionByName(given).groupBy("digest").agg(F.min("license").alias("license"))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", known: Sequence[tuple[str, str]] = (*KNOWN, *WHOLE),
    digests: Sequence[tuple[str, str]] = DIGESTS,
) -> DataFrame:
    """One row per input row: key, digest of the canonical text, its license (or null) and license notices.

    ``license`` is set when the entire text is a known one; ``n_notices`` counts lines that are known
    notices and ``notices`` lists their different licenses, sorted. A text or line that is empty once
    canonical matches nothing. Null reads as empty; repeated rows and rows without a key each give a
    row; other columns are ignored; a very long text is taken whole. The catalog is a list in this program
    and is broadcast; a notice of one line has to hold what ``NOTICE_SIGN`` looks for.
    """
    unseen = [body for _, body in known if "\n" not in body and not re.search(NOTICE_SIGN, body)]
    if unseen:
        raise ValueError(f"notices without a sign of one: {unseen}")
    found = known_digests(docs, known, digests)
    pairs = [F.lit(x) for r in found.collect() for x in (r["digest"], r["license"])]
    catalog = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    whole = F.sha2(canonical(F.col(f"`{text}`")), 256)
    lines = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"), lambda x: x.rlike(NOTICE_SIGN))
    notices = F.transform(lines, lambda x: F.element_at(catalog, F.sha2(canonical(x), 256)))
    out = docs.select(
        F.col(key), whole.alias("digest"), F.filter(notices, lambda x: x.isNotNull()).alias("hits"),
    ).join(F.broadcast(found), "digest", "left")
    return out.select(
        key, "digest", "license", F.size("hits").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))


def oracle(known: Sequence[tuple[str, str]] = (*KNOWN, *WHOLE), digests: Sequence[tuple[str, str]] = DIGESTS) -> str:
    """SQL counterpart over ``documents``, with the same catalog."""

    def form(x: str) -> str:
        out = f"regexp_replace(coalesce({x}, ''), '{COPYRIGHT_LINE}', '', 'g')"
        out = f"regexp_replace(translate({out}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"
        out = f"trim({out})"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{old}', '{new}')"
        return out

    rows = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in known)
    given = ", ".join(f"('{n}', '{d}')" for n, d in digests)
    return f"""
WITH k AS (
  SELECT digest, min(license) AS license
  FROM (SELECT license, sha256({form('body')}) AS digest FROM (VALUES {rows}) AS x(license, body)
        UNION ALL SELECT * FROM (VALUES {given}) AS y(license, digest)) GROUP BY digest
), l AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line
                       FROM (SELECT row_number() OVER () AS r, text FROM documents))
  WHERE regexp_matches(line, '{NOTICE_SIGN}')
), n AS (
  SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT r, sha256({form('line')}) AS digest FROM l) JOIN k USING (digest) GROUP BY r
), d AS (SELECT row_number() OVER () AS r, doc_id, sha256({form('text')}) AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (r)
"""
