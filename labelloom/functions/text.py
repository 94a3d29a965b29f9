"""Text expressions: normalising, tokens, n-grams, structural flags, keyword flags, list cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.columns import let, str_array

# White space as Unicode string methods see it, and word characters (letters,
# numbers, underscore; combining marks are not word characters).
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"

# File extensions recognised at the end of a prompt.
FILE_EXTENSIONS = (
    "py", "js", "ts", "java", "cpp", "c", "cs", "go",
    "rb", "rs", "md", "json", "yaml", "yml", "toml", "txt",
)

# First words that mark an imperative or a question.
ACTION_VERBS = (
    "find", "search", "get", "show", "list", "read", "run", "execute",
    "edit", "create", "write", "update", "delete", "modify", "check",
    "view", "open", "look", "locate", "what", "how", "where", "display",
)

# Names of the structural features, in feature order.
STRUCTURAL_NAMES = (
    "struct__char_length", "struct__word_count",
    "struct__has_parentheses", "struct__has_dot_notation",
    "struct__has_underscore", "struct__has_question_mark",
    "struct__has_file_extension", "struct__starts_with_verb",
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NOT_SPACE)


def digest(text: Column) -> Column:
    """32 bytes standing for a text of any length where only equality matters; null stays null."""
    return F.unhex(F.sha2(text, 256))


def normalize(text: Column) -> Column:
    """Lower case, outer white space removed, inner runs collapsed to one blank; null gives ''."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(lowered, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams for n in [low, high], shorter first; linear in the number of tokens."""

    def of_size(w: Column, n: int) -> Column:
        joined = w
        for shift in range(1, n):
            shifted = F.slice(w, F.lit(shift + 1), F.size(w))
            joined = F.zip_with(joined, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        if n == 1:
            return joined
        return F.slice(joined, F.lit(1), F.greatest(F.size(w) - F.lit(n - 1), F.lit(0)))

    return let(tokens, lambda w: F.concat(*[of_size(w, n) for n in range(low, high + 1)]))


def char_length_score(text: Column) -> Column:
    return F.least(F.char_length(text) / F.lit(200.0), F.lit(1.0))


def word_count_score(text: Column) -> Column:
    """Words of normalised text, as a share of 30."""
    blanks = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    count = F.when(text == "", F.lit(0)).otherwise(blanks + 1)
    return F.least(count / F.lit(30.0), F.lit(1.0))


def has_parenthesis(text: Column) -> Column:
    return (text.contains("(") | text.contains(")")).cast("double")


def has_char(text: Column, char: str) -> Column:
    return text.contains(char).cast("double")


def ends_in_file_extension(text: Column) -> Column:
    return text.rlike(r"(?i)\.(" + "|".join(FILE_EXTENSIONS) + r")$").cast("double")


def starts_with_verb(text: Column) -> Column:
    first = F.lower(F.substring_index(text, " ", 1))
    return first.isin(*ACTION_VERBS).cast("double")


def structural(text: Column) -> list[Column]:
    """The eight structural features of normalised text, in the order of STRUCTURAL_NAMES."""
    return [
        char_length_score(text),
        word_count_score(text),
        has_parenthesis(text),
        has_char(text, "."),
        has_char(text, "_"),
        has_char(text, "?"),
        ends_in_file_extension(text),
        starts_with_verb(text),
    ]


def keyword_flags(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """ARRAY<BOOLEAN>, one flag per group: does the text contain any phrase of the group?

    Substring, not word, match. The phrases are one literal, so neither rows nor plan grow with
    the number of phrases.
    """
    phrases = F.array(*[str_array([k.lower() for k in kws]) for _, kws in groups])
    return let(
        F.lower(text),
        lambda t: F.transform(phrases, lambda g: F.exists(g, lambda k: F.contains(t, k))),
    )


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Theta predicate: text contains at least one phrase."""
    return let(
        F.lower(text),
        lambda t: F.exists(str_array([p.lower() for p in phrases]), lambda k: F.contains(t, k)),
    )


def parse_label_cell(cell: Column) -> Column:
    """ARRAY<STRING> from a text cell holding a JSON list, a JSON object, a quoted scalar or a comma list.

    An object gives its keys; numbers and null give an empty list.
    """

    def parsed(c: Column) -> Column:
        as_list = F.from_json(c, "array<string>")
        as_object = F.json_object_keys(c)
        as_scalar = F.when(
            c.rlike(r'^\s*"'),
            F.array(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")),
        )
        comma = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
        number = c.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$") | F.trim(c).isin(
            "true", "false", "null", "NaN", "Infinity", "-Infinity"
        )
        return (
            F.when(c.isNull() | number, str_array([]))
            .when(c.rlike(r"^\s*\["), F.coalesce(as_list, comma))
            .when(c.rlike(r"^\s*\{"), F.coalesce(as_object, comma))
            .otherwise(F.coalesce(F.filter(as_scalar, lambda x: x.isNotNull()), comma))
        )

    return let(cell, parsed)
