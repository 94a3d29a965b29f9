"""Selecting and rejecting labels per prompt, with fallbacks, records and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.columns import double_array, let, str_array

STRATEGIES = ("select_all", "select_none", "select_default_tools")
_ENTRIES = "array<struct<tool:string,score:double>>"


def request_id(given: Column | None, prompt: Column, key: Column) -> Column:
    """The given id, else 12 hex digits derived from prompt and row key (stable across retries)."""
    derived = F.substring(F.md5(F.concat_ws("|", prompt, key.cast("string"))), 1, 12)
    return derived if given is None else F.coalesce(given, derived)


def redact(prompt: Column, show: bool) -> Column:
    """The prompt itself, or only its length."""
    return prompt if show else F.concat(F.lit("["), F.char_length(prompt).cast("string"), F.lit(" chars]"))


def _entries(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(c["tool"].alias("tool"), c["score"].alias("score")))


def _ranked(cells: Column) -> Column:
    """Best rounded score first; ties keep catalog order."""
    keyed = F.transform(
        cells,
        lambda c: F.struct(
            (-c["score"]).alias("k"), c["pos"].alias("pos"), c["tool"].alias("tool"), c["score"].alias("score")
        ),
    )
    return _entries(F.array_sort(keyed))


def _fallback(labels: Sequence[str], strategy: str, defaults: Sequence[str]) -> tuple[Column, Column]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown fallback strategy: {strategy}")
    chosen = {"select_all": set(labels), "select_none": set()}.get(strategy, set(defaults))

    def fixed(names: list[str]) -> Column:
        rows = F.transform(str_array(names), lambda n: F.struct(n.alias("tool"), F.lit(-1.0).alias("score")))
        return rows.cast(_ENTRIES)

    return fixed([l for l in labels if l in chosen]), fixed([l for l in labels if l not in chosen])


def select_labels(
    df: DataFrame,
    labels: Sequence[str],
    thresholds: Sequence[float],
    strategy: str = "select_all",
    defaults: Sequence[str] = (),
) -> DataFrame:
    """Adds selected, rejected (ranked (tool, score) arrays), fallback_used and reason.

    Narrow: every prompt is decided from its own score vector. The unrounded score is compared, the
    rounded one is reported. Prompts lose outer white space, null reads as ''. Blank prompts and rows
    without usable scores fall back.
    """
    df = df.withColumn("prompt", tx.strip(F.coalesce("prompt", F.lit(""))))
    chosen, others = _fallback(labels, strategy, defaults)
    cells = F.zip_with(
        F.transform(F.col("scores"), lambda s, i: F.struct(s.alias("s"), i.alias("pos"))),
        F.arrays_zip(str_array(labels).alias("tool"), double_array(thresholds).alias("t")),
        lambda a, b: F.struct(
            b["tool"].alias("tool"), F.round(a["s"], 4).alias("score"), a["pos"].alias("pos"), (a["s"] >= b["t"]).alias("keep")
        ),
    )
    blank = tx.is_blank(F.col("prompt"))
    unusable = (
        F.col("scores").isNull()
        | (F.size("scores") != len(labels))
        | F.exists("scores", lambda s: s.isNull() | F.isnan(s))
    )
    reason = F.when(blank, "empty_prompt").when(unusable, "scoring_error")
    parts = let(
        cells,
        lambda c: F.struct(
            _ranked(F.filter(c, lambda x: x["keep"])).alias("selected"),
            _ranked(F.filter(c, lambda x: ~x["keep"])).alias("rejected"),
        ),
    )
    staged = df.withColumn("reason", reason).withColumn("_p", F.when(F.col("reason").isNull(), parts))
    return (
        staged.withColumn("selected", F.coalesce(F.col("_p.selected").cast(_ENTRIES), chosen))
        .withColumn("rejected", F.coalesce(F.col("_p.rejected").cast(_ENTRIES), others))
        .withColumn("fallback_used", F.col("reason").isNotNull())
        .drop("_p")
    )


def result_record(version: str, algorithm: str, thresholds: dict[str, float] | Column,
                  include_prompt: bool = True) -> Column:
    """The selection as one struct with the fields of a result record."""
    if isinstance(thresholds, dict):
        thresholds = threshold_map(thresholds)
    fields = [
        F.col("request_id"),
        F.lit(version).alias("model_version"),
        F.lit(algorithm).alias("algorithm"),
        F.col("selected").alias("selected_tools"),
        F.col("rejected").alias("rejected_tools"),
        thresholds.alias("thresholds_used"),
        F.col("fallback_used"),
    ]
    if include_prompt:
        fields.append(F.col("prompt"))
    return F.struct(*fields)


def threshold_map(thresholds: dict[str, float]) -> Column:
    if not thresholds:
        return F.create_map().cast("map<string,double>")
    return F.map_from_arrays(str_array(list(thresholds)), double_array(list(thresholds.values())))


def explain(version: str, algorithm: str, thresholds: dict[str, float]) -> Column:
    """Readable text of a selection: header, then one line per selected and per rejected label."""
    cut = threshold_map(thresholds)
    # The wording and the column widths of the text.

    def lines(column: str, tag: str) -> Column:
        return F.transform(
            F.col(column),
            lambda e: F.format_string(
                f"  %-10s %-25s score=%.4f  threshold=%.2f",
                F.lit(tag),
                e["tool"],
                e["score"],
                F.coalesce(F.try_element_at(cut, e["tool"]), F.lit(0.5)),
            ),
        )

    flag = F.when(F.col("fallback_used"), "True").otherwise("False")
    head = F.array(
        F.concat(F.lit("Prompt      : "), F.coalesce("prompt", F.lit(""))),
        F.lit(f"Model       : v{version} ({algorithm})"),
        F.concat(F.lit("Fallback    : "), flag),
        F.lit(""),
        F.lit("SELECTED TOOLS:"),
    )
    return F.array_join(
        F.concat(head, lines("selected", "[SELECT]"), F.array(F.lit(""), F.lit("REJECTED TOOLS:")),
                 lines("rejected", "[DESELECT]")),
        "\n",
    )


def tools_of(column: str) -> Column:
    """Names of a ranked array."""
    return F.transform(F.col(column), lambda e: e["tool"])
