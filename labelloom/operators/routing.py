"""Routing policies on top of a selection, as array expressions: one decision per row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import ratio, str_array

@dataclass(frozen=True)
class Policy:
    """What must, may not, or follows. ``dependencies`` is ordered; each rule is applied once."""

    mandatory: tuple[str, ...] = ()
    banned: tuple[str, ...] = ()
    dependencies: tuple[tuple[str, tuple[str, ...]], ...] = ()
    fallback: str = "select_all"
    default_tools: tuple[str, ...] = ()
    respect_ban: bool = False


def route(df: DataFrame, labels: Sequence[str], policy: Policy, selected: Column, known: Column | None = None) -> DataFrame:
    """Adds execute, skip and policy_overrides.

    Order: dependencies in declared order and once, mandatory, banned, then the minimum guarantee.
    ``known`` limits what rules may add; by default the catalog.
    """
    catalog = str_array(labels)
    known = catalog if known is None else known
    start = F.struct(
        F.array_distinct(selected).alias("sel"), F.array().cast("array<string>").alias("log"), known.alias("known")
    )
    pairs = [(a, b) for a, deps in policy.dependencies for b in deps]
    with_known = "struct<sel:array<string>,log:array<string>,known:array<string>>"

    def keep_known(s: Column, sel: Column, message: Column) -> Column:
        return F.struct(
            sel.alias("sel"), F.concat(s["log"], F.array(message)).alias("log"), s["known"].alias("known")
        ).cast(with_known)

    state = start.cast(with_known)
    if pairs:
        rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
        state = F.aggregate(
            rules,
            state,
            lambda s, r: F.when(
                F.array_contains(s["sel"], r["a"])
                & ~F.array_contains(s["sel"], r["b"])
                & F.array_contains(s["known"], r["b"]),
                keep_known(
                    s,
                    F.concat(s["sel"], F.array(r["b"])),
                    F.concat(F.lit("DEPENDENCY: "), r["b"], F.lit(" added because "), r["a"], F.lit(" selected")),
                ),
            ).otherwise(s),
        )
    # The wording of the notes (DEPENDENCY, MANDATORY, BANNED, MINIMUM).
    if policy.mandatory:
        state = F.aggregate(
            str_array(sorted(set(policy.mandatory))),
            state,
            lambda s, m: F.when(
                F.array_contains(s["known"], m) & ~F.array_contains(s["sel"], m),
                keep_known(s, F.concat(s["sel"], F.array(m)), F.concat(F.lit("MANDATORY: "), m, F.lit(" force-selected"))),
            ).otherwise(s),
        )
    if policy.banned:
        state = F.aggregate(
            str_array(sorted(set(policy.banned))),
            state,
            lambda s, b: F.when(
                F.array_contains(s["sel"], b),
                keep_known(s, F.array_remove(s["sel"], b), F.concat(F.lit("BANNED: "), b, F.lit(" force-rejected"))),
            ).otherwise(s),
        )

    def minimum(s: Column) -> Column:
        if policy.fallback == "select_all":
            all_known = F.array_except(s["known"], str_array(policy.banned)) if policy.respect_ban else s["known"]
            note = F.lit("MINIMUM: no tools selected — selected all as fallback")
            filled = keep_known(s, all_known, note)
        elif policy.fallback == "select_default_tools":
            chosen = F.array_intersect(str_array(policy.default_tools), s["known"])
            if policy.respect_ban:
                chosen = F.array_except(chosen, str_array(policy.banned))
            filled = keep_known(
                s, chosen, F.concat(F.lit("MINIMUM: selected defaults="), F.array_join(F.array_sort(chosen), ", "))
            )
        else:
            return s
        return F.when(F.size(s["sel"]) == 0, filled).otherwise(s)

    # The catalog is split against the state held in a lambda variable, so the fold runs once.
    decided = F.get(
        F.transform(
            F.transform(F.array(state), minimum),
            lambda s: F.struct(
                F.array_intersect(catalog, s["sel"]).alias("execute"),
                F.array_except(catalog, s["sel"]).alias("skip"),
                s["log"].alias("policy_overrides"),
            ),
        ),
        F.lit(0),
    )
    return df.withColumn("_d", decided).select(*df.columns, "_d.*")


def known_from_request(selected: Column, rejected: Column) -> Column:
    """Labels a request mentions, selected or rejected."""
    return F.array_union(selected, rejected)


def reduction() -> Column:
    """Share of the catalog that is not executed."""
    executed = F.size("execute").cast("double")
    total = executed + F.size("skip")
    return F.coalesce(F.lit(1.0) - ratio(executed, total, None), F.lit(0.0))


def decision_record(selected: Column) -> Column:
    """Decision as one struct; model fields are taken from the row."""
    return F.struct(
        "execute", "skip", "policy_overrides", selected.alias("ml_selected"),
        "request_id", "model_version", "algorithm", "fallback_used",
    )


def summary_text() -> Column:
    """Multi-line summary of a decision."""

    def listed(column: str) -> Column:
        quoted = F.transform(F.col(column), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    def counted(column: str) -> Column:
        return F.size(column).cast("string")

    overrides = F.when(F.size("policy_overrides") > 0, F.concat(F.lit("POLICY OVERRIDES: "), listed("policy_overrides")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("EXECUTE ("), counted("execute"), F.lit("): "), listed("execute")),
        F.concat(F.lit("SKIP    ("), counted("skip"), F.lit("):    "), listed("skip")),
        overrides,
        F.format_string("TOOL REDUCTION: %.1f%%", reduction() * 100.0),
    )
