"""Measurement: the sign of a rule change, and drift through versions and rewrites.

Input is slot states only, never raw text or marker scores. Signs are counted,
never netted, and a case without a ratified sign is reported with its reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.functions.ordered import with_previous
from normtext.functions.text import sql_literal

SIGNS = ("tightening", "loosening", "neutral")
MODALITY_OFF_DUTY = "modality change off the duty has no ratified sign"
WHOLE_DUTY = "whole-duty insertion/removal has no ratified sign"


def _map(entries: dict[str, object]) -> str:
    return "map(" + ", ".join(
        f"{sql_literal(k)}, {sql_literal(v) if isinstance(v, str) else v}" for k, v in entries.items()
    ) + ")"


def looked_up(entries: dict[str, object], key: Column) -> Column:
    """A literal map read by key, NULL where the key is missing."""
    return F.try_element_at(F.expr(_map(entries)), key)


def determinacy_rung(state: Column) -> Column:
    return looked_up(fv.DETERMINACY_RUNGS, state)


def modality_rung(state: Column) -> Column:
    return looked_up(fv.MODALITY_RUNGS, state)


def ladder_move(before: Column, after: Column) -> Column:
    """weakened (down), strengthened (up) or unchanged; NULL if a rung is missing."""
    return F.when(after < before, "weakened").when(after > before, "strengthened").when(
        after == before, "unchanged"
    )


def bound_move(before: Column, after: Column) -> Column:
    """A larger numeric cap is a weaker ceiling."""
    return F.when(after > before, "weakened").when(after < before, "strengthened").when(
        after == before, "unchanged"
    )


def sign_of(kind: Column, part: Column, change: Column) -> Column:
    """The sign of one change: a lookup in the sign table, neutral if unchanged.

    ``change`` is a move, an actor scope or a presence. A bound is always the cap
    of a ceiling, whatever part is named. Cases outside the table stay NULL.
    """
    where = F.when(kind == "bound", "ceiling").otherwise(part)
    table = {f"{k}|{p}|{c}": s for k, p, c, s in fv.SIGN_TABLE}
    known = kind.isin("condition", "bound", "modality", "actor")
    return F.when(known & (change == "unchanged"), "neutral").otherwise(
        looked_up(table, F.concat_ws("|", kind, where, change))
    )


def unratified_reason(kind: Column, part: Column, change: Column) -> Column:
    return (
        F.when((kind == "modality") & (part != "duty") & (change != "unchanged"), MODALITY_OFF_DUTY)
        .when((kind == "part") & (part == "duty"), WHOLE_DUTY)
        .when(
            ~kind.isin("condition", "bound", "modality", "actor", "part"),
            F.concat(F.lit("unknown slot change kind: "), kind),
        )
    )


def classify(changes: DataFrame) -> DataFrame:
    """Adds move, sign and unratified_reason to rows of
    (kind, part, before, after, scope, presence); before/after are rung numbers."""
    move = ladder_move(F.col("before"), F.col("after"))
    kind, part = F.col("kind"), F.col("part")
    change = F.when(kind == "part", F.col("presence")).when(kind == "actor", F.col("scope")).otherwise(move)
    return changes.withColumns(
        {
            "move": F.when(kind.isin("condition", "bound", "modality"), move),
            "sign": sign_of(kind, part, change),
            "unratified_reason": unratified_reason(kind, part, change),
        }
    )


def bound_sign(before: Column, after: Column) -> Column:
    """Sign of a ceiling's numeric cap: larger loosens, smaller tightens."""
    return sign_of(F.lit("bound"), F.lit("ceiling"), bound_move(before, after))


def direction_vector(signed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per sign. There is no net column on purpose."""
    return signed.groupBy(*keys).agg(*[F.count_if(F.col("sign") == s).alias(s) for s in SIGNS])


# --- Reading bridge ----------------------------------------------------------------------------

UNRESOLVED = "reading not resolved to present/absent"
BASELINE_ABSENT = "baseline slot absent; insertion is out of scope here"


def read_change(rows: DataFrame) -> DataFrame:
    """A source slot and two readings of it -> an observable change or a reason.

    Needs kind, attaches_to, determinacy, modality (the annotated baseline),
    before_status, after_status, after_determinacy, after_modality. Adds
    observable, reason, sign and removed_part.
    """
    kind, part = F.col("kind"), F.col("attaches_to")
    before, after = F.col("before_status"), F.col("after_status")
    resolved = F.coalesce(before.isin("present", "absent") & after.isin("present", "absent"), F.lit(False))
    present = after == "present"
    ladder = kind.isin("condition", "deadline")
    graded = ladder | (kind == "bound")
    base_d, seen_d = determinacy_rung(F.col("determinacy")), determinacy_rung(F.col("after_determinacy"))
    base_m, seen_m = modality_rung(F.col("modality")), modality_rung(F.col("after_modality"))

    reason = (
        F.when(~resolved, UNRESOLVED)
        .when(before == "absent", BASELINE_ABSENT)
        .when(present & (kind == "exception"), "exception intact")
        .when(present & graded & seen_d.isNull(), "slot still present; determinacy rung not observable")
        .when(present & graded & base_d.isNull(), "no baseline determinacy annotation")
        .when(present & (kind == "modality") & seen_m.isNull(), "slot still present; modality rung not observable")
        .when(present & (kind == "modality") & base_m.isNull(), "no baseline modality annotation")
        .when(present & (kind == "modality") & (part != "duty"), "modality off the duty has no ratified sign")
        .when(present & ~graded & (kind != "modality"), "slot still present; change not observable")
        .when(~present & ladder & (F.coalesce(base_d, F.lit(0)) == 0), "no baseline determinacy annotation")
        .when(
            ~present & (kind == "modality") & (F.coalesce(base_m, F.lit(0)) == 0), "no baseline modality annotation"
        )
        .when(~present & (kind == "modality") & (part != "duty"), MODALITY_OFF_DUTY)
        .when(~present & (kind == "actor"), "actor scope is not observable as present/absent")
        .when(
            ~present & ~graded & ~kind.isin("exception", "modality"),
            F.concat(F.lit("unhandled slot kind '"), kind, F.lit("'")),
        )
        .otherwise("computed")
    )
    computed = F.col("reason") == "computed"
    removed = (
        F.when(computed & ~present & (kind == "exception"), "exception")
        .when(computed & ~present & (kind == "bound"), "ceiling")
    )
    zero = F.lit(0)
    move = F.when(kind == "modality", ladder_move(base_m, F.when(present, seen_m).otherwise(zero))).otherwise(
        ladder_move(base_d, F.when(present, seen_d).otherwise(zero))
    )
    sign = (
        F.when(F.col("reason") == "exception intact", "neutral")
        .when(F.col("removed_part").isNotNull(), sign_of(F.lit("part"), F.col("removed_part"), F.lit("removed")))
        .when(computed, sign_of(F.when(ladder, "condition").otherwise(kind), part, move))
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("removed_part", removed)
        .withColumns({"sign": sign, "observable": F.col("reason").isin("computed", "exception intact")})
    )


def subsume(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A qualifier on a removed exception or ceiling is gone by consequence: it
    becomes unobservable instead of counting a second time."""
    gone = changes.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("removed_part") == "exception"), F.lit(False)).alias("_exception"),
        F.coalesce(F.bool_or(F.col("removed_part") == "ceiling"), F.lit(False)).alias("_ceiling"),
    )
    part = F.col("attaches_to")
    dependent = ~F.col("kind").isin("exception", "bound") & (
        ((part == "exception") & F.col("_exception")) | ((part == "ceiling") & F.col("_ceiling"))
    )
    joined = changes.join(gone, list(keys)).withColumn("_dependent", dependent)
    return joined.withColumns(
        {
            "reason": F.when(
                F.col("_dependent"), F.concat(F.lit("parent "), part, F.lit(" removed; subsumed"))
            ).otherwise(F.col("reason")),
            "sign": F.when(~F.col("_dependent"), F.col("sign")),
            "observable": F.col("observable") & ~F.col("_dependent"),
        }
    ).drop("_exception", "_ceiling", "_dependent")


def measure(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vector over observable slots, and how many slots could not be read, by reason.

    Two aggregations: the first per (keys, reason), so the map is built from at
    most one entry per reason.
    """
    outcomes = subsume(read_change(slots), keys)
    by_reason = outcomes.groupBy(*keys, F.when(~F.col("observable"), F.col("reason")).alias("_reason")).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("sign") == s).alias(s) for s in SIGNS]
    )
    return by_reason.groupBy(*keys).agg(
        *[F.sum(s).alias(s) for s in SIGNS],
        F.coalesce(F.sum(F.when(F.col("_reason").isNotNull(), F.col("_n"))), F.lit(0)).alias("unobservable"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.when(F.col("_reason").isNotNull(), F.struct("_reason", "_n")))
            )
        ).alias("unobservable_reasons"),
    )


def verdict(tightening: Column, loosening: Column, neutral: Column) -> Column:
    return (
        F.when((tightening > 0) & (loosening > 0), "mixed")
        .when(tightening > 0, "tightening")
        .when(loosening > 0, "loosening")
        .when(neutral > 0, "faithful")
        .otherwise("no_observable_change")
    )


def judge_descriptions(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every description against its source, whose slots all count as present."""
    measured = measure(slots.withColumn("before_status", F.lit("present")), keys)
    return measured.withColumn("verdict", verdict(*[F.col(s) for s in SIGNS]))


def version_drift(
    versions: DataFrame, key: str = "provision_id", order: Sequence[str] = ("seq",), label: str = "seq"
) -> DataFrame:
    """Signs every consecutive pair of versions of a rule's cap.

    Rows are ordered across range partitions, so one rule with very many versions
    does not end in one task. ``order`` must be total within a rule.
    """
    stepped = with_previous(versions, [key], list(order), [label, "magnitude"])
    return stepped.where(F.col(f"previous_{label}").isNotNull()).withColumn(
        "direction", bound_sign(F.col("previous_magnitude"), F.col("magnitude"))
    )


def proposal_direction(proposals: DataFrame) -> DataFrame:
    """operation is ``<part>_<presence>``, e.g. exception_inserted."""
    part = F.substring_index("operation", "_", 1)
    presence = F.substring_index("operation", "_", -1)
    return proposals.withColumn("direction", sign_of(F.lit("part"), part, presence))
