"""Registered queries: signs of changes, reading bridge, drift through versions and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext.operators import direction, reader, runs
from normtext.plans import run_sql
from normtext.plans.bindings import (
    documents,
    readings,
    slot_observations,
    source_slots,
    table,
    texts,
)
from normtext.plans.registry import Registry

registry = Registry()


def changes(spark, sf_dir):
    """Order lines as slot changes: every combination of kind, part, rungs, scope and presence occurs."""
    lines = table(spark, sf_dir, "lineitem")
    pick = lambda names, index: F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)
    return lines.select(
        "l_suppkey",
        pick(["condition", "bound", "modality", "actor", "part"], F.col("l_orderkey") % 5).alias("kind"),
        pick(["duty", "exception", "ceiling"], F.col("l_suppkey") % 3).alias("part"),
        (F.col("l_quantity").cast("int") % 3).alias("before"),
        (F.col("l_partkey") % 3).cast("int").alias("after"),
        F.when(F.col("l_returnflag") == "A", "narrowed").when(F.col("l_returnflag") == "N", "broadened").otherwise("unchanged").alias("scope"),
        F.when(F.col("l_linestatus") == "O", "inserted").otherwise("removed").alias("presence"),
    )


_CHANGES = """changes AS (SELECT l_suppkey,
    (['condition', 'bound', 'modality', 'actor', 'part'])[(l_orderkey % 5)::INT + 1] AS kind,
    (['duty', 'exception', 'ceiling'])[(l_suppkey % 3)::INT + 1] AS part,
    (l_quantity::INT % 3)::INT AS before, (l_partkey % 3)::INT AS after,
    CASE l_returnflag WHEN 'A' THEN 'narrowed' WHEN 'N' THEN 'broadened' ELSE 'unchanged' END AS scope,
    CASE l_linestatus WHEN 'O' THEN 'inserted' ELSE 'removed' END AS presence FROM lineitem),
polar AS (SELECT *, sign(after - before)::INT AS step,
    -- +1: permitted states grow when the change goes up its own scale
    CASE kind WHEN 'condition' THEN CASE part WHEN 'duty' THEN 1 ELSE -1 END WHEN 'bound' THEN -1
      WHEN 'modality' THEN CASE part WHEN 'duty' THEN -1 END WHEN 'actor' THEN CASE part WHEN 'duty' THEN -1 ELSE 1 END
      WHEN 'part' THEN CASE part WHEN 'exception' THEN 1 WHEN 'ceiling' THEN -1 END END AS polarity,
    CASE kind WHEN 'actor' THEN CASE scope WHEN 'narrowed' THEN -1 WHEN 'broadened' THEN 1 ELSE 0 END
      WHEN 'part' THEN CASE presence WHEN 'inserted' THEN 1 ELSE -1 END ELSE sign(after - before)::INT END AS travel FROM changes),
signed AS (SELECT *, CASE WHEN travel = 0 THEN 'neutral' WHEN polarity * travel > 0 THEN 'loosening'
    WHEN polarity * travel < 0 THEN 'tightening' END AS sign FROM polar)"""


@registry.add(
    "change_signs",
    f"""WITH {_CHANGES} SELECT kind, part, before, after, scope, presence,
      CASE WHEN kind IN ('condition', 'bound', 'modality') THEN CASE step WHEN -1 THEN 'weakened' WHEN 1 THEN 'strengthened' ELSE 'unchanged' END END AS move,
      sign, CASE WHEN sign IS NULL AND kind = 'modality' THEN 'modality change off the duty has no ratified sign'
        WHEN sign IS NULL AND kind = 'part' THEN 'whole-duty insertion/removal has no ratified sign' END AS unratified_reason,
      count(*) AS changes FROM signed GROUP BY ALL""",
)
def change_signs(spark, sf_dir):
    columns = ["kind", "part", "before", "after", "scope", "presence", "move", "sign", "unratified_reason"]
    return direction.classify(changes(spark, sf_dir)).groupBy(*columns).agg(F.count("*").alias("changes"))


@registry.add(
    "direction_vectors",
    f"""WITH {_CHANGES} SELECT l_suppkey, count(*) FILTER (sign = 'tightening') AS tightening,
      count(*) FILTER (sign = 'loosening') AS loosening, count(*) FILTER (sign = 'neutral') AS neutral
    FROM signed GROUP BY 1""",
)
def direction_vectors(spark, sf_dir):
    return direction.direction_vector(direction.classify(changes(spark, sf_dir)), ["l_suppkey"])


_VERSION_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "magnitude", "l_extendedprice"]


@registry.add(
    "version_drift",
    f"""WITH stepped AS (SELECT 'order-' || l_orderkey AS provision_id, l_linenumber, l_quantity AS magnitude,
      lag(l_linenumber) OVER w AS previous_l_linenumber, lag(l_quantity) OVER w AS previous_magnitude FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(c if c != "magnitude" else "l_quantity" for c in _VERSION_ORDER)}))
    SELECT *, CASE WHEN magnitude > previous_magnitude THEN 'loosening' WHEN magnitude < previous_magnitude THEN 'tightening'
      ELSE 'neutral' END AS direction FROM stepped WHERE previous_magnitude IS NOT NULL""",
)
def version_drift(spark, sf_dir):
    versions = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("provision_id"),
        F.col("l_quantity").alias("magnitude"),
        *[c for c in _VERSION_ORDER if c != "magnitude"],
    )
    drift = direction.version_drift(versions, order=_VERSION_ORDER, label="l_linenumber")
    return drift.select(
        "provision_id", "l_linenumber", "magnitude", "previous_l_linenumber", "previous_magnitude", "direction"
    )


@registry.add(
    "proposal_directions",
    """WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'exception' WHEN 'O' THEN 'ceiling' ELSE 'duty' END AS part,
      CASE WHEN o_orderkey % 2 = 0 THEN 'inserted' ELSE 'removed' END AS presence FROM orders)
    SELECT o_orderkey, part || '_' || presence AS operation,
      CASE part || '_' || presence WHEN 'exception_inserted' THEN 'loosening' WHEN 'exception_removed' THEN 'tightening'
        WHEN 'ceiling_inserted' THEN 'tightening' WHEN 'ceiling_removed' THEN 'loosening' END AS direction FROM p""",
)
def proposal_directions(spark, sf_dir):
    part = F.when(F.col("o_orderstatus") == "F", "exception").when(F.col("o_orderstatus") == "O", "ceiling").otherwise("duty")
    presence = F.when(F.col("o_orderkey") % 2 == 0, "inserted").otherwise("removed")
    proposals = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", part, presence).alias("operation"))
    return direction.proposal_direction(proposals)


def slot_rows(spark, sf_dir):
    """Every read generation's slots with source and child readings side by side."""
    all_texts = texts(spark, sf_dir)
    origin = all_texts.where(F.col("generation") == 0).select("run_id", "passage_id", F.col("text_id").alias("source_text_id"))
    seen = slot_observations(spark, sf_dir)
    return (
        all_texts.where(F.col("generation") > 0)
        .select("run_id", "text_id", "passage_id")
        .join(origin, ["run_id", "passage_id"])
        .join(source_slots(spark, sf_dir).drop("text_id", "quote"), ["run_id", "passage_id"])
        .join(
            seen.select("run_id", F.col("text_id").alias("source_text_id"), "slot_id", F.col("status").alias("before_status")),
            ["run_id", "source_text_id", "slot_id"],
            "left",
        )
        .join(
            seen.select(
                "run_id", "text_id", "slot_id", F.col("status").alias("after_status"),
                F.col("seen_determinacy").alias("after_determinacy"), F.col("seen_modality").alias("after_modality"),
            ),
            ["run_id", "text_id", "slot_id"],
            "left",
        )
    )


@registry.add(
    "slot_changes",
    f"WITH {run_sql.CHANGES} SELECT run_id, text_id, slot_id, kind, attaches_to, reason, sign, observable FROM changes",
)
def slot_changes(spark, sf_dir):
    changed = direction.read_change(slot_rows(spark, sf_dir))
    return changed.select("run_id", "text_id", "slot_id", "kind", "attaches_to", "reason", "sign", "observable")


@registry.add(
    "subsumed_changes",
    f"WITH {run_sql.SUBSUMED} SELECT run_id, text_id, slot_id, reason, sign, observable FROM subsumed",
)
def subsumed_changes(spark, sf_dir):
    settled = direction.subsume(direction.read_change(slot_rows(spark, sf_dir)), ["run_id", "text_id"])
    return settled.select("run_id", "text_id", "slot_id", "reason", "sign", "observable")


def _reasons(measured):
    entries = F.transform(F.map_entries("unobservable_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return measured.withColumn("unobservable_reasons", F.array_join(entries, "|"))


@registry.add(
    "passage_vectors",
    f"""WITH {run_sql.MEASURED} SELECT run_id, text_id, tightening, loosening, neutral, unobservable, unobservable_reasons
    FROM measured""",
)
def passage_vectors(spark, sf_dir):
    return _reasons(direction.measure(slot_rows(spark, sf_dir), ["run_id", "text_id"]))


@registry.add(
    "description_verdicts",
    f"""WITH {run_sql.measured(before="'present'")} SELECT run_id, text_id, tightening, loosening, neutral, unobservable, unobservable_reasons,
      CASE WHEN tightening > 0 AND loosening > 0 THEN 'mixed' WHEN tightening > 0 THEN 'tightening'
        WHEN loosening > 0 THEN 'loosening' WHEN neutral > 0 THEN 'faithful' ELSE 'no_observable_change' END AS verdict
    FROM measured""",
)
def description_verdicts(spark, sf_dir):
    return _reasons(direction.judge_descriptions(slot_rows(spark, sf_dir), ["run_id", "text_id"]))


@registry.add(
    "drift_trajectory",
    f"""WITH {run_sql.MEASURED}
    SELECT t.run_id, t.chain_id, t.passage_id, t.style, t.variant, t.generation, t.text_id, r.text_id IS NOT NULL AS read,
      CASE WHEN r.text_id IS NOT NULL THEN coalesce(m.tightening, 0) END AS tightening,
      CASE WHEN r.text_id IS NOT NULL THEN coalesce(m.loosening, 0) END AS loosening,
      CASE WHEN r.text_id IS NOT NULL THEN coalesce(m.neutral, 0) END AS neutral,
      CASE WHEN r.text_id IS NOT NULL THEN coalesce(m.unobservable, 0) END AS unobservable,
      CASE WHEN r.text_id IS NOT NULL THEN coalesce(m.loosening, 0) - coalesce(m.tightening, 0) END AS net
    FROM texts t LEFT JOIN readings r ON r.run_id = t.run_id AND r.text_id = t.text_id
    LEFT JOIN measured m ON m.run_id = t.run_id AND m.text_id = t.text_id WHERE t.generation > 0""",
)
def drift_trajectory(spark, sf_dir):
    points = runs.trajectory(
        texts(spark, sf_dir), source_slots(spark, sf_dir), readings(spark, sf_dir), slot_observations(spark, sf_dir)
    )
    return points.drop("unobservable_reasons")


QUOTES = ["of the", "and that", "with the by"]


@registry.add(
    "quote_evidence",
    """WITH found AS (SELECT doc_id, quote, regexp_extract_all(text, replace(quote, ' ', '\\s+')) AS spans,
        string_split_regex(text, replace(quote, ' ', '\\s+')) AS gaps
      FROM documents, (VALUES ('of the'), ('and that'), ('with the by')) q(quote))
    SELECT 'doc-' || doc_id AS document_id, quote, len(spans)::INT AS occurrences,
      CASE WHEN len(spans) > 0 THEN 'found' ELSE 'not_found_requires_review' END AS literal_status,
      CASE WHEN len(spans) > 0 THEN length(gaps[1])::INT END AS first_start, spans[-1] AS last_quote FROM found""",
)
def quote_evidence(spark, sf_dir):
    asked = documents(spark, sf_dir).select(
        "document_id", "text", F.explode(F.array(*[F.lit(q) for q in QUOTES])).alias("quote")
    )
    audited = reader.quote_audit(asked)
    return audited.select(
        "document_id", "quote", "occurrences", "literal_status",
        F.get("evidence", F.lit(0))["start"].alias("first_start"),
        F.try_element_at("evidence", F.lit(-1))["span"].alias("last_quote"),
    )


@registry.add(
    "verbatim_readings",
    f"""WITH {run_sql.TEXTS},{run_sql.SLOTS} SELECT t.run_id, t.text_id, s.slot_id,
      CASE WHEN contains(t.text, s.quote) THEN 'present' ELSE 'absent' END AS status,
      CASE WHEN contains(t.text, s.quote) THEN s.quote END AS found_quote
    FROM texts t JOIN source_slots s ON s.run_id = t.run_id AND s.passage_id = t.passage_id""",
)
def verbatim_readings(spark, sf_dir):
    pairs = texts(spark, sf_dir).select("run_id", "text_id", "passage_id", "text").join(
        source_slots(spark, sf_dir).select("run_id", "passage_id", "slot_id", "quote"), ["run_id", "passage_id"]
    )
    return reader.verbatim_read(pairs).select("run_id", "text_id", "slot_id", "status", "found_quote")
