"""Registered queries: annotated passages, slots, analysis units and the selection axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.operators import axis, runs, slots
from normtext.operators.matching import match_lengths
from normtext.plans import run_sql
from normtext.plans import sql_parts as sql
from normtext.plans.bindings import STAND_IN, annotated_passages, axis_passages, documents, sources, table
from normtext.plans.experiments import DEPTH, PROMPTS
from normtext.plans.registry import Registry

registry = Registry()

_ROWS = f"""{run_sql.TEXTS},{run_sql.SLOTS},
passages AS (SELECT run_id || ':' || passage_id AS passage_id, run_id AS experiment, CASE WHEN role = 'system' THEN 'inline' ELSE 'statute' END AS domain,
  norm_group AS "group", text FROM texts WHERE generation = 0),
rows AS MATERIALIZED (SELECT p.*, s.slot_id, s.kind, s.attaches_to, s.quote, length(p.text)::INT AS passage_chars,
  length(s.quote)::INT AS quote_chars, (strpos(p.text, s.quote) - 1)::INT AS quote_start
  FROM passages p JOIN source_slots s ON s.run_id || ':' || s.passage_id = p.passage_id)"""


def _rows(spark, sf_dir):
    return slots.slot_rows(annotated_passages(spark, sf_dir))


@registry.add(
    "slot_shape",
    f"""WITH {_ROWS} SELECT domain, "group", count(DISTINCT passage_id) AS passages, count(*) AS slots,
      round(count(*) / count(DISTINCT passage_id), 1) AS slots_per_passage, count(quote) AS anchored_quotes,
      quantile_cont(passage_chars, 0.5) AS median_passage_chars FROM rows GROUP BY ALL""",
)
def slot_shape(spark, sf_dir):
    return slots.slot_shape(_rows(spark, sf_dir))


@registry.add(
    "slot_crosstab",
    f"""WITH {_ROWS} SELECT coalesce(kind, 'All') AS kind, count(*) FILTER (attaches_to = 'duty') AS duty,
      count(*) FILTER (attaches_to = 'exception') AS exception, count(*) FILTER (attaches_to = 'ceiling') AS ceiling,
      count(*) AS "All" FROM rows GROUP BY ROLLUP (kind)""",
)
def slot_crosstab(spark, sf_dir):
    return slots.crosstab(_rows(spark, sf_dir), "kind", "attaches_to", fv.ATTACHMENTS)


@registry.add(
    "quote_coverage",
    f"""WITH {_ROWS}, covered AS (SELECT passage_id, count(DISTINCT pos) AS n FROM rows, unnest(range(quote_start, quote_start + quote_chars)) t(pos) GROUP BY 1),
    held AS (SELECT passage_id, count(*) AS n FROM rows GROUP BY 1)
    SELECT p.passage_id, p.domain, length(p.text)::INT AS chars, coalesce(c.n, 0)::INT AS covered_chars,
      round(coalesce(c.n, 0) / length(p.text), 3) AS coverage, coalesce(h.n, 0)::INT AS slots
    FROM passages p LEFT JOIN covered c USING (passage_id) LEFT JOIN held h USING (passage_id)""",
)
def quote_coverage(spark, sf_dir):
    return slots.quote_coverage(annotated_passages(spark, sf_dir))


@registry.add(
    "quote_positions",
    f"""WITH {_ROWS} SELECT domain, attaches_to, count(*) AS count, round(avg(round(quote_start / passage_chars, 3)), 3) AS mean,
      round(quantile_cont(round(quote_start / passage_chars, 3), 0.5), 3) AS median FROM rows GROUP BY ALL""",
)
def quote_positions(spark, sf_dir):
    return slots.quote_positions(_rows(spark, sf_dir))


@registry.add(
    "condition_order",
    f"""WITH {_ROWS} SELECT e.passage_id, e.domain, e.slot_id AS exception, c.slot_id AS condition,
      c.quote_start > e.quote_start AS condition_after_exception
    FROM rows e JOIN rows c USING (passage_id) WHERE e.kind = 'exception' AND c.kind <> 'exception' AND c.attaches_to = 'exception'""",
)
def condition_order(spark, sf_dir):
    return slots.condition_order(annotated_passages(spark, sf_dir))


def _chains(spark, sf_dir):
    only = F.when(F.col("norm_group") == "categorical", F.array(F.lit("paraphrase")))
    own_id = F.concat_ws(":", "run_id", "passage_id").alias("passage_id")
    passages = sources(spark, sf_dir).select("run_id", own_id, only.alias("styles"))
    return runs.grid(passages, PROMPTS, 1).withColumnRenamed("run_id", "experiment")


_CHAINS = f"""{_ROWS}, chains AS MATERIALIZED (SELECT p.experiment, p.passage_id, p.passage_id || ':' || s || ':' || v AS chain_id, s AS style
  FROM passages p, (VALUES {", ".join(f"('{s}', '{v}')" for s, v in PROMPTS)}) t(s, v)
  WHERE p."group" <> 'categorical' OR s = 'paraphrase')"""


@registry.add(
    "analysis_units",
    f"""WITH {_CHAINS}, p AS (SELECT experiment, count(*) AS passages FROM passages GROUP BY 1)
    SELECT experiment, count(DISTINCT chain_id) AS independent_chains, count(DISTINCT style) AS styles, any_value(passages) AS passages,
      round(count(DISTINCT chain_id) / any_value(passages), 1) AS chains_per_passage,
      count(DISTINCT chain_id) * {DEPTH} + any_value(passages) AS readings, {DEPTH}::INT AS readings_per_chain
    FROM chains JOIN p USING (experiment) GROUP BY 1""",
)
def analysis_units(spark, sf_dir):
    return slots.analysis_units(_chains(spark, sf_dir), annotated_passages(spark, sf_dir), DEPTH)


@registry.add(
    "pair_chains",
    f"""WITH {_CHAINS}, n AS (SELECT passage_id, count(DISTINCT chain_id) AS chains FROM chains GROUP BY 1),
    e AS (SELECT passage_id, count(*) FILTER (kind = 'exception') AS x, count(*) FILTER (attaches_to = 'exception' AND kind <> 'exception') AS c
      FROM rows GROUP BY 1)
    SELECT p.experiment, p.passage_id, coalesce(x, 0)::INT AS exception_slots, coalesce(c, 0)::INT AS conditions_on_exception,
      coalesce(x * c, 0) AS pairs, chains, coalesce(x * c * chains, 0) AS pair_chains
    FROM passages p JOIN n USING (passage_id) LEFT JOIN e USING (passage_id)""",
)
def pair_chains(spark, sf_dir):
    return slots.pair_chains(annotated_passages(spark, sf_dir), _chains(spark, sf_dir))


@registry.add(
    "direction_if_lost",
    f"""WITH {_ROWS} SELECT domain, CASE WHEN attaches_to = 'duty' AND kind IN ('condition', 'deadline', 'modality') THEN 'loosens'
        WHEN attaches_to = 'exception' THEN 'tightens' ELSE 'unclear' END AS plain_reading,
      CASE slot_id WHEN 'operator' THEN 'loosening' WHEN 'time_limit' THEN 'tightening' WHEN 'carve_out' THEN 'tightening'
        WHEN 'carve_out_condition' THEN 'loosening' WHEN 'cap' THEN 'loosening' END AS ratified_sign,
      count(*) AS slot_shapes FROM (SELECT DISTINCT domain, kind, attaches_to, slot_id FROM rows) r GROUP BY ALL""",
)
def direction_if_lost(spark, sf_dir):
    return slots.direction_if_lost(_rows(spark, sf_dir))


_AXIS = f"""
provisions AS MATERIALIZED (SELECT 'doc-' || doc_id AS provision_id, 'doc-' || doc_id AS document_id, doc_id,
  ({["virtue", "categorical", "conditional", "statutory"]})[doc_id % 4 + 1] AS "group", lang AS topic,
  CASE WHEN doc_id % 40 <> 1 THEN 'pair-' || (doc_id // 4) END AS pair_id, text, length(text)::INT AS chars FROM documents)"""
_COUNTS = f"""{_AXIS},{sql.hits()},
counts AS MATERIALIZED (SELECT p.provision_id AS passage_id, p."group", p.chars, count(*) FILTER (category = 'duty')::INT AS duty,
  count(*) FILTER (category = 'exception')::INT AS exception, count(*) FILTER (category = 'qualifier')::INT AS qualifier
  FROM provisions p LEFT JOIN hits h USING (provision_id) GROUP BY ALL)"""


@registry.add("axis_counts", f"WITH {_COUNTS} SELECT * FROM counts")
def axis_counts(spark, sf_dir):
    return axis.passage_counts(axis_passages(spark, sf_dir), STAND_IN)


@registry.add(
    "axis_hit_summary",
    f"""WITH {_COUNTS} SELECT "group", count(*) AS passages, sum(duty)::BIGINT AS duty, sum(exception)::BIGINT AS exception,
      sum(qualifier)::BIGINT AS qualifier, count(*) FILTER (duty > 0) AS passages_with_duty,
      count(*) FILTER (exception > 0) AS passages_with_exception, count(*) FILTER (qualifier > 0) AS passages_with_qualifier
    FROM counts GROUP BY 1""",
)
def axis_hit_summary(spark, sf_dir):
    return axis.hit_summary(axis.passage_counts(axis_passages(spark, sf_dir), STAND_IN))


@registry.add(
    "axis_lengths",
    f"""WITH {_AXIS} SELECT "group", count(*) AS n, min(chars) AS min, quantile_cont(chars, 0.25) AS q1, quantile_cont(chars, 0.5) AS median,
      quantile_cont(chars, 0.75) AS q3, max(chars) AS max, round(avg(chars), 1) AS mean FROM provisions GROUP BY 1""",
)
def axis_lengths(spark, sf_dir):
    return axis.length_summary(axis_passages(spark, sf_dir))


@registry.add(
    "paired_lengths",
    f"""WITH {_AXIS}, a AS (SELECT pair_id, count(*) AS n, max(topic) AS topic, max(chars) AS chars FROM provisions WHERE "group" = 'categorical' GROUP BY 1),
    b AS (SELECT pair_id, count(*) AS n, max(topic) AS topic, max(chars) AS chars FROM provisions WHERE "group" = 'conditional' GROUP BY 1)
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, a.topic, a.chars AS categorical, b.chars AS conditional, b.chars - a.chars AS difference,
      CASE WHEN coalesce(a.pair_id, b.pair_id) IS NULL THEN 'missing pair_id' WHEN a.n > 1 OR b.n > 1 THEN 'duplicate member'
        WHEN a.n IS NULL OR b.n IS NULL THEN 'incomplete pair' WHEN a.topic <> b.topic THEN 'topic mismatch' END AS problem
    FROM a FULL JOIN b ON a.pair_id IS NOT DISTINCT FROM b.pair_id""",
)
def paired_lengths(spark, sf_dir):
    return axis.paired_lengths(axis_passages(spark, sf_dir))


@registry.add(
    "expectation_checks",
    f"""WITH {_COUNTS}, marked AS (SELECT passage_id, "group",
      CASE "group" WHEN 'virtue' THEN '---' WHEN 'categorical' THEN 'd--' ELSE 'deq' END AS expected,
      CASE WHEN duty > 0 THEN 'd' ELSE '-' END || CASE WHEN exception > 0 THEN 'e' ELSE '-' END
        || CASE WHEN qualifier > 0 THEN 'q' ELSE '-' END AS observed FROM counts)
    SELECT *, expected = observed AS passed FROM marked""",
)
def expectation_checks(spark, sf_dir):
    return axis.expectation_checks(axis.passage_counts(axis_passages(spark, sf_dir), STAND_IN))


@registry.add(
    "control_failures",
    f"""WITH {_AXIS},{sql.hits()} SELECT h.provision_id AS passage_id, h.category, h.marker, h.char_offset
    FROM hits h JOIN provisions p USING (provision_id) WHERE p."group" = 'virtue'""",
)
def control_failures(spark, sf_dir):
    failed = axis.control_failures(axis_passages(spark, sf_dir), STAND_IN)
    return failed.select("passage_id", F.explode("hits").alias("h")).select(
        "passage_id", "h.category", "h.marker", "h.char_offset"
    )


@registry.add(
    "length_matches",
    """WITH RECURSIVE wanted AS (SELECT 'item-' || item_id AS id, length(text) AS chars FROM benchmark
      UNION ALL SELECT 'turn-' || conv_id || '-' || turn, length(text) FROM conversations),
    targets AS (SELECT row_number() OVER (ORDER BY chars, id) AS n, id, chars FROM wanted),
    controls AS (SELECT 'doc-' || doc_id AS id, length(text) AS chars FROM documents),
    taking(n, used, id, chars) AS (
      SELECT 0::BIGINT, []::VARCHAR[], ''::VARCHAR, 0::BIGINT
      UNION ALL
      SELECT t.n, list_append(any_value(k.used), arg_min(c.id, lpad(abs(c.chars - t.chars)::VARCHAR, 9, '0') || c.id)),
        arg_min(c.id, lpad(abs(c.chars - t.chars)::VARCHAR, 9, '0') || c.id),
        arg_min(c.chars, lpad(abs(c.chars - t.chars)::VARCHAR, 9, '0') || c.id)
      FROM taking k JOIN targets t ON t.n = k.n + 1 JOIN controls c ON NOT list_contains(k.used, c.id) GROUP BY t.n)
    SELECT k.id AS passage_id, t.id AS matched_to, k.chars AS chars, k.chars - t.chars AS length_difference
    FROM taking k JOIN targets t USING (n)""",
)
def length_matches(spark, sf_dir):
    """Benchmark passages and conversation turns take the document nearest in length, each document once."""
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("passage_id"), F.length("text").alias("chars")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("passage_id"), F.length("text").alias("chars")
    )
    targets = items.unionByName(turns)
    controls = documents(spark, sf_dir).select(F.col("document_id").alias("passage_id"), F.length("text").alias("chars"))
    return match_lengths(targets, controls)
