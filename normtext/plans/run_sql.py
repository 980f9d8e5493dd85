"""Checking SQL for the run tables."""

from __future__ import annotations

from normtext.plans.bindings import SLOTS as SLOT_ROWS


def _value(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


TEXTS = """
texts AS MATERIALIZED (
  SELECT 'run-' || (conv_id % 3) AS run_id, 'conv-' || (conv_id // 3) || ':' || turn AS text_id, 'conv-' || (conv_id // 3) AS passage_id,
    turn::INT AS generation, CASE WHEN turn > 0 THEN 'conv-' || (conv_id // 3) || ':' || (turn - 1) END AS parent_text_id,
    CASE WHEN turn > 0 THEN CASE WHEN (conv_id // 3) % 2 = 0 THEN 'paraphrase' ELSE 'allegorize' END END AS style,
    CASE WHEN turn > 0 THEN 'a' END AS variant,
    CASE WHEN turn > 0 THEN 'conv-' || (conv_id // 3) || ':' || CASE WHEN (conv_id // 3) % 2 = 0 THEN 'paraphrase' ELSE 'allegorize' END || ':a' END AS chain_id,
    CASE WHEN (conv_id // 3) % 4 = 0 THEN 'categorical' ELSE 'statutory' END AS norm_group,
    CASE WHEN (conv_id // 3) % 4 = 0 THEN 'pair-' || (conv_id // 3) END AS pair_id, text, length(text)::INT AS chars, role
  FROM conversations)"""

SLOTS = f"""
source_slots AS MATERIALIZED (
  SELECT t.run_id, t.text_id, t.passage_id, v.*, CASE WHEN t.chars % 2 = 0 THEN 'draft' ELSE 'ratified' END AS annotation_status
  FROM texts t JOIN (VALUES
    {", ".join("(" + ", ".join(_value(x) for x in row) + ")" for row in SLOT_ROWS)})
    v(slot_id, kind, attaches_to, quote, determinacy, modality)
  ON t.generation = 0 AND contains(t.text, v.quote))"""

READINGS = """
readings AS MATERIALIZED (
  SELECT run_id, 'read:' || text_id AS call_id, text_id, passage_id, generation, 'reader-' || role AS model, text, chars
  FROM texts WHERE chars % 7 <> 0),
observations AS MATERIALIZED (
  SELECT r.run_id, r.call_id, r.text_id, s.slot_id,
    CASE WHEN chars % 5 = 0 THEN 'uncertain' WHEN contains(r.text, s.quote) THEN 'present' ELSE 'absent' END AS status,
    CASE WHEN contains(r.text, s.quote) THEN s.quote END AS quote, 'note ' || chars AS note,
    CASE WHEN contains(r.text, s.quote || ' the') THEN 'specific' WHEN chars % 3 <> 0 THEN 'vague' END AS seen_determinacy,
    CASE WHEN contains(r.text, ' is ') THEN 'binding' WHEN chars % 3 <> 0 THEN 'weak' END AS seen_modality
  FROM readings r JOIN source_slots s ON s.run_id = r.run_id AND s.passage_id = r.passage_id)"""

BASE = f"{TEXTS},{SLOTS},{READINGS}"


def changes(before: str = "b.status") -> str:
    """Signs by definition: -1 the permitted states shrink (tightening), +1 they grow."""
    return f"""{BASE},
rows AS MATERIALIZED (
  SELECT t.run_id, t.text_id, s.slot_id, s.kind, s.attaches_to, {before} AS before_status, a.status AS after_status,
    CASE s.determinacy WHEN 'specific' THEN 2 WHEN 'vague' THEN 1 END AS base_d,
    CASE s.modality WHEN 'binding' THEN 2 WHEN 'weak' THEN 1 END AS base_m,
    CASE a.seen_determinacy WHEN 'specific' THEN 2 WHEN 'vague' THEN 1 END AS seen_d,
    CASE a.seen_modality WHEN 'binding' THEN 2 WHEN 'weak' THEN 1 END AS seen_m
  FROM texts t JOIN source_slots s ON s.run_id = t.run_id AND s.passage_id = t.passage_id
  LEFT JOIN observations b ON b.run_id = t.run_id AND b.text_id = s.text_id AND b.slot_id = s.slot_id
  LEFT JOIN observations a ON a.run_id = t.run_id AND a.text_id = t.text_id AND a.slot_id = s.slot_id
  WHERE t.generation > 0),
graded AS (
  SELECT *, coalesce(before_status = 'present' AND after_status = 'present', false) AS stays,
    coalesce(before_status = 'present' AND after_status = 'absent', false) AS goes FROM rows),
changes AS MATERIALIZED (
  SELECT *, reason IN ('computed', 'exception intact') AS observable,
    CASE WHEN reason = 'exception intact' THEN 'neutral' WHEN reason <> 'computed' THEN NULL
      WHEN kind = 'exception' THEN 'tightening'
      WHEN kind = 'bound' AND goes THEN 'loosening'
      WHEN kind = 'bound' THEN CASE WHEN seen_d < base_d THEN 'loosening' WHEN seen_d > base_d THEN 'tightening' ELSE 'neutral' END
      WHEN kind = 'modality' THEN CASE WHEN (CASE WHEN goes THEN 0 ELSE seen_m END) < base_m THEN 'loosening'
        WHEN (CASE WHEN goes THEN 0 ELSE seen_m END) > base_m THEN 'tightening' ELSE 'neutral' END
      WHEN attaches_to = 'duty' THEN CASE WHEN (CASE WHEN goes THEN 0 ELSE seen_d END) < base_d THEN 'tightening'
        WHEN (CASE WHEN goes THEN 0 ELSE seen_d END) > base_d THEN 'loosening' ELSE 'neutral' END
      ELSE CASE WHEN (CASE WHEN goes THEN 0 ELSE seen_d END) < base_d THEN 'loosening'
        WHEN (CASE WHEN goes THEN 0 ELSE seen_d END) > base_d THEN 'tightening' ELSE 'neutral' END END AS sign
  FROM (SELECT *, CASE
      WHEN NOT stays AND NOT goes AND coalesce(before_status = 'absent' AND after_status IN ('present', 'absent'), false)
        THEN 'baseline slot absent; insertion is out of scope here'
      WHEN NOT stays AND NOT goes THEN 'reading not resolved to present/absent'
      WHEN stays AND kind = 'exception' THEN 'exception intact'
      WHEN stays AND kind IN ('deadline', 'condition', 'bound') AND seen_d IS NULL THEN 'slot still present; determinacy rung not observable'
      WHEN stays AND kind = 'modality' AND seen_m IS NULL THEN 'slot still present; modality rung not observable'
      WHEN stays AND kind = 'actor' THEN 'slot still present; change not observable'
      WHEN goes AND kind = 'actor' THEN 'actor scope is not observable as present/absent'
      ELSE 'computed' END AS reason FROM graded) g)"""


def subsumed(before: str = "b.status") -> str:
    return f"""{changes(before)},
subsumed AS MATERIALIZED (
  SELECT c.run_id, c.text_id, c.slot_id, CASE WHEN gone THEN 'parent exception removed; subsumed' ELSE reason END AS reason,
    CASE WHEN NOT gone THEN sign END AS sign, observable AND NOT gone AS observable
  FROM (SELECT *, slot_id = 'carve_out_condition' AND coalesce(bool_or(goes AND kind = 'exception')
          OVER (PARTITION BY run_id, text_id), false) AS gone FROM changes) c)"""


def measured(before: str = "b.status") -> str:
    return f"""{subsumed(before)},
reasons AS (SELECT run_id, text_id, string_agg(reason || '=' || n, '|' ORDER BY reason) AS unobservable_reasons
  FROM (SELECT run_id, text_id, reason, count(*) AS n FROM subsumed WHERE NOT observable GROUP BY 1, 2, 3) r GROUP BY 1, 2),
measured AS MATERIALIZED (
  SELECT s.run_id, s.text_id, count(*) FILTER (sign = 'tightening') AS tightening, count(*) FILTER (sign = 'loosening') AS loosening,
    count(*) FILTER (sign = 'neutral') AS neutral, count(*) FILTER (NOT observable) AS unobservable,
    coalesce(any_value(unobservable_reasons), '') AS unobservable_reasons
  FROM subsumed s LEFT JOIN reasons r ON r.run_id = s.run_id AND r.text_id = s.text_id GROUP BY 1, 2)"""


CHANGES = changes()
SUBSUMED = subsumed()
MEASURED = measured()
