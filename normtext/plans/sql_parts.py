"""Shared pieces of the checking SQL, written for an engine with RE2 patterns."""

from __future__ import annotations

from normtext.lexicon import Lexicon
from normtext.plans.bindings import STAND_IN


def quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROVISIONS = """
provisions AS MATERIALIZED (
  SELECT 'doc-' || doc_id || ':P' || n AS provision_id, 'doc-' || doc_id AS document_id,
         source AS document_title, CASE WHEN lang <> 'de' THEN lang END AS document_version,
         lang AS chapter, source AS heading, 'P' || n AS label, n::INT AS "order",
         lines[n] AS text, length(lines[n])::INT AS char_count, sha AS source_sha256
  FROM (SELECT *, string_split(text, chr(10)) AS lines, sha256(text) AS sha FROM documents) d,
       unnest(range(1, len(lines) + 1)) t(n)
  WHERE trim(lines[n]) <> '')"""


def hits_of(entries: list[tuple[str, str, int, str]], name: str = "hits", source: str = "provisions") -> str:
    """entries: (category, marker, position, pattern)"""
    raw = " UNION ALL ".join(
        f"SELECT provision_id, document_id, text, {lit(c)} AS category, {lit(m)} AS marker, {i} AS position,"
        f" regexp_extract_all(text, {quoted(p)}) AS spans, string_split_regex(text, {quoted(p)}) AS gaps"
        f" FROM {source} WHERE regexp_matches(text, {quoted(p)})"
        for c, m, i, p in entries
    )
    return f"""
{name} AS MATERIALIZED (
  SELECT provision_id, document_id, text, category, marker, position, span AS matched_span, char_offset,
         (char_offset + length(span))::INT AS char_end
  FROM (SELECT *, spans[i] AS span,
          (coalesce(list_sum([length(g) for g in gaps[1:i]]), 0)
           + coalesce(list_sum([length(s) for s in spans[1:i - 1]]), 0))::INT AS char_offset
        FROM ({raw}) raw, unnest(range(1, len(spans) + 1)) t(i)) located)"""


def hits(lexicon: Lexicon = STAND_IN, name: str = "hits", source: str = "provisions") -> str:
    return hits_of([(m.category, m.marker, i, m.pattern) for i, m in enumerate(lexicon.markers)], name, source)


def fired(lexicon: Lexicon = STAND_IN, name: str = "fired", source: str = "provisions") -> str:
    parts = " UNION ALL ".join(
        f"SELECT provision_id, {lit(m.category)} AS category, {lit(m.marker)} AS marker, {m.weight} AS weight,"
        f" {i} AS position FROM {source} WHERE regexp_matches(text, {quoted(m.pattern)})"
        for i, m in enumerate(lexicon.markers)
    )
    return f"\n{name} AS MATERIALIZED ({parts})"


def clauses(lexicon: Lexicon = STAND_IN) -> str:
    """Needs hits."""
    return """
clauses AS MATERIALIZED (
  SELECT provision_id, marker, char_offset AS clause_start,
         matched_span || regexp_extract(substring(text, char_end + 1), '^[^.,;:]*') AS clause
  FROM hits WHERE category = 'qualifier')"""


def terms(column: str, pattern: str) -> str:
    return f"list_sort(list_distinct([lower(x) for x in regexp_extract_all({column}, {quoted(pattern)})]))"


def rung(specific: str, vague: str) -> str:
    return f"CASE WHEN {specific} THEN 'specific' WHEN {vague} THEN 'vague' ELSE 'unmarked' END"


def text_rung(lexicon: Lexicon = STAND_IN, column: str = "text") -> str:
    return rung(
        f"regexp_matches({column}, {quoted(lexicon.specific)})",
        f"regexp_matches({column}, {quoted(lexicon.vague)})",
    )


def clause_rungs(lexicon: Lexicon = STAND_IN) -> str:
    """Needs clauses."""
    return f"""
clause_rungs AS MATERIALIZED (
  SELECT provision_id, {rung("max(s)", "max(v)")} AS qualifier_determinacy
  FROM (SELECT provision_id, regexp_matches(clause, {quoted(lexicon.specific)}) AS s,
               regexp_matches(clause, {quoted(lexicon.vague)}) AS v FROM clauses) c
  GROUP BY provision_id)"""


STRENGTHS = """
strengths AS MATERIALIZED (
  SELECT provision_id, category, max(weight) + least(2, count(*) - 1) AS strength,
         arg_max(marker, weight * 1000 - position) AS marker
  FROM fired GROUP BY provision_id, category)"""


def scored(lexicon: Lexicon = STAND_IN) -> str:
    """Needs provisions, fired, strengths, clause_rungs: one row per candidate."""
    return f"""
candidates_unranked AS MATERIALIZED (
  SELECT p.provision_id, p.document_id, p.document_title, p.label, p.text, p.char_count,
         d.strength::INT AS duty_strength, e.strength::INT AS exception_strength, q.strength::INT AS qualifier_strength,
         d.marker AS duty_marker, e.marker AS exception_marker, q.marker AS qualifier_marker,
         CASE WHEN regexp_matches(p.text, {quoted(lexicon.specific)}) THEN 4 ELSE 0 END AS specific_bonus,
         CASE WHEN regexp_matches(p.text, {quoted(lexicon.vague)}) THEN 1 ELSE 0 END AS vague_bonus,
         CASE WHEN p.char_count BETWEEN 150 AND 900 THEN 4 ELSE 0 END AS length_bonus,
         {text_rung(lexicon, "p.text")} AS determinacy, c.qualifier_determinacy
  FROM provisions p
  JOIN strengths d ON d.provision_id = p.provision_id AND d.category = 'duty'
  JOIN strengths e ON e.provision_id = p.provision_id AND e.category = 'exception'
  JOIN strengths q ON q.provision_id = p.provision_id AND q.category = 'qualifier'
  JOIN clause_rungs c ON c.provision_id = p.provision_id),
candidates AS MATERIALIZED (
  SELECT *, score::DOUBLE AS score_d, true AS has_duty, true AS has_exception, true AS has_qualifier,
         row_number() OVER (ORDER BY score DESC, char_count, provision_id) AS rank
  FROM (SELECT *, duty_strength + exception_strength + qualifier_strength
                  + specific_bonus + vague_bonus + length_bonus AS score FROM candidates_unranked) s)"""


def candidates(lexicon: Lexicon = STAND_IN, provisions: str = PROVISIONS) -> str:
    """The whole chain down to ranked candidates."""
    return ",".join(
        [provisions, hits(lexicon), fired(lexicon), clauses(lexicon), clause_rungs(lexicon), STRENGTHS, scored(lexicon)]
    )
