"""Registered queries: marker scan, determinacy, score and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext.operators import audits, markers, shortlist
from normtext.operators.dossier import dossier
from normtext.plans import sql_parts as sql
from normtext.plans.bindings import EARLIER_SPECIFIC, STAND_IN, provisions, table
from normtext.plans.registry import Registry
from normtext.session import stable

registry = Registry()
SEED = 20260911


def joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column)


@registry.add(
    "marker_hits",
    f"WITH {sql.PROVISIONS},{sql.hits()} SELECT provision_id, category, marker, position, matched_span, char_offset,"
    " char_end FROM hits",
)
def marker_hits(spark, sf_dir):
    return markers.marker_hits(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "fired_markers",
    f"WITH {sql.PROVISIONS},{sql.fired()} SELECT provision_id, category, marker, weight FROM fired",
)
def fired_markers(spark, sf_dir):
    return markers.fired_markers(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "category_strengths",
    f"""WITH {sql.PROVISIONS},{sql.fired()},{sql.STRENGTHS}
    SELECT p.provision_id,
      coalesce(max(strength) FILTER (category = 'duty'), 0)::INT AS duty_strength,
      coalesce(max(strength) FILTER (category = 'exception'), 0)::INT AS exception_strength,
      coalesce(max(strength) FILTER (category = 'qualifier'), 0)::INT AS qualifier_strength,
      max(marker) FILTER (category = 'duty') AS duty_marker,
      max(marker) FILTER (category = 'exception') AS exception_marker,
      max(marker) FILTER (category = 'qualifier') AS qualifier_marker
    FROM provisions p LEFT JOIN strengths s ON s.provision_id = p.provision_id GROUP BY p.provision_id""",
)
def category_strengths(spark, sf_dir):
    return shortlist.strengths(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "provision_determinacy",
    f"""WITH {sql.PROVISIONS} SELECT provision_id, {sql.text_rung()} AS determinacy,
      coalesce(array_to_string({sql.terms("text", STAND_IN.specific)}, '|'), '') AS specific_terms,
      coalesce(array_to_string({sql.terms("text", STAND_IN.vague)}, '|'), '') AS vague_terms FROM provisions""",
)
def provision_determinacy(spark, sf_dir):
    graded = markers.with_determinacy(provisions(spark, sf_dir), STAND_IN)
    return graded.select("provision_id", "determinacy", joined("specific_terms"), joined("vague_terms"))


@registry.add(
    "qualifier_spans",
    f"""WITH {sql.PROVISIONS},{sql.hits()},{sql.clauses()} SELECT provision_id, marker, clause, clause_start,
      (clause_start + length(clause))::INT AS clause_end FROM clauses""",
)
def qualifier_spans(spark, sf_dir):
    return markers.qualifier_spans(provisions(spark, sf_dir), STAND_IN)


def _pooled_terms(pattern: str) -> str:
    return (
        f"coalesce(array_to_string(list_sort(list_distinct(flatten(list({sql.terms('clause', pattern)})))), '|'), '')"
    )


@registry.add(
    "qualifier_determinacy",
    f"""WITH {sql.PROVISIONS},{sql.hits()},{sql.clauses()},{sql.clause_rungs()}, pooled AS (
      SELECT provision_id, {_pooled_terms(STAND_IN.specific)} AS s, {_pooled_terms(STAND_IN.vague)} AS v
      FROM clauses GROUP BY provision_id)
    SELECT p.provision_id, coalesce(qualifier_determinacy, 'unmarked') AS qualifier_determinacy,
      coalesce(s, '') AS qualifier_specific, coalesce(v, '') AS qualifier_vague
    FROM provisions p LEFT JOIN clause_rungs USING (provision_id) LEFT JOIN pooled USING (provision_id)""",
)
def qualifier_determinacy(spark, sf_dir):
    graded = markers.with_qualifier_determinacy(provisions(spark, sf_dir), STAND_IN)
    return graded.select(
        "provision_id", "qualifier_determinacy", joined("qualifier_specific"), joined("qualifier_vague")
    )


PARTS = [
    "duty_strength", "exception_strength", "qualifier_strength", "specific_bonus", "vague_bonus", "length_bonus",
]


@registry.add(
    "score_breakdown",
    f"""WITH {sql.candidates()} SELECT p.provision_id, {", ".join(PARTS)}, c.determinacy, score_d AS score, p.char_count
    FROM provisions p LEFT JOIN candidates c ON c.provision_id = p.provision_id""",
)
def score_breakdown(spark, sf_dir):
    scored = shortlist.score(provisions(spark, sf_dir), STAND_IN)
    return scored.select("provision_id", *PARTS, "determinacy", "score", "char_count")


CANDIDATE_SQL = (
    "provision_id, rank, score_d AS score, has_duty, has_exception, has_qualifier, determinacy, qualifier_determinacy,"
    " duty_marker, exception_marker, qualifier_marker, char_count"
)


@registry.add("shortlist", f"WITH {sql.candidates()} SELECT {CANDIDATE_SQL} FROM candidates")
def ranked_shortlist(spark, sf_dir):
    return shortlist.shortlist(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "shortlist_by_length",
    f"""WITH {sql.candidates()} SELECT provision_id, score_d AS score, char_count,
      row_number() OVER (ORDER BY score DESC, char_count, provision_id) AS rank
    FROM candidates WHERE char_count BETWEEN 150 AND 900""",
)
def shortlist_by_length(spark, sf_dir):
    chosen = shortlist.shortlist(provisions(spark, sf_dir), STAND_IN, min_chars=150, max_chars=900)
    return chosen.select("provision_id", "score", "char_count", "rank")


_OPENER = [("ceiling", "opener", 0, STAND_IN.ceiling_opener)]
_WINDOW = f"substring(text, char_offset + 1, char_end - char_offset + {STAND_IN.ceiling_window})"


@registry.add(
    "ceiling_flags",
    f"""WITH {sql.PROVISIONS},{sql.hits_of(_OPENER)} SELECT provision_id, char_offset,
      replace({_WINDOW}, chr(10), ' ') AS "window",
      regexp_matches({_WINDOW}, {sql.quoted(STAND_IN.ceiling_bound)}) AS has_bound FROM hits""",
)
def ceiling_flags(spark, sf_dir):
    return markers.ceiling_flags(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "ceiling_scan",
    f"""WITH {sql.candidates()},{sql.hits_of(_OPENER, "openers", "candidates")}, flagged AS (
      SELECT DISTINCT provision_id FROM openers
      WHERE regexp_matches({_WINDOW}, {sql.quoted(STAND_IN.ceiling_bound)}))
    SELECT (SELECT count(*) FROM candidates) AS candidates,
      (SELECT count(DISTINCT provision_id) FROM openers) AS with_opener, (SELECT count(*) FROM flagged) AS flagged,
      round(100.0 * (SELECT count(*) FROM flagged) / (SELECT count(DISTINCT provision_id) FROM openers), 1) AS flagged_pct
    """,
)
def ceiling_scan(spark, sf_dir):
    gated = shortlist.score(provisions(spark, sf_dir), STAND_IN).where(F.col("score").isNotNull())
    return markers.ceiling_scan(gated, STAND_IN)


@registry.add(
    "clause_crossing",
    f"""WITH {sql.PROVISIONS},{sql.hits()}
    SELECT m.category, m.marker, m.pattern, count(h.marker) AS hits,
      count(h.marker) FILTER (regexp_matches(h.matched_span, {sql.quoted(STAND_IN.clause_boundary)})) AS clause_crossing_hits,
      coalesce(round(count(h.marker) FILTER (regexp_matches(h.matched_span, {sql.quoted(STAND_IN.clause_boundary)}))
        / nullif(count(h.marker), 0)::DOUBLE, 4), 0.0) AS crossing_rate
    FROM (VALUES ('exception', 'and that', {sql.lit(STAND_IN.markers[2].pattern)}),
                 ('qualifier', 'for', {sql.lit(STAND_IN.markers[7].pattern)})) m(category, marker, pattern)
    LEFT JOIN hits h USING (category, marker) GROUP BY ALL""",
)
def clause_crossing(spark, sf_dir):
    return audits.crossing_audit(markers.marker_hits(provisions(spark, sf_dir), STAND_IN), STAND_IN)


@registry.add(
    "crossing_sample",
    f"""WITH {sql.PROVISIONS},{sql.hits()}
    SELECT provision_id, category, marker, char_offset, matched_span, draw FROM (
      SELECT *, row_number() OVER (PARTITION BY category, marker
        ORDER BY sha256('{SEED}|' || provision_id || '|' || char_offset), provision_id, char_offset)::INT AS draw
      FROM hits) d WHERE draw <= 20""",
)
def crossing_sample(spark, sf_dir):
    drawn = audits.crossing_sample(markers.marker_hits(provisions(spark, sf_dir), STAND_IN), 20, SEED)
    return drawn.select("provision_id", "category", "marker", "char_offset", "matched_span", "draw")


@registry.add(
    "determinacy_delta",
    f"""WITH {sql.PROVISIONS}, rungs AS (SELECT provision_id, text,
      {sql.rung(f"regexp_matches(text, {sql.quoted(EARLIER_SPECIFIC)})", f"regexp_matches(text, {sql.quoted(STAND_IN.vague)})")} AS before,
      {sql.text_rung()} AS after FROM provisions)
    SELECT provision_id, before, after, array_to_string(list_sort(list_filter({sql.terms("text", STAND_IN.specific)},
      lambda x: NOT list_contains({sql.terms("text", EARLIER_SPECIFIC)}, x))), ', ') AS newly_matched
    FROM rungs WHERE before <> after""",
)
def determinacy_delta(spark, sf_dir):
    return audits.determinacy_delta(provisions(spark, sf_dir), EARLIER_SPECIFIC, STAND_IN.specific, STAND_IN.vague)


TIGHTER = STAND_IN.replacing("and that", r"\band\s+(?:\w+\s+){0,1}?that\b").replacing("are", r"\bare\s+of\b")


@registry.add(
    "projected_change",
    f"""WITH {sql.PROVISIONS},{sql.fired()},{sql.fired(TIGHTER, "fired_after")},
    before AS (SELECT provision_id FROM fired GROUP BY 1 HAVING count(DISTINCT category) = 3),
    after AS (SELECT provision_id FROM fired_after GROUP BY 1 HAVING count(DISTINCT category) = 3),
    strong AS (SELECT provision_id FROM provisions WHERE regexp_matches(text, {sql.quoted(STAND_IN.specific)}))
    SELECT (SELECT count(*) FROM before) AS candidates_before, (SELECT count(*) FROM after) AS candidates_after,
      (SELECT count(*) FROM before ANTI JOIN after USING (provision_id)) AS leaving,
      (SELECT count(*) FROM before SEMI JOIN strong USING (provision_id)) AS specific_before,
      (SELECT count(*) FROM after SEMI JOIN strong USING (provision_id)) AS specific_after""",
)
def projected_change(spark, sf_dir):
    return audits.projected_change(provisions(spark, sf_dir), STAND_IN, TIGHTER)


@registry.add(
    "leaving_candidates",
    f"""WITH {sql.PROVISIONS},{sql.fired()},{sql.fired(TIGHTER, "fired_after")}
    SELECT provision_id FROM fired GROUP BY 1 HAVING count(DISTINCT category) = 3
    EXCEPT SELECT provision_id FROM fired_after GROUP BY 1 HAVING count(DISTINCT category) = 3""",
)
def leaving_candidates(spark, sf_dir):
    return audits.leaving(provisions(spark, sf_dir), STAND_IN, TIGHTER)


COMPARED = {
    "current": r"\bof\s+(?:\w+\s+){0,3}?the\b",
    "allowlist": r"\bof\s+(?:(?:by|with)\s+){0,3}the\b",
    "widened": r"\bof\s+(?:(?:by|with|for|and|to|that)\s+){0,3}the\b",
    "tempered": r"\bof\s+(?:(?!(?:and|that)\b)[^\s,;:.!?]+\s+){0,3}the\b",
    "tempered_coord": r"\bof\s+(?:(?!(?:that)\b)[^\s,;:.!?]+\s+){0,3}the\b",
}


def _gold(spark, sf_dir):
    """Every hit of the current pattern in a labelled document, labelled by its quality."""
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"),
        F.when(F.col("quality") == 1, "conditional").otherwise("spurious").alias("label"),
    )
    current = markers.matches("text", markers.IGNORE_CASE + COMPARED["current"])
    found = provisions(spark, sf_dir).select("document_id", "provision_id", F.explode(current).alias("m"))
    return found.join(labels, "document_id").select(
        "provision_id", F.col("m.start").alias("char_offset"), F.col("m.span").alias("span"), "label"
    )


def _decided(spark, sf_dir):
    return audits.decisions(_gold(spark, sf_dir), provisions(spark, sf_dir), COMPARED, "conditional")


def _tempered(words: str, most: int) -> str:
    """Without lookahead: the shortest gap that reaches the end word holds no boundary word."""
    rest = "substring(g.text, g.char_offset + 1)"
    pattern = f"^of\\s+((?:[^\\s,;:.!?]+\\s+){{0,{most}}}?)the\\b"
    gap = f"regexp_extract({rest}, {sql.quoted(pattern)}, 1)"
    return (
        f"(regexp_matches({rest}, {sql.quoted(pattern)})"
        f" AND NOT regexp_matches({gap}, {sql.quoted(f'(^|\\s)(?:{words})\\b')}))"
    )


_DECIDED = f"""{sql.PROVISIONS},
{sql.hits_of([("p", name, 0, COMPARED[name]) for name in ("current", "allowlist", "widened")], "tried")},
gold AS (SELECT t.provision_id, t.char_offset, t.matched_span AS span, t.text,
   CASE WHEN quality = 1 THEN 'conditional' ELSE 'spurious' END AS label
  FROM tried t JOIN labels l ON t.document_id = 'doc-' || l.doc_id WHERE t.marker = 'current'),
decided AS (
  SELECT g.provision_id, g.char_offset, g.span, g.label, p.pattern, t.provision_id IS NOT NULL AS fired
  FROM gold g CROSS JOIN (VALUES ('current'), ('allowlist'), ('widened')) p(pattern)
  LEFT JOIN tried t ON t.provision_id = g.provision_id AND t.char_offset = g.char_offset AND t.marker = p.pattern
  UNION ALL SELECT g.provision_id, g.char_offset, g.span, g.label, 'tempered', {_tempered("and|that", 3)} FROM gold g
  UNION ALL SELECT g.provision_id, g.char_offset, g.span, g.label, 'tempered_coord', {_tempered("that", 3)} FROM gold g)"""


@registry.add(
    "pattern_scorecard",
    f"""WITH {_DECIDED}, counts AS (SELECT pattern,
      count(*) FILTER (fired AND label = 'conditional') AS tp, count(*) FILTER (fired AND label <> 'conditional') AS fp,
      count(*) FILTER (NOT fired AND label = 'conditional') AS fn,
      count(*) FILTER (NOT fired AND label <> 'conditional') AS tn FROM decided GROUP BY pattern)
    SELECT pattern, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative,
      0::BIGINT AS not_verbatim, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 6), 0.0) AS "precision",
      coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 6), 0.0) AS recall,
      coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6), 0.0) AS f1 FROM counts""",
)
def pattern_scorecard(spark, sf_dir):
    return audits.scorecard(_decided(spark, sf_dir))


@registry.add(
    "decision_changes",
    f"""WITH {_DECIDED} SELECT a.provision_id, a.char_offset, a.label,
      CASE WHEN a.fired THEN 'now silent' ELSE 'now fires' END AS movement,
      CASE WHEN b.fired = (b.label = 'conditional') THEN 'GOOD' ELSE 'COST' END AS verdict
    FROM decided a JOIN decided b ON a.provision_id = b.provision_id AND a.char_offset = b.char_offset
      AND a.pattern = 'current' AND b.pattern = 'tempered' WHERE a.fired <> b.fired""",
)
def decision_changes(spark, sf_dir):
    return audits.decision_changes(_decided(spark, sf_dir), "current", "tempered")


SAMPLED = STAND_IN.markers[2]


def _sampling_pools(spark, sf_dir):
    """v1 is the English part of v2: the hits of both come from one reading of the texts, their candidates from another,
    and each pool is ranked by itself."""
    texts = provisions(spark, sf_dir)
    found = markers.hits("text", STAND_IN, [SAMPLED])
    hits = texts.select("provision_id", "chapter", F.explode(found).alias("h")).select("provision_id", "chapter", "h.*")
    hits = stable(hits)
    candidates = stable(shortlist.candidates(texts, STAND_IN, keep=["chapter"]))

    def pool(part):
        return part(hits).drop("chapter"), shortlist.ranked(part(candidates).drop("chapter"))

    return {"v1": pool(lambda rows: rows.where(F.col("chapter") == "en")), "v2": pool(lambda rows: rows)}


_DRAW = f"sha256('{SEED}|' || provision_id || '|' || char_offset || '|' || matched_span)"


@registry.add(
    "stratified_sample",
    f"""WITH {sql.candidates()}, ranks_v1 AS (
      SELECT c.provision_id, row_number() OVER (ORDER BY score DESC, c.char_count, c.provision_id) AS rank
      FROM candidates c JOIN provisions p USING (provision_id) WHERE p.chapter = 'en'),
    pooled AS (SELECT h.provision_id, h.char_offset, h.matched_span, p.chapter = 'en' AS in_v1, a.rank AS r1,
        b.rank AS r2, regexp_matches(h.matched_span, {sql.quoted(STAND_IN.clause_boundary)}) AND p.chapter = 'en' AS defective
      FROM hits h JOIN provisions p USING (provision_id) LEFT JOIN ranks_v1 a USING (provision_id)
      LEFT JOIN candidates b USING (provision_id) WHERE h.marker = 'and that'),
    drawn AS (SELECT *, {_DRAW} AS draw, NOT defective AND (coalesce(r1, 1e18) <= 50 OR coalesce(r2, 1e18) <= 50) AS is_top
      FROM pooled),
    tops AS (SELECT provision_id, arg_min(char_offset, draw) AS char_offset FROM drawn WHERE is_top GROUP BY 1),
    strata AS (SELECT d.*, CASE WHEN defective THEN 'known-defective-v1'
        WHEN t.provision_id IS NOT NULL THEN 'top-50-ranked' END AS reason
      FROM drawn d LEFT JOIN tops t ON t.provision_id = d.provision_id AND t.char_offset = d.char_offset)
    SELECT provision_id, char_offset, matched_span, reason AS selection_reason FROM strata WHERE reason IS NOT NULL
    UNION ALL SELECT provision_id, char_offset, matched_span, 'random-seed-{SEED}' FROM (
      SELECT *, row_number() OVER (ORDER BY draw, provision_id, char_offset) AS n FROM strata WHERE reason IS NULL) f
    WHERE n <= 120 - (SELECT count(*) FROM strata WHERE reason IS NOT NULL)""",
)
def stratified_sample(spark, sf_dir):
    pools = _sampling_pools(spark, sf_dir)
    return audits.stratified_sample(
        audits.pooled_hits(pools), list(pools), STAND_IN.clause_boundary, size=120, seed=SEED
    )


@registry.add(
    "span_layers",
    f"""WITH {sql.PROVISIONS},{sql.hits()}, edges AS (
      SELECT provision_id, 0 AS edge FROM provisions UNION SELECT provision_id, char_count FROM provisions
      UNION SELECT provision_id, char_offset FROM hits UNION SELECT provision_id, char_end FROM hits),
    pieces AS (SELECT *, row_number() OVER w - 1 AS piece, lead(edge) OVER w AS "end" FROM edges
      WINDOW w AS (PARTITION BY provision_id ORDER BY edge)),
    seqs AS (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY char_offset, char_end DESC, position) AS seq FROM hits)
    SELECT p.provision_id, p.piece::INT AS piece, p.edge::INT AS start, p."end"::INT AS "end",
      any_value(substring(t.text, p.edge + 1, p."end" - p.edge)) AS piece_text,
      coalesce(string_agg(h.category || ':' || h.marker, ', ' ORDER BY h.seq), '') AS covering,
      arg_min(h.category, (h.char_end - h.char_offset) * 1000000 + h.seq) AS narrowest
    FROM pieces p JOIN provisions t USING (provision_id)
    LEFT JOIN seqs h ON h.provision_id = p.provision_id AND h.char_offset <= p.edge AND h.char_end >= p."end"
    WHERE p."end" IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def span_layers(spark, sf_dir):
    return markers.layer_spans(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "provision_dossiers",
    f"""WITH {sql.candidates()},{sql.hits_of(_OPENER, "openers")}, spans AS (
      SELECT provision_id, string_agg(category || ':' || marker || '@' || char_offset || '-' || char_end, '|'
        ORDER BY char_offset, char_end DESC, position) AS marker_spans, count(*) AS n FROM hits GROUP BY 1),
    quals AS (SELECT provision_id, count(*) AS n FROM clauses GROUP BY 1),
    ceil AS (SELECT provision_id, count(*) AS n FROM openers
      WHERE regexp_matches({_WINDOW}, {sql.quoted(STAND_IN.ceiling_bound)}) GROUP BY 1)
    SELECT p.provision_id, coalesce(s.marker_spans, '') AS marker_spans, coalesce(q.n, 0)::INT AS qualifier_clauses,
      {sql.text_rung(column="p.text")} AS determinacy, coalesce(r.qualifier_determinacy, 'unmarked') AS qualifier_determinacy,
      c.score_d AS score, c.rank, c.rank IS NOT NULL AS is_candidate, coalesce(f.n, 0)::INT AS ceiling_flags,
      coalesce(s.n, 0)::INT AS hit_rows
    FROM provisions p LEFT JOIN spans s USING (provision_id) LEFT JOIN quals q USING (provision_id)
    LEFT JOIN ceil f USING (provision_id) LEFT JOIN clause_rungs r USING (provision_id)
    LEFT JOIN candidates c USING (provision_id)""",
)
def provision_dossiers(spark, sf_dir):
    texts = provisions(spark, sf_dir)
    span = lambda h: F.concat(h["category"], F.lit(":"), h["marker"], F.lit("@"), h["char_offset"], F.lit("-"), h["char_end"])
    digest = {c: F.col(c) for c in shortlist.CANDIDATE_COLUMNS if c != "provision_id"} | {
        "marker_spans": F.array_join(F.transform("marker_spans", span), "|"),
        "qualifier_clauses": F.size("qualifier_clauses"),
        "ceiling_flags": F.size("ceiling_flags"),
    }
    wide = dossier(texts, lambda graded: shortlist.shortlist(graded, STAND_IN, graded=True), STAND_IN, digest)
    return wide.select(
        "provision_id",
        "marker_spans",
        "qualifier_clauses",
        "determinacy",
        "qualifier_determinacy",
        "score",
        "rank",
        "is_candidate",
        "ceiling_flags",
        F.col("table_rows.marker_hits").alias("hit_rows"),
    )


@registry.add(
    "merged_pools",
    f"""WITH {sql.PROVISIONS} SELECT provision_id, CASE WHEN chapter = 'en' THEN 'v1' ELSE 'v2' END AS pool, char_count
    FROM provisions""",
)
def merged_pools(spark, sf_dir):
    """v1 is the English part of v2, so every English row must come from v1."""
    texts = provisions(spark, sf_dir).select("provision_id", "chapter", "char_count")
    first = texts.where(F.col("chapter") == "en").withColumn("pool", F.lit("v1"))
    merged = audits.merge_pools(first, texts.withColumn("pool", F.lit("v2")))
    return merged.select("provision_id", "pool", "char_count")


@registry.add(
    "keyword_in_context",
    f"""WITH {sql.PROVISIONS},{sql.hits()} SELECT provision_id, marker, char_offset,
      replace(substring(text, greatest(char_offset - 45, 0) + 1, char_end + 45 - greatest(char_offset - 45, 0)), chr(10), ' ') AS context
    FROM hits""",
)
def keyword_in_context(spark, sf_dir):
    found = markers.marker_hits(provisions(spark, sf_dir), STAND_IN, ["provision_id", "text"])
    return markers.kwic(found, 45).select("provision_id", "marker", "char_offset", "context")


@registry.add(
    "adjudicated_rungs",
    f"""WITH {sql.candidates()} SELECT c.provision_id, c.qualifier_determinacy AS computed,
      CASE WHEN quality = 1 THEN 'specific' ELSE 'unmarked' END AS hand_rung,
      CASE WHEN c.qualifier_determinacy = (CASE WHEN quality = 1 THEN 'specific' ELSE 'unmarked' END)
        THEN 'agrees' ELSE 'disagrees' END AS agreement
    FROM candidates c JOIN labels l ON c.document_id = 'doc-' || l.doc_id""",
)
def adjudicated_rungs(spark, sf_dir):
    found = shortlist.candidates(provisions(spark, sf_dir), STAND_IN, keep=["document_id"])
    hand = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"),
        F.when(F.col("quality") == 1, "specific").otherwise("unmarked").alias("hand_rung"),
    )
    hand = found.select("provision_id", "document_id").join(hand, "document_id").select("provision_id", "hand_rung")
    return audits.adjudicate(found, hand)
