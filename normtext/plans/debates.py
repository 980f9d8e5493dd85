"""Registered queries: debate screens, votes and positions.

Conversations are debates (role = party, turn = speech), events are votes and
orders are motions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext.operators import debate
from normtext.plans import sql_parts as sql
from normtext.plans.bindings import table
from normtext.plans.registry import Registry

registry = Registry()

CUES = debate.Cues(
    claim=r"\b(?:the|of)\b[^.]{0,60}\b(?:that|with)\b",
    topic=r"\bthat\s+the\b",
    tighten=r"\b(?:with|by)\b",
    loosen=r"\b(?:are|is)\b",
    legal_object=r"\bthe\b",
    own_proposal=r"\bof\b",
    attribution=r"\bwas\b",
    party_names={"USER": r"\bfor\b", "ASSISTANT": r"\bto\b", "SYSTEM": r"\bit\b"},
    harmonised={"HUMAN": "USER"},
    roles_dropped=("", "-", "SYSTEM"),
)
PARTIES = list(CUES.party_names)


def speeches(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("s"), (F.col("conv_id") % 2).cast("string")).alias("session"),
        F.concat(F.lit("Debate   "), (F.col("conv_id") % 40).cast("string")).alias("debate_title"),
        F.upper(F.col("role")).alias("party"),
        F.concat(F.lit("speaker-"), F.col("turn").cast("string")).alias("speaker"),
        F.concat(F.lit("http://debate.example/"), F.col("conv_id").cast("string")).alias("source_url"),
        F.col("text").alias("speech_text"),
    )


_SPEECHES = """
speeches AS MATERIALIZED (SELECT conv_id, turn, 's' || (conv_id % 2) AS session, 'Debate   ' || (conv_id % 40) AS debate_title,
  upper(role) AS party, 'speaker-' || turn AS speaker, 'http://debate.example/' || conv_id AS source_url, text AS speech_text
  FROM conversations)"""


def _sentence(start: str, cap: int) -> str:
    after = f"substring(speech_text, {start} + 1)"
    return (
        f"trim(regexp_replace(regexp_extract(substring(speech_text, 1, {start}), '[^.]*$') || CASE WHEN strpos({after}, '.') > 0"
        f" THEN substring({after}, 1, strpos({after}, '.')) ELSE substring({after}, 1, {cap}) END, '\\s+', ' ', 'g'))"
    )


def _cue(direction: str, pattern: str) -> str:
    return f"""SELECT party, debate_title AS issue, session, speaker, source_url, conv_id, turn, '{direction}' AS direction,
      lower(regexp_extract(speech_text, {sql.quoted(pattern)})) AS cue, {_sentence("start", 160)} AS sentence
    FROM (SELECT *, length(string_split_regex(speech_text, {sql.quoted(pattern)})[1]) AS start FROM speeches
      WHERE regexp_matches(speech_text, {sql.quoted(pattern)}) AND party <> 'SYSTEM') s"""


_HITS = f"""{_SPEECHES},
hits AS MATERIALIZED ({_cue("tightening", CUES.tighten)} UNION ALL {_cue("loosening", CUES.loosen)})"""


def _hits(spark, sf_dir):
    return debate.cue_hits(speeches(spark, sf_dir), CUES, keep=["conv_id", "turn"])


@registry.add(
    "claim_eligibility",
    f"""WITH {_SPEECHES} SELECT count(*) AS speeches, count(*) FILTER (regexp_matches(speech_text, {sql.quoted(CUES.claim)})) AS deontic_claims,
      round(100.0 * count(*) FILTER (regexp_matches(speech_text, {sql.quoted(CUES.claim)})) / count(*), 1) AS share_pct,
      count(DISTINCT debate_title) FILTER (regexp_matches(speech_text, {sql.quoted(CUES.topic)})) AS topic_debates FROM speeches""",
)
def claim_eligibility(spark, sf_dir):
    return debate.eligibility(speeches(spark, sf_dir), CUES)


@registry.add("cue_hits", f"WITH {_HITS} SELECT * FROM hits")
def cue_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@registry.add(
    "party_summary",
    f"""WITH {_HITS}, per AS (SELECT party, count(DISTINCT issue || '|' || session) FILTER (direction = 'tightening') AS t,
      count(DISTINCT issue || '|' || session) FILTER (direction = 'loosening') AS l FROM hits GROUP BY 1)
    SELECT party, t AS tighten_debates, l AS loosen_debates, t - l AS net, round(100.0 * l / (t + l), 1) AS loosen_share_pct,
      CASE WHEN t > l THEN 'tightening' WHEN l > t THEN 'loosening' ELSE 'even' END AS lean FROM per""",
)
def party_summary(spark, sf_dir):
    return debate.party_summary(_hits(spark, sf_dir))


@registry.add(
    "issue_summary",
    f"""WITH {_HITS}, top AS (SELECT issue, count(*) AS total_hits FROM hits GROUP BY 1 ORDER BY total_hits DESC, issue LIMIT 20)
    SELECT h.issue, h.party, t.total_hits, count(*) FILTER (direction = 'tightening') AS tightening,
      count(*) FILTER (direction = 'loosening') AS loosening,
      arg_min(sentence, conv_id * 1000 + turn) FILTER (direction = 'tightening') AS tightening_example,
      arg_min(sentence, conv_id * 1000 + turn) FILTER (direction = 'loosening') AS loosening_example
    FROM hits h JOIN top t USING (issue) GROUP BY ALL""",
)
def issue_summary(spark, sf_dir):
    return debate.issue_summary(_hits(spark, sf_dir), ["conv_id", "turn"], top=20)


POSITIONS = ["Ja", "Nej", "Avstår", "Frånvarande"]


def votes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    party = (
        F.when(F.col("event_type") == "view", "USER")
        .when(F.col("event_type") == "click", "ASSISTANT")
        .when(F.col("event_type") == "signup", "SYSTEM")
        .otherwise("OTHER")
    )
    matter = (F.col("user_id") % 60).cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("s0").alias("session"),
        F.concat(F.lit("D"), matter).alias("designation"),
        F.concat(F.lit(" DEBATE "), matter).alias("title"),
        F.concat(F.lit("vote-"), F.col("user_id").cast("string")).alias("vote_id"),
        (k % 10).alias("point"),
        party.alias("party"),
        F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), k % 4 + 1).alias("party_position"),
        F.concat(F.lit("http://votes.example/"), F.col("event_id").cast("string")).alias("source_url"),
    )


_VOTES = f"""
votes AS MATERIALIZED (SELECT event_id, 's0' AS session, 'D' || (user_id % 60) AS designation, 'debate ' || (user_id % 60) AS title_key,
  'vote-' || user_id AS vote_id, k % 10 AS point,
  CASE event_type WHEN 'view' THEN 'USER' WHEN 'click' THEN 'ASSISTANT' WHEN 'signup' THEN 'SYSTEM' ELSE 'OTHER' END AS party,
  ({POSITIONS})[k % 4 + 1] AS party_position, 'http://votes.example/' || event_id AS source_url
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events) e)"""

_POSITIONS = f"""{_VOTES},
counts AS (SELECT session, designation, title_key, party, party_position, count(*) AS n, min(event_id) AS first FROM votes
  WHERE party <> 'OTHER' GROUP BY ALL),
positions AS MATERIALIZED (
  SELECT c.session, c.designation, c.title_key, c.party, arg_max(party_position, n * 1000000000 - first) AS position,
    string_agg(party_position || '=' || n, '|' ORDER BY party_position) AS distribution,
    any_value(p.points) AS points, any_value(p.vote_url) AS vote_url
  FROM counts c JOIN (SELECT session, designation, title_key, party, count(DISTINCT point) AS points, arg_max(source_url, event_id) AS vote_url
    FROM votes GROUP BY ALL) p ON p.designation = c.designation AND p.party = c.party GROUP BY ALL)"""


def _positions(spark, sf_dir):
    return debate.vote_positions(votes(spark, sf_dir), ["event_id"], PARTIES)


@registry.add("vote_positions", f"WITH {_POSITIONS} SELECT * FROM positions")
def vote_positions(spark, sf_dir):
    entries = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return _positions(spark, sf_dir).withColumn("distribution", F.array_join(entries, "|"))


@registry.add(
    "law_references",
    f"""WITH {_VOTES}, linked AS (SELECT vote_id, max(designation) AS designation FROM votes GROUP BY 1),
    labelled AS (SELECT l.designation, o_orderkey, 'http://motions.example/' || o_orderkey AS url,
      CASE WHEN o_orderkey % 3 = 0 THEN 'prop. 2024/25:' || (o_orderkey % 20) ELSE 'M-' || (o_orderkey % 1000) END AS label
      FROM orders JOIN linked l ON l.vote_id = 'vote-' || o_custkey)
    SELECT designation, label, url, place FROM (SELECT designation, label, arg_min(url, o_orderkey) AS url,
        row_number() OVER (PARTITION BY designation ORDER BY min(o_orderkey))::INT AS place FROM labelled GROUP BY 1, 2) r
    WHERE place <= 6""",
)
def law_references(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    motions = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("vote-"), F.col("o_custkey").cast("string")).alias("vote_id"),
        F.concat(F.lit("M-"), (F.col("o_orderkey") % 1000).cast("string")).alias("motion_reference"),
        F.when(
            F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Om prop. 2024/25:"), (F.col("o_orderkey") % 20).cast("string"))
        ).otherwise(F.col("o_orderpriority")).alias("motion_title"),
        F.concat(F.lit("http://motions.example/"), key).alias("motion_url"),
    )
    return debate.law_refs(votes(spark, sf_dir), motions, ["o_orderkey"])


def _named(pattern: str) -> str:
    return f"regexp_matches(sentence, {sql.quoted(pattern)})"


_OTHERS = " ".join(
    f"WHEN '{p}' THEN {_named('|'.join(v for q, v in CUES.party_names.items() if q != p))}" for p in CUES.party_names
)
_DIRECTIONS = f"""{_SPEECHES},
spoken AS MATERIALIZED (SELECT conv_id || ':' || turn AS provision_id, '' AS document_id, speech_text AS text FROM speeches),
{sql.hits_of([("c", "t", 0, CUES.tighten), ("c", "l", 1, CUES.loosen)], "found", "spoken")},
cells AS MATERIALIZED (
  SELECT *, CASE WHEN {_named(CUES.legal_object)} AND {_named(CUES.own_proposal)} AND NOT {_named(CUES.attribution)}
    AND NOT (CASE party {_OTHERS} ELSE false END) THEN 1 ELSE 0 END AS strong
  FROM (SELECT lower(trim(regexp_replace(debate_title, '\\s+', ' ', 'g'))) AS title_key, party, f.marker AS direction, conv_id, turn,
      f.char_offset AS start, substring({_sentence("f.char_offset", 150)}, 1, 170) AS sentence
    FROM speeches s JOIN (SELECT *, row_number() OVER (PARTITION BY provision_id, marker ORDER BY char_offset) AS n FROM found) f
      ON f.provision_id = s.conv_id || ':' || s.turn AND f.n <= 4) c),
silent AS (SELECT DISTINCT lower(trim(regexp_replace(debate_title, '\\s+', ' ', 'g'))) AS title_key, party FROM speeches),
directions AS MATERIALIZED (
  SELECT z.title_key, z.party, count(*) FILTER (direction = 't' AND strong = 1) AS tighten,
    count(*) FILTER (direction = 't' AND strong = 0) AS tighten_low, count(*) FILTER (direction = 'l' AND strong = 1) AS loosen,
    count(*) FILTER (direction = 'l' AND strong = 0) AS loosen_low,
    arg_min(sentence, (1 - strong)::HUGEINT * 1000000000000000000 + conv_id * 10000000000 + turn * 10000000 + start) FILTER (direction = 't') AS tighten_example,
    arg_min(sentence, (1 - strong)::HUGEINT * 1000000000000000000 + conv_id * 10000000000 + turn * 10000000 + start) FILTER (direction = 'l') AS loosen_example
  FROM silent z LEFT JOIN cells c ON c.title_key = z.title_key AND c.party = z.party GROUP BY 1, 2)"""


def _directions(spark, sf_dir):
    return debate.debate_direction(speeches(spark, sf_dir), ["conv_id", "turn"], CUES)


@registry.add("debate_direction", f"WITH {_DIRECTIONS} SELECT * FROM directions")
def debate_direction(spark, sf_dir):
    found = _directions(spark, sf_dir)
    return found.withColumns(
        {c: F.col(f"{c}.sentence") for c in ("tighten_example", "loosen_example")}
    )


_REPORT = f"""{_DIRECTIONS},{_POSITIONS},
decided AS (SELECT DISTINCT session, designation, title_key FROM positions),
sides AS (SELECT session, designation, title_key, party FROM positions
  UNION SELECT d.session, d.designation, d.title_key, x.party FROM decided d JOIN directions x USING (title_key)),
report AS MATERIALIZED (
  SELECT s.session, s.designation, s.title_key, s.party, p.position, coalesce(x.tighten, 0) AS tighten, coalesce(x.loosen, 0) AS loosen,
    coalesce(x.tighten_low, 0) AS tighten_low, coalesce(x.loosen_low, 0) AS loosen_low,
    s.title_key IN (SELECT title_key FROM directions) AS has_debate, coalesce(x.tighten + x.loosen, 0) > 0 AS argued,
    coalesce(x.tighten + x.loosen, 0) > 0 AND coalesce(p.position IN ('Avstår', 'Frånvarande'), false) AS talk_no_back,
    coalesce(p.position = 'Nej', false) AS dissent
  FROM sides s LEFT JOIN positions p ON p.designation = s.designation AND p.party = s.party
  LEFT JOIN directions x ON x.title_key = s.title_key AND x.party = s.party)"""


def _report(spark, sf_dir):
    return debate.decision_report(_positions(spark, sf_dir), _directions(spark, sf_dir))


@registry.add("decision_report", f"WITH {_REPORT} SELECT * FROM report")
def decision_report(spark, sf_dir):
    return _report(spark, sf_dir)


@registry.add(
    "decision_totals",
    f"""WITH {_REPORT}, per AS (SELECT session, designation, title_key, bool_or(has_debate) AS d, bool_or(talk_no_back) AS c
      FROM report GROUP BY ALL)
    SELECT count(*) AS decisions_total, count(*) FILTER (d) AS decisions_with_debate, count(*) FILTER (c) AS decisions_with_conflict FROM per""",
)
def decision_totals(spark, sf_dir):
    return debate.report_totals(_report(spark, sf_dir))
