"""Registered queries: gold tables, analytic queries and corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext.lexicon import markers_table
from normtext.operators import gold, markers, profile, shortlist
from normtext.plans import sql_parts as sql
from normtext.plans.bindings import STAND_IN, documents, provisions
from normtext.plans.registry import Registry
from normtext.session import shared_path
from normtext.sources.text_index import build_text_index
from normtext.sources.text_index import text_search as find_phrase

registry = Registry()
CANDIDATES = f"WITH {sql.candidates()}"
WITH_HITS = f"WITH {sql.PROVISIONS},{sql.hits()}"


def _candidates(spark, sf_dir, keep=("document_id", "document_title", "label")):
    return shortlist.candidates(provisions(spark, sf_dir), STAND_IN, keep=keep)


def _ranked(spark, sf_dir, keep=("document_id", "document_title", "label")):
    return shortlist.ranked(_candidates(spark, sf_dir, keep))


def _hits(spark, sf_dir):
    return markers.marker_hits(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "provision_summary",
    f"""WITH {sql.PROVISIONS} SELECT document_id, document_title, document_version, chapter, heading,
      count(DISTINCT provision_id) AS provision_count, min("order") AS first_order, max("order") AS last_order,
      min(char_count) AS min_text_chars, round(avg(char_count), 1) AS average_text_chars, max(char_count) AS max_text_chars
    FROM provisions GROUP BY 1, 2, 3, 4, 5""",
)
def provision_summary(spark, sf_dir):
    return gold.provision_summary(provisions(spark, sf_dir)).drop("document_snapshot_id", "kind")


def blank_line_documents(spark, sf_dir):
    """Whole documents as provisions, their lines set apart as blank-line blocks."""
    return documents(spark, sf_dir).select(
        F.col("document_id").alias("provision_id"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
        F.col("title").alias("document_title"),
        F.col("lang").alias("chapter"),
        F.col("title").alias("heading"),
        F.col("document_id").alias("label"),
    )


CHUNK_SQL = r"""
blocks AS MATERIALIZED (
  SELECT provision_id, context, text, 2000 - length(context) - 2 AS room, string_split(text, chr(10) || chr(10)) AS parts
  FROM (SELECT 'doc-' || doc_id AS provision_id, source || chr(10) || lang || chr(10) || 'doc-' || doc_id AS context,
          replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents) d),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN text = '' THEN 'no text'
    WHEN length(text) > room AND list_max([length(p) for p in parts]) > room THEN 'block exceeds the limit' END AS reason
  FROM blocks),
walk AS MATERIALIZED (SELECT provision_id, parts, room FROM judged WHERE reason IS NULL AND length(text) > room),
packed AS (
  WITH RECURSIVE step AS (
    SELECT provision_id, 1 AS i, length(parts[1]) AS size, 1 AS part FROM walk
    UNION ALL
    SELECT s.provision_id, s.i + 1,
      CASE WHEN s.size > 0 AND s.size + 2 + length(w.parts[s.i + 1]) <= w.room
           THEN s.size + 2 + length(w.parts[s.i + 1]) ELSE length(w.parts[s.i + 1]) END,
      CASE WHEN s.size > 0 AND s.size + 2 + length(w.parts[s.i + 1]) > w.room THEN s.part + 1 ELSE s.part END
    FROM step s JOIN walk w USING (provision_id) WHERE s.i < len(w.parts))
  SELECT * FROM step),
contents AS (
  SELECT p.provision_id, p.part, string_agg(w.parts[p.i], chr(10) || chr(10) ORDER BY p.i) AS content
  FROM packed p JOIN walk w USING (provision_id) GROUP BY 1, 2
  UNION ALL SELECT provision_id, 1, text FROM judged WHERE reason IS NULL AND length(text) <= room),
whole AS (SELECT provision_id, string_agg(content, chr(10) || chr(10) ORDER BY part) AS rebuilt, count(*) AS n
  FROM contents GROUP BY 1),
final AS (SELECT j.provision_id, j.context, coalesce(j.reason, CASE WHEN w.rebuilt <> j.text THEN 'text not preserved' END) AS reason, w.n
  FROM judged j LEFT JOIN whole w USING (provision_id))"""


@registry.add(
    "retrieval_chunks",
    f"""WITH {CHUNK_SQL} SELECT c.provision_id || ':chunk-' || lpad(c.part::VARCHAR, greatest(2, length(c.part::VARCHAR))::INT, '0') AS chunk_id,
      c.provision_id, c.part::INT AS part, f.n::INT AS part_count, sha256(c.content) AS chunk_text_sha256,
      length(c.content)::INT AS content_char_count,
      length(f.context || chr(10) || chr(10) || c.content)::INT AS retrieval_char_count,
      strlen(f.context || chr(10) || chr(10) || c.content)::INT AS retrieval_byte_count
    FROM contents c JOIN final f USING (provision_id) WHERE f.reason IS NULL""",
)
def retrieval_chunks(spark, sf_dir):
    chunks, _ = gold.retrieval_chunks(blank_line_documents(spark, sf_dir))
    return chunks.select(
        "chunk_id", "provision_id", "part", "part_count", "chunk_text_sha256", "content_char_count",
        "retrieval_char_count", "retrieval_byte_count",
    )


@registry.add(
    "unpackable_provisions",
    f"WITH {CHUNK_SQL} SELECT provision_id, reason FROM final WHERE reason IS NOT NULL",
)
def unpackable_provisions(spark, sf_dir):
    return gold.retrieval_chunks(blank_line_documents(spark, sf_dir))[1]


@registry.add(
    "candidates_per_document",
    f"""{CANDIDATES} SELECT document_id, any_value(document_title) AS title, count(*) AS candidates
    FROM candidates GROUP BY document_id ORDER BY candidates DESC, document_id""",
)
def candidates_per_document(spark, sf_dir):
    return gold.candidates_per_document(_candidates(spark, sf_dir))


@registry.add(
    "determinacy_distribution",
    f"""{CANDIDATES} SELECT determinacy, count(*) AS candidates, round(avg(score), 1) AS mean_score,
      round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM candidates GROUP BY determinacy""",
)
def determinacy_distribution(spark, sf_dir):
    return gold.determinacy_distribution(_candidates(spark, sf_dir))


@registry.add(
    "marker_frequency",
    f"""{WITH_HITS}, markers(category, marker, weight) AS (VALUES {", ".join(f"({sql.lit(m.category)}, {sql.lit(m.marker)}, {m.weight})" for m in STAND_IN.markers)})
    SELECT m.category, m.marker, m.weight, count(h.provision_id) AS hits, count(DISTINCT h.provision_id) AS provisions,
      round(count(DISTINCT h.provision_id) / (SELECT count(*) FROM provisions), 3) AS corpus_share,
      round(count(DISTINCT h.provision_id) / (SELECT count(*) FROM provisions), 3) > 0.25 AS broad
    FROM markers m LEFT JOIN hits h ON h.category = m.category AND h.marker = m.marker GROUP BY ALL""",
)
def marker_frequency(spark, sf_dir):
    return gold.marker_frequency(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "short_checkable",
    f"""{CANDIDATES} SELECT rank, provision_id, label, char_count, exception_marker, qualifier_marker FROM candidates
    WHERE determinacy = 'specific' AND char_count < 300""",
)
def short_checkable(spark, sf_dir):
    return gold.short_checkable(_ranked(spark, sf_dir))


@registry.add(
    "near_misses",
    f"""{WITH_HITS}, parts AS (SELECT provision_id, count(*) FILTER (category = 'duty') > 0 AS d,
      count(*) FILTER (category = 'exception') > 0 AS e, count(*) FILTER (category = 'qualifier') > 0 AS q
      FROM hits GROUP BY provision_id)
    SELECT p.provision_id, p.label, p.char_count, p.document_title FROM parts JOIN provisions p USING (provision_id)
    WHERE d AND e AND NOT q""",
)
def near_misses(spark, sf_dir):
    return gold.near_misses(provisions(spark, sf_dir), STAND_IN)


@registry.add(
    "documents_without_candidates",
    f"""{CANDIDATES} SELECT document_id, any_value(document_title) AS title, count(*) AS provisions FROM provisions
    WHERE document_id NOT IN (SELECT DISTINCT document_id FROM candidates) GROUP BY document_id""",
)
def documents_without_candidates(spark, sf_dir):
    return gold.documents_without_candidates(provisions(spark, sf_dir), _candidates(spark, sf_dir))


@registry.add(
    "exception_payoff",
    f"""{CANDIDATES} SELECT exception_marker, count(*) AS candidates, count(*) FILTER (determinacy = 'specific') AS specific,
      round(avg(score), 1) AS avg_score, round(avg(char_count), 0) AS avg_chars
    FROM candidates GROUP BY exception_marker HAVING count(*) >= 5""",
)
def exception_payoff(spark, sf_dir):
    return gold.exception_payoff(_candidates(spark, sf_dir))


@registry.add(
    "best_specimens",
    f"""{CANDIDATES} SELECT document_id, any_value(document_title) AS title, min(rank) AS best_rank,
      arg_min(provision_id, rank) AS provision_id, arg_min(determinacy, rank) AS determinacy
    FROM candidates GROUP BY document_id""",
)
def best_specimens(spark, sf_dir):
    return gold.best_specimens(_ranked(spark, sf_dir))


@registry.add(
    "top_candidates",
    f"""{CANDIDATES} SELECT rank, provision_id, score_d AS score, determinacy, duty_marker, exception_marker,
      qualifier_marker, document_title, substring(text, 1, 120) AS text_start FROM candidates ORDER BY rank LIMIT 10""",
)
def top_candidates(spark, sf_dir):
    with_start = provisions(spark, sf_dir).withColumn("text_start", F.substring("text", 1, 120))
    found = shortlist.candidates(with_start, STAND_IN, keep=["document_title", "text_start"])
    return gold.top_candidates(found)


@registry.add(
    "text_search",
    f"""WITH {sql.PROVISIONS} SELECT provision_id, document_title, substring(text, 1, 150) AS extract
    FROM provisions WHERE text ILIKE '%of the%'""",
)
def text_search(spark, sf_dir):
    """All provisions indexed by trigrams, then one phrase looked up in the postings."""
    path = shared_path(spark, "text-index")
    build_text_index(provisions(spark, sf_dir), path)
    return find_phrase(spark, path, "of the")


@registry.add(
    "determinacy_cross_count",
    f"{CANDIDATES} SELECT determinacy, qualifier_determinacy, count(*) AS candidates FROM candidates GROUP BY 1, 2",
)
def determinacy_cross_count(spark, sf_dir):
    return gold.determinacy_cross_count(_candidates(spark, sf_dir))


@registry.add(
    "length_profile",
    f"""WITH {sql.PROVISIONS} SELECT count(*) AS count, round(avg(char_count), 4) AS mean, round(stddev_samp(char_count), 4) AS std,
      min(char_count) AS min, max(char_count) AS max,
      {", ".join(f"round(quantile_cont(char_count, {q}), 4) AS {n}" for n, q in profile.PERCENTILES.items())},
      round(avg((char_count < 120)::INT), 6) AS share_short FROM provisions""",
)
def length_profile(spark, sf_dir):
    return profile.length_profile(provisions(spark, sf_dir))


@registry.add(
    "provisions_per_document",
    f"""WITH {sql.PROVISIONS} SELECT document_id, document_title, count(*) AS provisions, sum(char_count)::BIGINT AS chars
    FROM provisions GROUP BY 1, 2""",
)
def provisions_per_document(spark, sf_dir):
    return profile.per_document(provisions(spark, sf_dir))


@registry.add(
    "concentration",
    f"""WITH {sql.PROVISIONS}, per AS (SELECT document_id, count(*) AS n FROM provisions GROUP BY 1)
    SELECT count(*) AS documents, sum(n)::BIGINT AS provisions,
      (SELECT sum(n)::BIGINT FROM (SELECT n FROM per ORDER BY n DESC LIMIT 5) t) AS held,
      round((SELECT sum(n) FROM (SELECT n FROM per ORDER BY n DESC LIMIT 5) t) / sum(n), 6) AS top_share FROM per""",
)
def concentration(spark, sf_dir):
    return profile.concentration(provisions(spark, sf_dir))


@registry.add(
    "structure_profile",
    f"""WITH {sql.PROVISIONS} SELECT 'paragraph' AS kind, count(*) AS provisions,
      count(*) FILTER (trim(chapter) <> '') AS with_chapter, count(*) FILTER (trim(chapter) = '') AS without_chapter,
      count(*) FILTER (trim(heading) <> '') AS with_heading, count(DISTINCT heading) AS distinct_headings FROM provisions""",
)
def structure_profile(spark, sf_dir):
    return profile.structure_profile(provisions(spark, sf_dir))


@registry.add(
    "top_headings",
    f"""WITH {sql.PROVISIONS} SELECT heading, count(*) AS provisions FROM provisions GROUP BY 1
    ORDER BY provisions DESC, heading LIMIT 12""",
)
def top_headings(spark, sf_dir):
    return profile.top_headings(provisions(spark, sf_dir))


@registry.add(
    "table_counts",
    f"""{CANDIDATES} SELECT 'provisions' AS table_name, count(*) AS rows FROM provisions
    UNION ALL SELECT 'candidates', count(*) FROM candidates UNION ALL SELECT 'marker_hits', count(*) FROM hits
    UNION ALL SELECT 'markers', {len(STAND_IN.markers)}""",
)
def table_counts(spark, sf_dir):
    return profile.table_counts(
        {
            "provisions": provisions(spark, sf_dir),
            "candidates": _candidates(spark, sf_dir),
            "marker_hits": _hits(spark, sf_dir),
            "markers": markers_table(spark, STAND_IN),
        }
    )


@registry.add(
    "length_position",
    f"""{CANDIDATES}, lengths AS (SELECT char_count, sum(count(*)) OVER (ORDER BY char_count) - count(*) AS below
      FROM provisions GROUP BY char_count)
    SELECT c.provision_id, c.char_count, round(below / (SELECT count(*) FROM provisions), 6) AS share_shorter
    FROM candidates c JOIN lengths USING (char_count)""",
)
def length_position(spark, sf_dir):
    return profile.length_position(provisions(spark, sf_dir), _candidates(spark, sf_dir))


_FLAGGED = f"""WITH {sql.PROVISIONS},{sql.fired()}, flags AS (
  SELECT p.provision_id, p.char_count, p.text, coalesce(bool_or(category = 'duty'), false) AS duty,
    coalesce(bool_or(category = 'exception'), false) AS exception,
    coalesce(bool_or(category = 'qualifier'), false) AS qualifier
  FROM provisions p LEFT JOIN fired f USING (provision_id) GROUP BY ALL)"""


@registry.add(
    "category_patterns",
    f"""{_FLAGGED} SELECT coalesce(nullif(concat_ws(' + ', CASE WHEN duty THEN 'duty' END,
        CASE WHEN exception THEN 'exception' END, CASE WHEN qualifier THEN 'qualifier' END), ''), '(none)') AS pattern,
      count(*) AS provisions, round(count(*) / (SELECT count(*) FROM provisions), 3) AS share FROM flags GROUP BY 1""",
)
def category_patterns(spark, sf_dir):
    return profile.category_patterns(profile.with_categories(provisions(spark, sf_dir), STAND_IN))


@registry.add(
    "co_occurrence",
    f"""{_FLAGGED}, long AS (SELECT provision_id, category FROM fired GROUP BY 1, 2),
    single AS (SELECT category, count(*) AS n FROM long GROUP BY 1)
    SELECT a.category AS left_category, b.category AS right_category, count(*) AS provisions,
      round(count(*) * (SELECT count(*) FROM provisions)
        / (any_value(x.n) * any_value(y.n)), 4) AS lift
    FROM long a JOIN long b USING (provision_id) JOIN single x ON x.category = a.category
    JOIN single y ON y.category = b.category GROUP BY 1, 2""",
)
def co_occurrence(spark, sf_dir):
    return profile.co_occurrence(profile.with_categories(provisions(spark, sf_dir), STAND_IN))


_COUNTED = f"""{WITH_HITS}, counted AS (SELECT p.provision_id, p.char_count, count(h.marker) AS hits
  FROM provisions p LEFT JOIN hits h USING (provision_id) GROUP BY ALL)"""


@registry.add(
    "hit_length_correlation",
    f"""{_COUNTED}, ranks AS (SELECT *, rank() OVER (ORDER BY hits) + (count(*) OVER (PARTITION BY hits) - 1) / 2 AS rh,
      rank() OVER (ORDER BY char_count) + (count(*) OVER (PARTITION BY char_count) - 1) / 2 AS rc FROM counted)
    SELECT round(corr(hits, char_count), 6) AS pearson, round(corr(rh, rc), 6) AS spearman FROM ranks""",
)
def hit_length_correlation(spark, sf_dir):
    return profile.correlations(profile.with_hit_count(provisions(spark, sf_dir), STAND_IN), "hits", "char_count")


@registry.add(
    "score_length_correlation",
    f"""{CANDIDATES}, ranks AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs,
      rank() OVER (ORDER BY char_count) + (count(*) OVER (PARTITION BY char_count) - 1) / 2 AS rc FROM (SELECT score, char_count FROM candidates) c)
    SELECT round(corr(score, char_count), 6) AS pearson, round(corr(rs, rc), 6) AS spearman FROM ranks""",
)
def score_length_correlation(spark, sf_dir):
    return profile.correlations(_candidates(spark, sf_dir), "score", "char_count")


@registry.add(
    "hits_by_length",
    f"""{_COUNTED} SELECT CASE WHEN char_count <= 150 THEN '<150' WHEN char_count <= 300 THEN '150-300'
        WHEN char_count <= 600 THEN '300-600' WHEN char_count <= 1200 THEN '600-1200' ELSE '>1200' END AS bucket,
      count(*) AS provisions, round(avg(hits), 2) AS mean_hits, round(avg((hits > 0)::INT), 2) AS share_with_any
    FROM counted GROUP BY 1""",
)
def hits_by_length(spark, sf_dir):
    return profile.hits_by_length(profile.with_hit_count(provisions(spark, sf_dir), STAND_IN))


@registry.add(
    "double_counting",
    f"""{WITH_HITS} SELECT provision_id, category, count(*) AS hits, count(DISTINCT marker) AS distinct_markers FROM hits
    GROUP BY 1, 2 HAVING count(*) > count(DISTINCT marker) OR count(DISTINCT marker) > 1""",
)
def double_counting(spark, sf_dir):
    return profile.double_counting(provisions(spark, sf_dir), STAND_IN)


BAND = {"has_that": r"\bthat\b", "has_and_that": r"\band that\b", "has_the": r"\bthe\b", "has_with_the": r"\bwith the\b"}


@registry.add(
    "band_comparison",
    f"""{_FLAGGED} SELECT duty AND exception AND qualifier AS is_candidate, count(*) AS provisions,
      {", ".join(f"round(avg(regexp_matches(text, {sql.quoted(p)})::INT), 3) AS {n}" for n, p in BAND.items())}
    FROM flags WHERE char_count BETWEEN 250 AND 600 GROUP BY 1""",
)
def band_comparison(spark, sf_dir):
    return profile.band_comparison(profile.with_categories(provisions(spark, sf_dir), STAND_IN), BAND)


@registry.add(
    "source_spread",
    f"""{CANDIDATES} SELECT document_title, count(*) AS candidates, min(rank) AS best_rank,
      count(DISTINCT CASE WHEN rank <= 50 THEN document_id END) AS documents_in_top_50 FROM candidates GROUP BY 1""",
)
def source_spread(spark, sf_dir):
    return profile.source_spread(_ranked(spark, sf_dir))


def _pool_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS pool, (SELECT count(*) FROM provisions p WHERE {where}) AS provisions, count(*) AS candidates,
      round(count(*) / (SELECT count(*) FROM provisions p WHERE {where}), 4) AS candidate_rate,
      quantile_cont(c.score_d, 0.5) AS median_score, round(avg((c.determinacy = 'specific')::INT), 3) AS specific_share
    FROM candidates c JOIN provisions p USING (provision_id) WHERE {where}"""


@registry.add("pool_comparison", f"{CANDIDATES} {_pool_sql('v1', "p.chapter = 'en'")} UNION ALL {_pool_sql('v2', 'true')}")
def pool_comparison(spark, sf_dir):
    texts = provisions(spark, sf_dir)
    first = texts.where(F.col("chapter") == "en")
    return profile.pool_comparison(
        {"v1": (first, shortlist.candidates(first, STAND_IN)), "v2": (texts, shortlist.candidates(texts, STAND_IN))}
    )
