"""Registered queries: requirement keywords over documents turned into specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.operators import requirements as req
from normtext.plans.bindings import documents
from normtext.plans.registry import Registry
from normtext.plans.sql_parts import lit

registry = Registry()

OLD = {" with ": " MUST ", " by ": " SHOULD ", " are ": " MAY ", " was ": " MUST NOT "}
NEW = [
    {" with ": " MUST ", " by ": " SHOULD ", " are ": " MAY ", " was ": " MUST NOT "},
    {" with ": " SHOULD ", " by ": " SHALL ", " are ": " MAY ", " was ": " SHALL NOT "},
    {" with ": " MUST ", " by ": " MAY ", " are ": " REQUIRED ", " was ": " by "},
]


def _worded(text, words):
    for word, keyword in words.items():
        text = F.replace(text, F.lit(word), F.lit(keyword))
    return text


def specification(spark, sf_dir, new: bool = False):
    """Documents with keywords for frequent words: even ones in blank-line blocks, odd ones
    as wrapped lines with page lines between them."""
    docs = documents(spark, sf_dir).withColumn("n", F.regexp_extract("document_id", r"\d+", 0).cast("long"))
    text = F.col("text")
    if new:
        worded = F.when(F.col("n") % 3 == 0, _worded(text, NEW[0])).when(F.col("n") % 3 == 1, _worded(text, NEW[1]))
        worded = worded.otherwise(_worded(text, NEW[2]))
    else:
        worded = _worded(text, OLD)
    laid_out = F.when(F.col("n") % 2 == 0, F.replace(worded, F.lit("\n"), F.lit("\n\n"))).otherwise(
        F.replace(worded, F.lit("\n"), F.lit("\nRFC 1234 Rules\n  Body 2001 [Page 3]\n"))
    )
    return docs.select("document_id", "n", F.col("title").alias("family"), laid_out.alias("text"))


def _worded_sql(words: dict) -> str:
    text = "text"
    for word, keyword in words.items():
        text = f"replace({text}, '{word}', '{keyword}')"
    return text


def _spec_sql(name: str, worded: str) -> str:
    keyword = "(?:^|[^\\w])(" + "|".join(fv.REQUIREMENT_KEYWORDS) + ")\\b"
    page = fv.PAGE_LINE
    return f"""
{name}_docs AS (SELECT 'doc-' || doc_id AS document_id, source AS family, doc_id AS n,
  CASE WHEN doc_id % 2 = 0 THEN replace(worded, chr(10), chr(10) || chr(10))
    ELSE replace(worded, chr(10), chr(10) || 'RFC 1234 Rules' || chr(10) || '  Body 2001 [Page 3]' || chr(10)) END AS text
  FROM (SELECT *, {worded} AS worded FROM documents) w),
{name}_blocks AS MATERIALIZED (SELECT document_id, family, n, (b - 1)::INT AS block_no, blocks[b] AS block FROM (
  SELECT *, list_filter([trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in string_split_regex(array_to_string(list_filter(
    [trim(l) for l in string_split(text, chr(10))], lambda l: NOT regexp_matches(l, {lit(page)})), chr(10)), '\\n{{2,}}')],
    lambda x: x <> '') AS blocks FROM {name}_docs) d, unnest(range(1, len(blocks) + 1)) t(b)),
{name}_sentences AS MATERIALIZED (SELECT document_id, family, n, block_no, (s - 1)::INT AS sentence_no, parts[s] AS sentence FROM (
  SELECT *, list_filter([trim(x) for x in string_split(
    regexp_replace(block, '([.:])\\s+([A-Z(])', '\\1@@CUT@@\\2', 'g'), '@@CUT@@')], lambda x: x <> '') AS parts
  FROM {name}_blocks) b, unnest(range(1, len(parts) + 1)) t(s)),
{name} AS MATERIALIZED (SELECT *, CASE WHEN keyword IN ('SHOULD NOT', 'SHOULD', 'NOT RECOMMENDED', 'RECOMMENDED') THEN 'weak'
    WHEN keyword IN ('MAY', 'OPTIONAL') THEN 'absent' ELSE 'binding' END AS modality,
    lower(trim(regexp_replace(sentence, '\\b({"|".join(fv.REQUIREMENT_KEYWORDS)})\\b', '{fv.KEYWORD_MASK}', 'g'))) AS requirement_key
  FROM (SELECT *, regexp_extract(sentence, {lit(keyword)}, 1) AS keyword FROM {name}_sentences
    WHERE length(sentence) - length(replace(sentence, '"', '')) < 2 AND NOT contains(sentence, '{fv.NOTATION_PHRASE}')) k
  WHERE keyword <> '')"""


_OLD = _spec_sql("old", _worded_sql(OLD))
_NEW = _spec_sql(
    "new",
    f"CASE doc_id % 3 WHEN 0 THEN {_worded_sql(NEW[0])} WHEN 1 THEN {_worded_sql(NEW[1])} ELSE {_worded_sql(NEW[2])} END",
)


@registry.add("reflowed_blocks", f"WITH {_OLD} SELECT document_id, block_no, block FROM old_blocks")
def reflowed_blocks(spark, sf_dir):
    return req.reflow(specification(spark, sf_dir))


@registry.add("sentences", f"WITH {_OLD} SELECT document_id, block_no, sentence_no, sentence FROM old_sentences")
def sentences(spark, sf_dir):
    return req.sentences(req.reflow(specification(spark, sf_dir)))


@registry.add(
    "requirements", f"WITH {_OLD} SELECT document_id, block_no, sentence_no, sentence, keyword, modality FROM old"
)
def requirements(spark, sf_dir):
    return req.read_requirements(specification(spark, sf_dir))


_PROFILE = """profiled AS MATERIALIZED (SELECT d.document_id, d.family, d.n, count(r.keyword) AS requirements,
  count(*) FILTER (modality = 'binding') AS binding, count(*) FILTER (modality = 'weak') AS weak,
  count(*) FILTER (modality = 'absent') AS absent,
  round(100.0 * count(*) FILTER (modality = 'binding') / greatest(count(r.keyword), 1), 1) AS binding_pct,
  round(100.0 * count(*) FILTER (modality = 'weak') / greatest(count(r.keyword), 1), 1) AS weak_pct,
  round(100.0 * count(*) FILTER (modality = 'absent') / greatest(count(r.keyword), 1), 1) AS absent_pct
  FROM old_docs d LEFT JOIN old r ON r.document_id = d.document_id GROUP BY ALL)"""


@registry.add(
    "requirement_profile",
    f"""WITH {_OLD},{_PROFILE} SELECT document_id, requirements, binding, weak, absent, binding_pct, weak_pct, absent_pct
    FROM profiled""",
)
def requirement_profile(spark, sf_dir):
    spec = specification(spark, sf_dir)
    return req.profile(req.read_requirements(spec), documents=spec)


@registry.add(
    "requirement_drift",
    f"""WITH {_OLD},{_NEW},
    o AS (SELECT document_id, requirement_key, arg_max(keyword, block_no * 100000 + sentence_no) AS k,
      arg_max(modality, block_no * 100000 + sentence_no) AS m, arg_max(sentence, block_no * 100000 + sentence_no) AS s FROM old GROUP BY 1, 2),
    w AS (SELECT document_id, requirement_key, arg_max(keyword, block_no * 100000 + sentence_no) AS k,
      arg_max(modality, block_no * 100000 + sentence_no) AS m, arg_max(sentence, block_no * 100000 + sentence_no) AS s FROM new GROUP BY 1, 2),
    rung(m, r) AS (VALUES ('binding', 2), ('weak', 1), ('absent', 0))
    SELECT coalesce(o.document_id, w.document_id) AS document_id,
      CASE WHEN o.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' ELSE 'changed' END AS status,
      o.k AS from_keyword, w.k AS to_keyword,
      CASE WHEN o.k IS NULL OR w.k IS NULL THEN NULL WHEN b.r < a.r THEN 'loosening' WHEN b.r > a.r THEN 'tightening' ELSE 'neutral' END AS direction,
      coalesce(w.s, o.s) AS requirement
    FROM o FULL JOIN w ON w.document_id = o.document_id AND w.requirement_key = o.requirement_key
    LEFT JOIN rung a ON a.m = o.m LEFT JOIN rung b ON b.m = w.m WHERE o.k IS DISTINCT FROM w.k""",
)
def requirement_drift(spark, sf_dir):
    old = req.read_requirements(specification(spark, sf_dir))
    return req.requirement_drift(old, req.read_requirements(specification(spark, sf_dir, new=True)))


@registry.add(
    "posture_series",
    f"""WITH {_OLD},{_PROFILE}, stepped AS (SELECT *, lag(document_id) OVER w AS from_document, lag(binding_pct) OVER w AS before
      FROM profiled WHERE requirements > 0 WINDOW w AS (PARTITION BY family ORDER BY n))
    SELECT family, from_document, document_id AS to_document, round(binding_pct - before, 1) AS binding_share_delta_pp,
      CASE WHEN round(binding_pct - before, 1) < 0 THEN 'looser' WHEN round(binding_pct - before, 1) > 0 THEN 'stricter' ELSE 'flat' END AS posture
    FROM stepped WHERE from_document IS NOT NULL""",
)
def posture_series(spark, sf_dir):
    spec = specification(spark, sf_dir).withColumnRenamed("n", "year")
    keys = ["document_id", "family", "year"]
    return req.posture_series(req.profile(req.read_requirements(spec, keys), keys))


@registry.add(
    "keyword_inventory",
    f"WITH {_OLD} SELECT document_id, keyword, modality, count(*) AS requirements FROM old GROUP BY ALL",
)
def keyword_inventory(spark, sf_dir):
    return req.keyword_inventory(req.read_requirements(specification(spark, sf_dir)))


@registry.add(
    "requirement_examples",
    f"""WITH {_OLD} SELECT document_id, example, keyword, modality, substring(sentence, 1, 180) AS text FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_no, sentence_no)::INT AS example FROM old) e
    WHERE example <= 8""",
)
def requirement_examples(spark, sf_dir):
    return req.first_examples(req.read_requirements(specification(spark, sf_dir)))
