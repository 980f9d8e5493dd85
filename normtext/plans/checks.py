"""Registered queries: data-quality and contract checks on inputs with known faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from normtext.operators import gold, markers, quality
from normtext.plans import run_sql
from normtext.plans import sql_parts as sql
from normtext.plans.bindings import (
    STAND_IN,
    annotated_passages,
    axis_passages,
    provisions,
    readings,
    slot_observations,
    source_slots,
    table,
    texts,
)
from normtext.plans.experiments import call_events, run_headers
from normtext.plans.passages import _AXIS, _ROWS
from normtext.plans.registry import Registry
from normtext.plans.tables import CHUNK_SQL, blank_line_documents

registry = Registry()

_EXPECTED = {"char_count": (1, 500)}


@registry.add(
    "expectations",
    f"""WITH {sql.PROVISIONS}, repeated AS (SELECT count(*) AS n FROM provisions GROUP BY label HAVING count(*) > 1)
    SELECT rule, unexpected::BIGINT AS unexpected, unexpected = 0 AS success FROM (
      SELECT 'not_null(provision_id)' AS rule, 0 AS unexpected
      UNION ALL SELECT 'not_null(document_version)', count(*) FILTER (document_version IS NULL) FROM provisions
      UNION ALL SELECT 'between(char_count)', count(*) FILTER (char_count NOT BETWEEN 1 AND 500) FROM provisions
      UNION ALL SELECT 'row_count', CASE WHEN count(*) BETWEEN 1 AND 10 THEN 0 ELSE count(*) END FROM provisions
      UNION ALL SELECT 'unique(provision_id)', 0 UNION ALL SELECT 'unique(label)', sum(n) FROM repeated) r""",
)
def expectations(spark, sf_dir):
    return quality.expect(
        provisions(spark, sf_dir), "provision_id", not_null=["provision_id", "document_version"],
        unique=["provision_id", "label"], between=_EXPECTED, rows_between=(1, 10),
    )


@registry.add(
    "unexpected_rows",
    f"""WITH {sql.PROVISIONS} SELECT provision_id, 'not_null(document_version)' AS rule FROM provisions WHERE document_version IS NULL
    UNION ALL SELECT provision_id, 'between(char_count)' FROM provisions WHERE char_count NOT BETWEEN 1 AND 500""",
)
def unexpected_rows(spark, sf_dir):
    return quality.unexpected_rows(provisions(spark, sf_dir), "provision_id", ["document_version"], _EXPECTED)


@registry.add(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@registry.add(
    "coverage_diff",
    """SELECT coalesce(c, o) AS custkey, CASE WHEN o IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
    FROM (SELECT DISTINCT c_custkey + 5 AS c FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) b ON c = o
    WHERE c IS NULL OR o IS NULL""",
)
def coverage_diff(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 5).alias("custkey"))
    return quality.coverage_diff(expected, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@registry.add(
    "missing_lineage",
    f"""WITH {sql.PROVISIONS} SELECT count(*) AS rows, 0::BIGINT AS missing_source_sha256,
      count(*) FILTER (document_version IS NULL) AS missing_document_version FROM provisions""",
)
def missing_lineage(spark, sf_dir):
    return quality.missing_lineage(provisions(spark, sf_dir), ["source_sha256", "document_version"])


@registry.add(
    "reconciled_totals",
    f"""WITH {sql.PROVISIONS} SELECT count(*) AS gold_total, count(DISTINCT provision_id) AS silver_total,
      count(*) = count(DISTINCT provision_id) AS reconciled FROM provisions""",
)
def reconciled_totals(spark, sf_dir):
    silver = provisions(spark, sf_dir)
    return quality.reconcile(gold.provision_summary(silver), silver)


@registry.add(
    "chunk_contract",
    f"""WITH {CHUNK_SQL}, made AS MATERIALIZED (SELECT c.provision_id, c.part, f.n, c.content, length(f.context || c.content) + 2 AS chars,
        regexp_extract(c.provision_id, '[0-9]+')::BIGINT AS d
      FROM contents c JOIN final f USING (provision_id) WHERE f.reason IS NULL),
    damaged AS MATERIALIZED (SELECT *, CASE WHEN d % 10 = 0 AND part = 2 THEN content || 'x' WHEN d % 10 = 5 AND part = 1 THEN reverse(content) ELSE content END AS held FROM made),
    sizes AS (SELECT provision_id, sum(length(held)) + 2 * (count(*) - 1) AS size,
      string_agg(held, chr(10) || chr(10) ORDER BY part) AS rebuilt FROM damaged GROUP BY 1)
    SELECT provision_id, 'no lineage' AS problem FROM damaged WHERE d % 7 = 0
    UNION ALL SELECT j.provision_id, 'parts do not rebuild the text' FROM judged j LEFT JOIN sizes s USING (provision_id)
      WHERE s.rebuilt IS DISTINCT FROM j.text""",
)
def chunk_contract(spark, sf_dir):
    """Chunks with three planted faults: a longer part, a reversed part, missing lineage."""
    docs = blank_line_documents(spark, sf_dir)
    chunks, _ = gold.retrieval_chunks(docs)
    number = F.regexp_extract("provision_id", r"\d+", 0).cast("long")
    held = (
        F.when((number % 10 == 0) & (F.col("part") == 2), F.concat("content", F.lit("x")))
        .when((number % 10 == 5) & (F.col("part") == 1), F.reverse("content"))
        .otherwise(F.col("content"))
    )
    damaged = chunks.withColumn("content", held).withColumn(
        "source_sha256", F.when(number % 7 != 0, F.col("chunk_text_sha256"))
    )
    return quality.check_chunks(damaged, docs)


@registry.add(
    "pool_contract",
    f"""WITH {sql.PROVISIONS} SELECT 'documents: expected 7, got ' || count(DISTINCT document_id) AS problem FROM provisions
    UNION ALL SELECT 'provisions: expected 11, got ' || count(*) FROM provisions""",
)
def pool_contract(spark, sf_dir):
    return quality.check_pool(provisions(spark, sf_dir), 7, 11)


@registry.add(
    "slot_contract",
    f"""WITH {_ROWS}, judged AS (SELECT passage_id, slot_id, CASE WHEN slot_id = 'party' THEN 'no question'
        WHEN (length(text) - length(replace(text, quote, ''))) / length(quote) <> 1 THEN 'quote does not occur exactly once' END AS problem FROM rows)
    SELECT * FROM judged WHERE problem IS NOT NULL
    UNION ALL SELECT passage_id, NULL, 'no slots' FROM passages WHERE passage_id NOT IN (SELECT passage_id FROM rows)""",
)
def slot_contract(spark, sf_dir):
    asked = F.transform(
        "slots", lambda s: s.withField("question", F.when(s["slot_id"] == "party", "").otherwise("Is it there?"))
    )
    return quality.check_slots(annotated_passages(spark, sf_dir).withColumn("slots", asked))


@registry.add(
    "passage_contract",
    f"""WITH {_AXIS} SELECT provision_id AS passage_id, CASE WHEN doc_id % 45 = 3 THEN 'missing source'
      WHEN doc_id % 60 = 4 THEN 'unknown group' WHEN doc_id % 50 = 0 THEN 'text hash mismatch' END AS problem FROM provisions
    WHERE doc_id % 45 = 3 OR doc_id % 60 = 4 OR doc_id % 50 = 0""",
)
def passage_contract(spark, sf_dir):
    passages = axis_passages(spark, sf_dir)
    n = F.regexp_extract("passage_id", r"\d+", 0).cast("long")
    faulty = passages.withColumns(
        {
            "source": F.when(n % 45 != 3, F.col("source")),
            "group": F.when(n % 60 == 4, "other").otherwise(F.col("group")),
            "text_sha256": F.when(n % 50 == 0, "0").otherwise(F.col("text_sha256")),
        }
    )
    return quality.check_passages(faulty)


@registry.add(
    "reading_contract",
    f"""WITH {run_sql.TEXTS},{run_sql.SLOTS}, asked AS (SELECT run_id, passage_id, count(*) AS n FROM source_slots GROUP BY 1, 2)
    SELECT t.run_id, t.text_id, reason, reason IS NULL AS valid
    FROM (SELECT t.*, CASE CASE WHEN n IS NULL AND chars % 6 <> 5 THEN 0 ELSE chars % 6 END WHEN 0 THEN NULL WHEN 1 THEN 'unknown status'
      WHEN 2 THEN 'note required' WHEN 3 THEN 'quote is not in the text' WHEN 4 THEN 'missing, duplicate or unknown slot ids'
      ELSE 'answer must contain only slots' END AS reason FROM texts t LEFT JOIN asked USING (run_id, passage_id)) t""",
)
def reading_contract(spark, sf_dir):
    """Answers with one planted fault per remainder of the text's length."""
    fault = F.col("chars") % 6
    slots = source_slots(spark, sf_dir).groupBy("run_id", "passage_id").agg(
        F.array_sort(F.collect_list(F.struct("slot_id", F.col("quote").alias("q")))).alias("_s")
    )
    rows = texts(spark, sf_dir).select("run_id", "text_id", "passage_id", "text", "chars").join(slots, ["run_id", "passage_id"], "left")
    none = F.array().cast("array<struct<slot_id:string,q:string>>")
    rows = rows.withColumn("_s", F.coalesce("_s", none))  # a passage may ask for nothing; an empty list answers it

    def answer(slot):
        there = F.contains("text", slot["q"])
        return F.struct(
            slot["slot_id"].alias("slot_id"),
            F.when(fault == 1, "maybe").when(there | (fault == 3), "present").otherwise("absent").alias("status"),
            F.when(fault == 3, F.concat(slot["q"], F.lit("\n\nnowhere"))).when(there, slot["q"]).alias("quote"),
            F.when(fault == 2, " ").otherwise("seen").alias("note"),
        )

    given = F.transform(F.when(fault == 4, F.slice("_s", 2, 100)).otherwise(F.col("_s")), answer)
    keep_nulls = {"ignoreNullFields": "false"}
    json = F.when(
        fault == 5, F.to_json(F.struct(given.alias("slots"), F.lit(1).alias("extra")), keep_nulls)
    ).otherwise(F.to_json(F.struct(given.alias("slots")), keep_nulls))
    answers = rows.select(
        "run_id", "text_id", "text", json.alias("answer"), F.transform("_s", lambda s: s["slot_id"]).alias("asked")
    )
    return quality.check_readings(answers).select("run_id", "text_id", "reason", "valid")


_SHIFT = "char_offset + (CASE WHEN char_offset % 5 = 0 THEN 1 ELSE 0 END)"


@registry.add(
    "span_contract",
    f"""WITH {sql.PROVISIONS},{sql.hits()} SELECT provision_id, marker, ({_SHIFT})::INT AS char_offset,
      substring(text, {_SHIFT} + 1, length(matched_span)) = matched_span AS verbatim,
      contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(matched_span, '\\s+', ' ', 'g'))) AS verbatim_squeezed
    FROM hits""",
)
def span_contract(spark, sf_dir):
    found = markers.marker_hits(provisions(spark, sf_dir), STAND_IN, ["provision_id", "text"])
    shifted = found.withColumn("char_offset", F.expr(f"cast({_SHIFT} AS int)")).withColumnRenamed("matched_span", "span")
    return quality.check_spans(shifted).select("provision_id", "marker", "char_offset", "verbatim", "verbatim_squeezed")


@registry.add(
    "run_audit",
    f"""WITH {run_sql.BASE}, twice AS (SELECT *, text_id AS own_id FROM texts
      UNION ALL SELECT * REPLACE (text_id || ':again' AS text_id), text_id FROM texts WHERE generation = 0 AND chars % 31 = 0),
    faulty AS (SELECT *, CASE WHEN chars % 13 = 0 THEN '0' ELSE sha256(text) END AS sha,
        CASE WHEN generation > 0 AND chars % 17 = 0 THEN generation + 1 ELSE generation END AS g,
        CASE WHEN chars % 19 = 0 THEN 'other' ELSE chain_id END AS chain, CASE WHEN chars % 23 = 0 THEN 'other' ELSE style END AS way FROM twice),
    lineage AS (SELECT c.run_id, c.text_id AS id, CASE WHEN p.text_id IS NULL THEN 'parent text is missing'
        WHEN c.g <> p.g + 1 THEN 'generation is not parent + 1' WHEN CASE WHEN c.chars % 11 = 0 THEN 'x' ELSE sha256(p.text) END <> p.sha THEN 'parent hash mismatch'
        WHEN p.g > 0 AND (c.chain IS DISTINCT FROM p.chain OR c.way IS DISTINCT FROM p.way OR c.variant IS DISTINCT FROM p.variant)
          THEN 'chain metadata mismatch' END AS problem
      FROM faulty c LEFT JOIN faulty p ON p.run_id = c.run_id AND p.text_id = c.parent_text_id WHERE c.g > 0),
    made AS (SELECT run_id, count(*) FILTER (g > 0) AS n FROM faulty GROUP BY 1),
    taken AS (SELECT run_id, count(*) AS n FROM readings GROUP BY 1)
    SELECT run_id, text_id AS id, 'text hash mismatch' AS problem FROM faulty WHERE chars % 13 = 0
    UNION ALL SELECT * FROM lineage WHERE problem IS NOT NULL
    UNION ALL SELECT run_id, text_id, 'reading target metadata mismatch' FROM faulty JOIN readings r USING (run_id, text_id)
      WHERE r.chars % 29 = 0 OR faulty.g <> r.generation
    UNION ALL SELECT run_id, passage_id, 'duplicate source passage' FROM faulty WHERE g = 0 GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT m.run_id, m.run_id, 'completed run misses generations or readings' FROM made m JOIN taken r USING (run_id)
      WHERE m.run_id <> 'run-1'""",
)
def run_audit(spark, sf_dir):
    """Runs with planted faults in hashes, generations, parents, chains, styles, readings and sources."""
    plain = texts(spark, sf_dir)
    n = F.col("chars")
    parents = plain.select("run_id", F.col("text_id").alias("parent_text_id"), F.col("text_sha256").alias("_p"))
    again = plain.where((F.col("generation") == 0) & (n % 31 == 0)).withColumn("text_id", F.concat("text_id", F.lit(":again")))
    faulty = plain.unionByName(again).join(parents, ["run_id", "parent_text_id"], "left").withColumns(
        {
            "parent_sha256": F.when(n % 11 == 0, "x").otherwise(F.col("_p")),
            "text_sha256": F.when(n % 13 == 0, "0").otherwise(F.col("text_sha256")),
            "generation": F.when((F.col("generation") > 0) & (n % 17 == 0), F.col("generation") + 1).otherwise(F.col("generation")),
            "chain_id": F.when(n % 19 == 0, "other").otherwise(F.col("chain_id")),
            "style": F.when(n % 23 == 0, "other").otherwise(F.col("style")),
        }
    )
    read = readings(spark, sf_dir).withColumn(
        "passage_id", F.when(n % 29 == 0, "nowhere").otherwise(F.col("passage_id"))
    )
    made = faulty.where("generation > 0").groupBy("run_id").agg(F.count("*").alias("made"))
    taken = read.groupBy("run_id").agg(F.count("*").alias("taken"))
    short = F.when(F.col("run_id") == "run-1", 0).otherwise(1)  # only run-1 holds what was planned
    headers = made.join(taken, "run_id").select(
        "run_id", F.lit("completed").alias("status"),
        (F.col("made") + short).alias("planned_transformations"), (F.col("taken") + short).alias("planned_readings"),
    )
    return quality.audit_run(headers, faulty, read)


@registry.add(
    "key_report",
    f"""WITH {run_sql.BASE}, held AS (SELECT * FROM texts WHERE chars % 19 <> 0),
    slots AS (SELECT s.* FROM source_slots s)
    SELECT 'runs' AS table_name, 'primary key (run_id)' AS rule, 0::BIGINT AS violations
    UNION ALL SELECT 'texts', 'primary key (run_id, text_id)', 0
    UNION ALL SELECT 'source_slots', 'primary key (run_id, text_id, slot_id)', 0
    UNION ALL SELECT 'readings', 'primary key (run_id, call_id)', 0
    UNION ALL SELECT 'slot_observations', 'primary key (run_id, call_id, slot_id)', 0
    UNION ALL SELECT 'call_events', 'primary key (run_id, event_index)', (SELECT count(*) FROM (
      SELECT (event_id // 2) % 3 AS r, event_id // 4 AS i FROM events GROUP BY ALL HAVING count(*) > 1) d)
    UNION ALL SELECT 'texts', 'references runs (run_id)', 0
    UNION ALL SELECT 'source_slots', 'references texts (run_id, text_id)', (SELECT count(*) FROM slots s ANTI JOIN held h USING (run_id, text_id))
    UNION ALL SELECT 'readings', 'references texts (run_id, text_id)', (SELECT count(*) FROM readings r ANTI JOIN held h USING (run_id, text_id))
    UNION ALL SELECT 'slot_observations', 'references readings (run_id, call_id)', 0
    UNION ALL SELECT 'call_events', 'references runs (run_id)', 0
    UNION ALL SELECT 'texts', 'generation >= 0', 0 UNION ALL SELECT 'slot_observations', 'known status', 0""",
)
def key_report(spark, sf_dir):
    """Texts of some lengths are left out, and call events repeat their index."""
    number = F.regexp_extract("call_id", r"\d+", 0).cast("long")
    return quality.check_keys(
        {
            "runs": run_headers(spark, sf_dir),
            "texts": texts(spark, sf_dir).where(F.col("chars") % 19 != 0),
            "source_slots": source_slots(spark, sf_dir),
            "readings": readings(spark, sf_dir),
            "slot_observations": slot_observations(spark, sf_dir),
            "call_events": call_events(spark, sf_dir).withColumn("event_index", F.floor(number / 2)),
        }
    )
