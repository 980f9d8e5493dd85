"""Registered queries: experiment grid, observation panels, loss, ledger and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.operators import runs
from normtext.plans import run_sql
from normtext.plans.bindings import readings, slot_observations, source_slots, sources, table, texts
from normtext.plans.registry import Registry
from normtext.session import shared_path
from normtext.sources import tables

registry = Registry()
DEPTH = 7
SEED = 20260911
PROMPTS = [("paraphrase", "a"), ("paraphrase", "b"), ("allegorize", "a"), ("summarize", "a")]


def run_tables(spark, sf_dir):
    return texts(spark, sf_dir), source_slots(spark, sf_dir), readings(spark, sf_dir), slot_observations(spark, sf_dir)


def run_headers(spark, sf_dir):
    """One run per id, its status and start derived from its texts."""
    return texts(spark, sf_dir).groupBy("run_id").agg(
        F.when(F.sum("chars") % 2 == 0, "completed").otherwise("partial").alias("status"),
        F.sum("chars").cast("string").alias("started_at"),
    )


_HEADERS = """headers AS (SELECT run_id, CASE WHEN sum(chars) % 2 = 0 THEN 'completed' ELSE 'partial' END AS status,
  sum(chars)::VARCHAR AS started_at FROM texts GROUP BY 1)"""


def _passages(spark, sf_dir):
    """Categorical passages are only paraphrased; statutory ones get every style."""
    only = F.when(F.col("norm_group") == "categorical", F.array(F.lit("paraphrase")))
    return sources(spark, sf_dir).select("run_id", "passage_id", only.alias("styles"))


def _grid(spark, sf_dir):
    return runs.grid(_passages(spark, sf_dir), PROMPTS, DEPTH)


_GRID = f"""{run_sql.BASE},
grid AS MATERIALIZED (
  SELECT t.run_id, t.passage_id || ':' || p.style || ':' || p.variant AS chain_id, t.passage_id, p.style, p.variant, g::INT AS generation
  FROM texts t, (VALUES {", ".join(f"('{s}', '{v}')" for s, v in PROMPTS)}) p(style, variant), unnest(range(1, {DEPTH + 1})) r(g)
  WHERE t.generation = 0 AND (t.norm_group <> 'categorical' OR p.style = 'paraphrase'))"""


@registry.add("experiment_grid", f"WITH {_GRID} SELECT * FROM grid")
def experiment_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


TRANSFORM_USD = (900 * 3.0 + 350 * 15.0) / 1e6
READ_USD = (1200 * 1.0 + 450 * 5.0) / 1e6


@registry.add(
    "experiment_plan",
    f"""WITH {_GRID}, n AS (SELECT count(*) AS cells, count(DISTINCT (run_id, chain_id)) AS chains FROM grid),
    p AS (SELECT count(*) AS passages FROM texts WHERE generation = 0)
    SELECT passages, chains, cells AS planned_transformations, cells + passages AS planned_readings,
      round(cells * {TRANSFORM_USD} + (cells + passages) * {READ_USD}, 4)::DOUBLE AS planned_usd FROM n, p""",
)
def experiment_plan(spark, sf_dir):
    return runs.planned(_passages(spark, sf_dir), _grid(spark, sf_dir), TRANSFORM_USD, READ_USD)


def _ended(spark, sf_dir):
    """A chain has ended where its writer refused: here, where a turn has no period."""
    return texts(spark, sf_dir).where((F.col("generation") > 0) & ~F.contains("text", F.lit("."))).select("run_id", "chain_id").distinct()


@registry.add(
    "next_generations",
    f"""WITH {_GRID} SELECT g.run_id, g.chain_id, min(g.generation) AS next_generation FROM grid g
    ANTI JOIN (SELECT run_id, chain_id, generation FROM texts WHERE generation > 0) t
      ON t.run_id = g.run_id AND t.chain_id = g.chain_id AND t.generation = g.generation
    WHERE NOT EXISTS (SELECT 1 FROM texts e WHERE e.run_id = g.run_id AND e.chain_id = g.chain_id AND e.generation > 0
      AND NOT contains(e.text, '.')) GROUP BY 1, 2""",
)
def next_generations(spark, sf_dir):
    return runs.next_generations(_grid(spark, sf_dir), texts(spark, sf_dir), _ended(spark, sf_dir))


@registry.add(
    "unread_texts",
    f"""WITH {run_sql.BASE} SELECT t.run_id, t.text_id, t.generation FROM texts t
    WHERE t.passage_id IN (SELECT passage_id FROM texts WHERE generation > 0)
      AND NOT EXISTS (SELECT 1 FROM readings r WHERE r.run_id = t.run_id AND r.text_id = t.text_id)""",
)
def unread_texts(spark, sf_dir):
    return runs.unread_texts(texts(spark, sf_dir), readings(spark, sf_dir))


_COMPARED = f"""{run_sql.BASE},{_HEADERS},
comparisons AS MATERIALIZED (
  SELECT t.run_id, t.text_id, t.parent_text_id, t.passage_id, t.generation, t.chain_id, t.norm_group, t.pair_id, t.style, t.variant,
    s.slot_id, s.kind, s.attaches_to, s.quote AS source_quote, s.annotation_status, pb.status AS parent_status, a.status AS child_status,
    a.quote AS child_quote, r.model AS reader_model, r.call_id AS reader_call_id, pr.call_id AS parent_reader_call_id,
    o.status AS source_status, a.note AS reader_note, h.status AS run_status
  FROM texts t JOIN headers h USING (run_id) JOIN source_slots s ON s.run_id = t.run_id AND s.passage_id = t.passage_id
  LEFT JOIN readings r ON r.run_id = t.run_id AND r.text_id = t.text_id
  LEFT JOIN observations a ON a.run_id = t.run_id AND a.text_id = t.text_id AND a.slot_id = s.slot_id
  LEFT JOIN readings pr ON pr.run_id = t.run_id AND pr.text_id = t.parent_text_id
  LEFT JOIN observations pb ON pb.run_id = t.run_id AND pb.text_id = t.parent_text_id AND pb.slot_id = s.slot_id
  LEFT JOIN observations o ON o.run_id = t.run_id AND o.text_id = s.text_id AND o.slot_id = s.slot_id
  WHERE t.generation > 0)"""


def _comparisons(spark, sf_dir):
    return runs.slot_comparisons(run_headers(spark, sf_dir), *run_tables(spark, sf_dir))


@registry.add("slot_comparisons", f"WITH {_COMPARED} SELECT * FROM comparisons")
def slot_comparisons(spark, sf_dir):
    return _comparisons(spark, sf_dir).drop("source_text_id")


@registry.add(
    "changed_or_unread",
    f"""WITH {_COMPARED} SELECT run_id, text_id, slot_id, parent_status, child_status FROM comparisons
    WHERE parent_status IS DISTINCT FROM child_status OR parent_status IS NULL OR child_status IS NULL""",
)
def changed_or_unread(spark, sf_dir):
    return runs.changed_or_unread(_comparisons(spark, sf_dir)).select(
        "run_id", "text_id", "slot_id", "parent_status", "child_status"
    )


@registry.add(
    "status_pairs",
    f"""WITH {_COMPARED} SELECT style, parent_status, child_status, count(*) AS slot_comparisons FROM comparisons
    WHERE run_status = 'completed' GROUP BY ALL""",
)
def status_pairs(spark, sf_dir):
    return runs.status_pairs(_comparisons(spark, sf_dir))


@registry.add(
    "beside_original",
    f"""WITH {run_sql.TEXTS} SELECT c.run_id, c.passage_id, c.generation, c.style, c.variant, p.text AS original,
      c.text AS generated FROM texts c JOIN texts p ON p.run_id = c.run_id AND p.text_id = c.parent_text_id""",
)
def beside_original(spark, sf_dir):
    return runs.beside_original(texts(spark, sf_dir))


_PANEL = f"""{run_sql.BASE},
panel AS MATERIALIZED (
  SELECT t.run_id, t.text_id, t.passage_id, t.generation, t.chain_id, t.norm_group, t.style, t.variant, s.slot_id, s.kind,
    s.attaches_to, coalesce(o.status, 'not_read') AS status
  FROM texts t JOIN source_slots s ON s.run_id = t.run_id AND s.passage_id = t.passage_id
  LEFT JOIN observations o ON o.run_id = t.run_id AND o.text_id = t.text_id AND o.slot_id = s.slot_id)"""


def _panel(spark, sf_dir):
    return runs.observations_panel(*run_tables(spark, sf_dir))


@registry.add("observation_panel", f"WITH {_PANEL} SELECT * FROM panel")
def observation_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@registry.add(
    "generation_one_comparison",
    f"""WITH {run_sql.BASE}
    SELECT t.run_id, t.text_id, s.slot_id, s.kind, s.quote AS source_quote,
      CASE WHEN contains(t.text, s.quote) THEN 'found' ELSE 'not_found_requires_review' END AS literal_status,
      ((length(t.text) - length(replace(t.text, s.quote, ''))) / length(s.quote))::INT AS occurrences,
      coalesce(b.status, 'not_read') AS gen0_reader, coalesce(a.status, 'not_read') AS gen1_reader
    FROM texts t JOIN source_slots s ON s.run_id = t.run_id AND s.passage_id = t.passage_id
    LEFT JOIN observations a ON a.run_id = t.run_id AND a.text_id = t.text_id AND a.slot_id = s.slot_id
    LEFT JOIN observations b ON b.run_id = t.run_id AND b.text_id = s.text_id AND b.slot_id = s.slot_id
    WHERE t.generation = 1""",
)
def generation_one_comparison(spark, sf_dir):
    return runs.comparison_rows(*run_tables(spark, sf_dir))


def absences_sql(depth: int) -> str:
    return f"""{_PANEL},
chains AS (SELECT DISTINCT run_id, passage_id, chain_id, style, variant FROM texts WHERE generation > 0),
states AS (
  SELECT c.run_id, c.chain_id, c.passage_id, c.style, c.variant, p.slot_id,
    list(p.status ORDER BY p.generation) FILTER (p.generation BETWEEN 1 AND {depth}) AS path,
    max(p.status) FILTER (p.generation = 0) AS origin
  FROM chains c JOIN panel p ON p.run_id = c.run_id AND p.passage_id = c.passage_id GROUP BY ALL),
located AS (SELECT *, list_position(path, 'absent') AS hit FROM states),
absences AS MATERIALIZED (
  SELECT run_id, chain_id, passage_id, style, variant, slot_id,
    CASE WHEN origin = 'present' THEN hit::INT END AS first_absent,
    CASE WHEN origin <> 'present' THEN 'baseline_not_present'
      WHEN len(path) < coalesce(hit, {depth}) OR len(list_filter(path[1:coalesce(hit, {depth})], lambda s: s NOT IN ('present', 'absent'))) > 0
        THEN 'unresolved'
      WHEN hit IS NOT NULL THEN 'observed' ELSE 'not_observed_through_depth' END AS timing,
    coalesce(origin = 'present' AND hit IS NOT NULL AND list_contains(path[hit + 1:{depth}], 'present'), false) AS reappeared
  FROM located)"""


_CHAIN_KEYS = ["run_id", "chain_id", "passage_id", "style", "variant", "slot_id"]


def _absences(spark, sf_dir, depth):
    return runs.first_absence(runs.chain_panel(_panel(spark, sf_dir)), _CHAIN_KEYS, depth)


@registry.add("first_absence", f"WITH {absences_sql(DEPTH)} SELECT * FROM absences")
def first_absence(spark, sf_dir):
    return _absences(spark, sf_dir, DEPTH)


@registry.add("first_absence_to_depth_three", f"WITH {absences_sql(3)} SELECT * FROM absences")
def first_absence_to_depth_three(spark, sf_dir):
    return _absences(spark, sf_dir, 3)


_ORDERED = f"""{absences_sql(3)},
ordered AS (SELECT q.run_id, q.chain_id, q.passage_id, q.style, q.variant, q.slot_id AS qualifier, e.slot_id AS exception,
    q.first_absent AS qualifier_first_absent, q.timing AS qualifier_timing, e.first_absent AS exception_first_absent,
    e.timing AS exception_timing,
    CASE WHEN q.timing IN ('unresolved', 'baseline_not_present') OR e.timing IN ('unresolved', 'baseline_not_present') THEN 'unresolved'
      WHEN q.first_absent IS NULL AND e.first_absent IS NULL THEN 'neither_observed_absent'
      WHEN coalesce(q.first_absent, 99) < coalesce(e.first_absent, 99) THEN 'qualifier_first'
      WHEN coalesce(q.first_absent, 99) > coalesce(e.first_absent, 99) THEN 'exception_first' ELSE 'same_generation' END AS ordering
  FROM absences q JOIN absences e ON e.run_id = q.run_id AND e.chain_id = q.chain_id
   AND q.slot_id = 'carve_out_condition' AND e.slot_id = 'carve_out')"""


def _ordered(spark, sf_dir):
    slots = source_slots(spark, sf_dir)
    pairs = slots.groupBy("run_id", "passage_id").agg(
        F.max(F.when(F.col("slot_id") == "carve_out_condition", F.col("slot_id"))).alias("qualifier"),
        F.max(F.when(F.col("slot_id") == "carve_out", F.col("slot_id"))).alias("exception"),
    ).dropna()
    return runs.loss_order(_absences(spark, sf_dir, 3), pairs)


@registry.add("loss_order", f"WITH {_ORDERED} SELECT * FROM ordered")
def loss_order(spark, sf_dir):
    return _ordered(spark, sf_dir)


@registry.add("loss_order_counts", f"WITH {_ORDERED} SELECT style, ordering, count(*) AS pairs FROM ordered GROUP BY ALL")
def loss_order_counts(spark, sf_dir):
    return runs.order_counts(_ordered(spark, sf_dir))


@registry.add(
    "chain_coverage",
    f"""WITH {_GRID}, done AS (SELECT run_id, chain_id, count(*) AS n FROM texts WHERE generation > 0 GROUP BY 1, 2)
    SELECT g.run_id, g.chain_id, passage_id, style, variant, count(*) AS planned, coalesce(any_value(n), 0) AS generated,
      coalesce(any_value(n), 0) = count(*) AS complete FROM grid g LEFT JOIN done d ON d.run_id = g.run_id AND d.chain_id = g.chain_id GROUP BY ALL""",
)
def chain_coverage(spark, sf_dir):
    return runs.coverage(_grid(spark, sf_dir), texts(spark, sf_dir))


@registry.add(
    "texts_per_generation",
    f"""WITH {run_sql.TEXTS} SELECT n.run_id, g::INT AS generation, count(t.text_id) AS texts
    FROM (SELECT DISTINCT run_id FROM texts) n CROSS JOIN range(11) r(g)
    LEFT JOIN texts t ON t.run_id = n.run_id AND t.generation = g GROUP BY 1, 2""",
)
def texts_per_generation(spark, sf_dir):
    return runs.texts_per_generation(texts(spark, sf_dir), 10)


@registry.add(
    "survival_curve",
    f"""WITH {_PANEL} SELECT run_id, generation, CASE WHEN kind = 'exception' THEN 'Exception' WHEN attaches_to = 'exception'
        THEN 'Condition on exception' ELSE 'Other slots' END AS slot_category,
      count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'absent') AS absent,
      count(*) FILTER (status = 'uncertain') AS uncertain, count(*) FILTER (status = 'not_read') AS not_read,
      count(*) FILTER (status <> 'not_read') AS available,
      round(count(*) FILTER (status = 'present') / nullif(count(*) FILTER (status <> 'not_read'), 0)::DOUBLE, 6) AS present_fraction
    FROM panel WHERE norm_group = 'statutory' GROUP BY ALL""",
)
def survival_curve(spark, sf_dir):
    return runs.survival(_panel(spark, sf_dir))


# --- Calls: two events in a row are one call, its first event the request ---------------------------


def call_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    is_start = F.col("event_id") % 2 == 0
    http = F.when(k < 60, 200).when(k < 80, 429).otherwise(500)
    body = F.when(
        k % 2 == 0, F.concat(F.lit('{"type":"error","error":{"type":"'), F.col("event_type"), F.lit('"}}'))
    ).otherwise("<html>busy</html>")
    return events.select(
        F.concat(F.lit("run-"), ((F.col("event_id") / 2).cast("long") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("call-"), (F.col("event_id") / 2).cast("long").cast("string")).alias("call_id"),
        F.when(is_start, "started").when(F.col("event_type") == "error", "failed").otherwise("received").alias("event"),
        F.concat(F.lit("model-"), F.col("event_type")).alias("model"),
        F.when(~is_start, http).alias("http_status"),
        body.alias("body"),
        F.when(k < 80, F.round(F.col("value") * 100).cast("long")).alias("input_tokens"),
        F.when(k < 80, k.cast("long") * 10).alias("output_tokens"),
        F.when(is_start, F.col("value") / 1000).alias("reserved_usd"),
    )


_CALLS = """calls AS MATERIALIZED (
  SELECT 'run-' || ((event_id // 2) % 3) AS run_id, 'call-' || (event_id // 2) AS call_id,
    CASE WHEN event_id % 2 = 0 THEN 'started' WHEN event_type = 'error' THEN 'failed' ELSE 'received' END AS event,
    'model-' || event_type AS model, event_type, k,
    CASE WHEN k < 60 THEN 200 WHEN k < 80 THEN 429 ELSE 500 END AS http_status,
    CASE WHEN k < 80 THEN round(value * 100) END AS input_tokens, CASE WHEN k < 80 THEN k * 10 END AS output_tokens,
    value / 1000 AS reserved_usd
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events) e)"""


@registry.add(
    "error_summary",
    f"""WITH {_CALLS} SELECT http_status, CASE WHEN k % 2 = 0 THEN event_type ELSE 'http_error' END AS reason, count(*) AS errors
    FROM calls WHERE event = 'received' AND http_status <> 200 GROUP BY ALL""",
)
def error_summary(spark, sf_dir):
    return runs.error_summary(call_events(spark, sf_dir))


PRICES = [("model-view", 3.0, 15.0), ("model-click", 1.0, 5.0), ("model-purchase", 0.25, 1.25), ("model-error", 2.0, 8.0)]


@registry.add(
    "ledger_settlement",
    f"""WITH {_CALLS}, prices(model, pin, pout) AS (VALUES {", ".join(f"('{m}', {i}, {o})" for m, i, o in PRICES)}),
    starts AS (SELECT * FROM calls WHERE event = 'started'), receipts AS (SELECT * FROM calls WHERE event = 'received'),
    usage AS (SELECT r.run_id, sum(coalesce((r.input_tokens * pin + r.output_tokens * pout) / 1e6, 0)) AS usd, count(*) AS n
      FROM receipts r LEFT JOIN starts s USING (call_id) LEFT JOIN prices p ON p.model = coalesce(s.model, r.model) GROUP BY 1),
    holds AS (SELECT s.run_id, sum(s.reserved_usd) AS usd, count(*) AS n FROM starts s ANTI JOIN receipts r USING (call_id) GROUP BY 1)
    SELECT u.run_id, round(u.usd, 6)::DOUBLE AS usage_estimate, round(h.usd, 6) AS reserved, u.n AS receipts, h.n AS open_calls
    FROM usage u JOIN holds h USING (run_id)""",
)
def ledger_settlement(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    return runs.settle(call_events(spark, sf_dir), prices)


_REVIEW = f"""WITH {run_sql.TEXTS},{run_sql.SLOTS},
numbered AS (SELECT *, 'review-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS review_id FROM (
  SELECT *, row_number() OVER (ORDER BY sha256('{SEED}|' || run_id || '|' || text_id), run_id, text_id) AS n FROM texts) t)"""


def _packet(spark, sf_dir):
    questions = source_slots(spark, sf_dir).select(
        "run_id", "passage_id", "slot_id", F.concat(F.lit("Is "), "quote", F.lit(" there?")).alias("question")
    )
    return runs.blind_packet(texts(spark, sf_dir), questions, SEED)


@registry.add(
    "blind_packet",
    f"""{_REVIEW}, asked AS (SELECT run_id, passage_id, string_agg(slot_id || '=Is ' || quote || ' there?', '|' ORDER BY slot_id) AS questions
      FROM source_slots GROUP BY ALL)
    SELECT review_id, text, coalesce(questions, '') AS questions FROM numbered n
    LEFT JOIN asked a ON a.run_id = n.run_id AND a.passage_id = n.passage_id""",
)
def blind_packet(spark, sf_dir):
    asked = F.transform("schema", lambda q: F.concat_ws("=", q["slot_id"], q["question"]))
    return _packet(spark, sf_dir)[0].select("review_id", "text", F.array_join(asked, "|").alias("questions"))


@registry.add("blind_packet_key", f"{_REVIEW} SELECT review_id, text_id, run_id FROM numbered")
def blind_packet_key(spark, sf_dir):
    return _packet(spark, sf_dir)[1]


def _two_readers(spark, sf_dir):
    """A strict reader that wants the quote as a word of its own, beside the verbatim one."""
    read = texts(spark, sf_dir).select("run_id", "text_id", "passage_id", "text", "chars").join(
        source_slots(spark, sf_dir).select("run_id", "passage_id", "slot_id", "kind", "quote"), ["run_id", "passage_id"]
    )
    loose = F.when(F.contains("text", F.col("quote")), "present").otherwise("absent")
    strict = F.when(F.contains("text", F.concat(F.lit(" "), "quote", F.lit(" "))), "present").otherwise("absent")
    answers = F.array(
        F.struct(F.lit("verbatim").alias("model"), loose.alias("status"), F.lit(True).alias("valid")),
        F.struct(F.lit("strict").alias("model"), strict.alias("status"), (F.col("chars") % 11 != 0).alias("valid")),
    )
    keys = ["run_id", "text_id", "slot_id", "kind"]
    return read.select(*keys, F.explode(answers).alias("a")).select(*keys, "a.*")


def _readers_sql(by: str) -> str:
    return f"""WITH {run_sql.TEXTS},{run_sql.SLOTS}, pairs AS (SELECT s.kind, contains(t.text, s.quote) AS loose,
      contains(t.text, ' ' || s.quote || ' ') AS strict, t.chars % 11 <> 0 AS ok
      FROM texts t JOIN source_slots s ON s.run_id = t.run_id AND s.passage_id = t.passage_id),
    answers AS (SELECT 'verbatim' AS model, kind, loose AS found, true AS valid, loose AS reference FROM pairs
      UNION ALL SELECT 'strict', kind, strict, ok, loose FROM pairs)
    SELECT {by}, count(*) AS answers, round(avg(valid::INT), 4) AS valid_share,
      round(avg(found::INT) FILTER (valid), 4) AS present_share, round(avg((found = reference)::INT) FILTER (valid), 4) AS agreement
    FROM answers GROUP BY {by}"""


@registry.add("reader_scoreboard", _readers_sql("model"))
def reader_scoreboard(spark, sf_dir):
    return runs.reader_scoreboard(_two_readers(spark, sf_dir), "verbatim")


@registry.add("reader_scoreboard_by_kind", _readers_sql("model, kind"))
def reader_scoreboard_by_kind(spark, sf_dir):
    return runs.reader_scoreboard(_two_readers(spark, sf_dir), "verbatim", by_kind=True)


@registry.add(
    "writer_scoreboard",
    f"""WITH {run_sql.TEXTS} SELECT t.role AS model, count(*) AS texts, round(avg(t.chars / p.chars), 4) AS mean_length_ratio,
      round(sum(t.chars * 0.000002), 6)::DOUBLE AS usd
    FROM texts t JOIN texts p ON p.run_id = t.run_id AND p.text_id = t.parent_text_id GROUP BY 1""",
)
def writer_scoreboard(spark, sf_dir):
    all_texts = texts(spark, sf_dir)
    parents = all_texts.select("run_id", F.col("text_id").alias("parent_text_id"), F.col("chars").alias("source_chars"))
    writes = all_texts.join(parents, ["run_id", "parent_text_id"]).select(
        F.col("role").alias("model"), "chars", "source_chars", (F.col("chars") * 0.000002).alias("usd")
    )
    return runs.writer_scoreboard(writes)


@registry.add(
    "latest_run",
    """WITH runs AS (SELECT 'order-' || o_orderkey AS run_id, o_orderpriority AS m1, o_orderstatus AS m2,
      strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders)
    SELECT arg_max(run_id, started_at || run_id) AS run_id, max(started_at) AS started_at FROM runs
    WHERE m1 IN ('1-URGENT', '2-HIGH', 'F', 'P') AND m2 IN ('1-URGENT', '2-HIGH', 'F', 'P')""",
)
def latest_run(spark, sf_dir):
    """Orders as run headers: priority and status stand for the two models."""
    headers = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderpriority").alias("transformer_model"),
        F.col("o_orderstatus").alias("extractor_model"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"),
    )
    supported = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("F",), ("P",)], "model string")
    return runs.latest_run(headers, supported)


def run_records(spark, sf_dir):
    """The run tables written out as JSON lines and parsed back with the declared schemas."""
    all_texts, slots, read, seen = run_tables(spark, sf_dir)
    short = F.struct(
        "slot_id", "kind", "attaches_to", "quote", F.lit("?").alias("question"), "determinacy", "modality"
    )
    slot_lists = slots.groupBy("run_id", "passage_id").agg(F.array_sort(F.collect_list(short)).alias("slots"))
    answers = seen.groupBy("run_id", "call_id").agg(
        F.array_sort(F.collect_list(F.struct("slot_id", "status", "quote", "note"))).alias("slots")
    )
    source_lines = all_texts.where("generation = 0").join(slot_lists, ["run_id", "passage_id"], "left").select(
        "run_id",
        F.to_json(
            F.struct(
                "passage_id", "text", "text_sha256", F.lit("http://texts.example/").alias("source_url"),
                F.col("norm_group").alias("group"), "pair_id",
                F.when(F.col("chars") % 2 == 0, "draft").otherwise("ratified").alias("annotation_status"), "slots",
            )
        ).alias("value"),
    )
    parent = F.when(F.col("generation") > 1, F.col("parent_text_id"))
    generation_lines = all_texts.where("generation > 0").select(
        "run_id",
        F.to_json(
            F.struct(
                "text_id", "passage_id", "generation", parent.alias("parent_text_id"), "style", "variant", "text",
                "text_sha256", F.concat(F.lit("write:"), "text_id").alias("call_id"), "chain_id",
            )
        ).alias("value"),
    )
    reading_lines = read.join(answers, ["run_id", "call_id"], "left").select(
        "run_id",
        F.to_json(
            F.struct(
                "call_id", "text_id", "passage_id", "generation", "model",
                F.concat(F.lit("response:"), "text_id").alias("response_id"), "slots",
            )
        ).alias("value"),
    )
    calls = call_events(spark, sf_dir)
    call_lines = calls.select("run_id", F.to_json(F.struct("call_id", "event", F.lit("now").alias("at"))).alias("value"))
    return {
        "runs": run_headers(spark, sf_dir).withColumn("manifest", F.lit("{}")),
        "sources": runs.read_records(source_lines, "sources"),
        "generations": runs.read_records(generation_lines, "generations"),
        "readings": runs.read_records(reading_lines, "readings"),
        "calls": runs.read_records(call_lines, "calls").withColumn(
            "event_index", F.regexp_extract("call_id", r"\d+", 0).cast("long")
        ),
    }


@registry.add(
    "projected_texts",
    f"""WITH {run_sql.BASE} SELECT run_id, CASE WHEN generation = 0 THEN 'source:' || passage_id ELSE text_id END AS text_id,
      passage_id, generation, CASE WHEN generation = 1 THEN 'source:' || passage_id ELSE parent_text_id END AS parent_text_id,
      style, variant, sha256(text) AS text_sha256, chain_id, norm_group FROM texts t""",
)
def projected_texts(spark, sf_dir):
    projected = runs.project_run(run_records(spark, sf_dir))["texts"]
    return projected.select(
        "run_id", "text_id", "passage_id", "generation", "parent_text_id", "style", "variant", "text_sha256", "chain_id",
        "norm_group",
    )


@registry.add(
    "projected_source_slots",
    f"""WITH {run_sql.BASE} SELECT run_id, 'source:' || passage_id AS text_id, slot_id, kind, attaches_to, quote,
      annotation_status FROM source_slots""",
)
def projected_source_slots(spark, sf_dir):
    return runs.project_run(run_records(spark, sf_dir))["source_slots"]


@registry.add(
    "projected_observations",
    f"""WITH {run_sql.BASE} SELECT o.run_id, o.call_id, o.slot_id, o.status, o.quote, o.note,
      CASE WHEN r.generation = 0 THEN 'source:' || r.passage_id ELSE r.text_id END AS text_id, r.model
    FROM observations o JOIN readings r ON r.run_id = o.run_id AND r.call_id = o.call_id""",
)
def projected_observations(spark, sf_dir):
    tables = runs.project_run(run_records(spark, sf_dir))
    return tables["slot_observations"].join(tables["readings"].drop("response_id"), ["run_id", "call_id"])


@registry.add(
    "projected_call_events",
    f"WITH {_CALLS} SELECT run_id, regexp_extract(call_id, '[0-9]+')::BIGINT AS event_index, call_id, event FROM calls",
)
def projected_call_events(spark, sf_dir):
    return runs.project_run(run_records(spark, sf_dir))["call_events"].drop("receipt")


@registry.add(
    "exported_run",
    f"""WITH {run_sql.BASE} SELECT 'texts' AS table_name, run_id, count(*) AS rows, min(text_id) AS first_id FROM texts WHERE run_id = 'run-1' GROUP BY 2
    UNION ALL SELECT 'source_slots', run_id, count(*), min(text_id) FROM source_slots WHERE run_id = 'run-1' GROUP BY 2
    UNION ALL SELECT 'readings', run_id, count(*), min(text_id) FROM readings WHERE run_id = 'run-1' GROUP BY 2
    UNION ALL SELECT 'slot_observations', run_id, count(*), min(text_id) FROM observations WHERE run_id = 'run-1' GROUP BY 2""",
)
def exported_run(spark, sf_dir):
    """One run written as Parquet and read back, table by table."""
    names = ["texts", "source_slots", "readings", "slot_observations"]
    path = tables.export_run(dict(zip(names, run_tables(spark, sf_dir))), "run-1", shared_path(spark, "run"))
    counted = [
        spark.read.parquet(f"{path}/{name}").groupBy("run_id").agg(F.count("*").alias("rows"), F.min("text_id").alias("first_id"))
        .withColumn("table_name", F.lit(name))
        for name in names
    ]
    return reduce(DataFrame.unionByName, counted)
