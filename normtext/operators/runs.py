"""Analytics over recorded experiment runs.

Tables: runs, texts, source_slots, readings, slot_observations, call events. A
text and its slots meet on (run_id, passage_id), whose slot side is one short
list per passage; a passage that owns very many texts is a skewed equi-join key,
which adaptive execution splits. Per-chain results are plain aggregates with
map-side partials, never windows over a chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.functions.ordered import with_ordinal
from normtext.operators.direction import SIGNS, measure
from normtext.operators.reader import quote_audit


# --- Design --------------------------------------------------------------------------------------


def grid(passages: DataFrame, prompts: Sequence[tuple[str, str]], depth: int) -> DataFrame:
    """Every planned (run, chain, generation). ``passages`` has run_id and may carry ``styles``, the
    subset of styles its corpus uses (NULL = all); ``prompts`` lists (style, variant)."""
    entries = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(v).alias("variant")) for s, v in prompts])
    wanted = F.filter(entries, lambda p: F.col("styles").isNull() | F.array_contains("styles", p["style"]))
    chains = passages.select("run_id", "passage_id", F.explode(wanted).alias("_p")).select("run_id", "passage_id", "_p.*").withColumn(
        "chain_id", F.concat_ws(":", "passage_id", "style", "variant")
    )
    return chains.select(
        "run_id", "chain_id", "passage_id", "style", "variant", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("generation")
    )


def planned(passages: DataFrame, cells: DataFrame, transform_usd: float, read_usd: float) -> DataFrame:
    """Planned counts and cost: one transformation per cell, one reading per cell and passage."""
    per_cell = cells.agg(
        F.count("*").alias("planned_transformations"), F.countDistinct("run_id", "chain_id").alias("chains")
    )
    readings = F.col("planned_transformations") + F.col("passages")
    return per_cell.withColumn("passages", passages.agg(F.count("*")).scalar()).select(
        "passages",
        "chains",
        "planned_transformations",
        readings.alias("planned_readings"),
        F.round(F.col("planned_transformations") * transform_usd + readings * read_usd, 4).alias("planned_usd"),
    )


def call_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Prices are per million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / 1_000_000


def next_generations(cells: DataFrame, texts: DataFrame, ended: DataFrame) -> DataFrame:
    """The first missing generation of every chain that has not ended, run by run."""
    done = texts.where(F.col("generation") > 0).select("run_id", "chain_id", "generation")
    return (
        cells.join(done, ["run_id", "chain_id", "generation"], "left_anti")
        .join(ended.select("run_id", "chain_id"), ["run_id", "chain_id"], "left_anti")
        .groupBy("run_id", "chain_id")
        .agg(F.min("generation").alias("next_generation"))
    )


def unread_texts(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """Texts without a reading: all generated ones, and sources some chain has used."""
    used = texts.where(F.col("generation") > 0).select("run_id", "passage_id").distinct()
    return (
        texts.join(used, ["run_id", "passage_id"], "left_semi")
        .join(readings.select("run_id", "text_id"), ["run_id", "text_id"], "left_anti")
        .select("run_id", "text_id", "generation")
    )


# --- Panels --------------------------------------------------------------------------------------


def _source_texts(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("generation") == 0).select("run_id", "passage_id", F.col("text_id").alias("source_text_id"))


def _statuses(readings: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations keyed by the text that was read."""
    return observations.drop("text_id").join(
        readings.select("run_id", "call_id", "text_id", "model"), ["run_id", "call_id"]
    )


def slot_comparisons(
    runs: DataFrame, texts: DataFrame, slots: DataFrame, readings: DataFrame, observations: DataFrame
) -> DataFrame:
    """Each source slot of each generated text with source, parent and child status.

    A missing reading leaves NULL; it is never turned into absent.
    """
    seen = _statuses(readings, observations)

    def side(name: str, columns: Mapping[str, str]) -> DataFrame:
        return seen.select(
            "run_id", F.col("text_id").alias(name), "slot_id", *[F.col(c).alias(a) for c, a in columns.items()]
        )

    def reader(name: str, columns: Mapping[str, str]) -> DataFrame:
        return readings.select("run_id", F.col("text_id").alias(name), *[F.col(c).alias(a) for c, a in columns.items()])

    children = texts.where(F.col("generation") > 0).select(
        "run_id", "text_id", "parent_text_id", "passage_id", "generation", "chain_id", "norm_group", "pair_id", "style", "variant"
    )
    of_source = slots.select(
        "run_id", F.col("text_id").alias("source_text_id"), "slot_id", "kind", "attaches_to",
        F.col("quote").alias("source_quote"), "annotation_status",
    )
    return (
        children.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id")
        .join(_source_texts(texts), ["run_id", "passage_id"])
        .join(of_source, ["run_id", "source_text_id"])
        .join(reader("text_id", {"model": "reader_model", "call_id": "reader_call_id"}), ["run_id", "text_id"], "left")
        .join(side("text_id", {"status": "child_status", "quote": "child_quote", "note": "reader_note"}), ["run_id", "text_id", "slot_id"], "left")
        .join(reader("parent_text_id", {"call_id": "parent_reader_call_id"}), ["run_id", "parent_text_id"], "left")
        .join(side("parent_text_id", {"status": "parent_status"}), ["run_id", "parent_text_id", "slot_id"], "left")
        .join(side("source_text_id", {"status": "source_status"}), ["run_id", "source_text_id", "slot_id"], "left")
    )


def changed_or_unread(comparisons: DataFrame) -> DataFrame:
    parent, child = F.col("parent_status"), F.col("child_status")
    return comparisons.where(~parent.eqNullSafe(child) | parent.isNull() | child.isNull())


def status_pairs(comparisons: DataFrame) -> DataFrame:
    return (
        comparisons.where(F.col("run_status") == "completed")
        .groupBy("style", "parent_status", "child_status")
        .agg(F.count("*").alias("slot_comparisons"))
    )


def beside_original(texts: DataFrame) -> DataFrame:
    parents = texts.select("run_id", F.col("text_id").alias("parent_text_id"), F.col("text").alias("original"))
    return (
        texts.where(F.col("generation") > 0)
        .join(parents, ["run_id", "parent_text_id"])
        .select("run_id", "passage_id", "generation", "style", "variant", "original", F.col("text").alias("generated"))
    )


def observations_panel(
    texts: DataFrame, slots: DataFrame, readings: DataFrame, observations: DataFrame
) -> DataFrame:
    """Every text times every source slot of its passage; ``not_read`` where missing."""
    of_passage = slots.select("run_id", "passage_id", "slot_id", "kind", "attaches_to")
    seen = _statuses(readings, observations).select("run_id", "text_id", "slot_id", "status")
    return (
        texts.select("run_id", "text_id", "passage_id", "generation", "chain_id", "norm_group", "style", "variant")
        .join(of_passage, ["run_id", "passage_id"])
        .join(seen, ["run_id", "text_id", "slot_id"], "left")
        .withColumn("status", F.coalesce("status", F.lit("not_read")))
    )


def comparison_rows(
    texts: DataFrame, slots: DataFrame, readings: DataFrame, observations: DataFrame
) -> DataFrame:
    """Generation one: literal evidence beside both reader statuses."""
    first = texts.where(F.col("generation") == 1).join(_source_texts(texts), ["run_id", "passage_id"])
    seen = _statuses(readings, observations).select("run_id", "text_id", "slot_id", "status")
    of_passage = slots.select("run_id", "passage_id", "slot_id", "kind", "quote")
    joined = (
        first.join(of_passage, ["run_id", "passage_id"])
        .join(seen.withColumnRenamed("status", "gen1_reader"), ["run_id", "text_id", "slot_id"], "left")
        .join(
            seen.select("run_id", F.col("text_id").alias("source_text_id"), "slot_id", F.col("status").alias("gen0_reader")),
            ["run_id", "source_text_id", "slot_id"],
            "left",
        )
        .fillna("not_read", ["gen0_reader", "gen1_reader"])
    )
    return quote_audit(joined).select(
        "run_id", "text_id", "slot_id", "kind", F.col("quote").alias("source_quote"), "literal_status", "occurrences",
        "gen0_reader", "gen1_reader",
    )


# --- Loss ----------------------------------------------------------------------------------------


def chain_panel(panel: DataFrame) -> DataFrame:
    """The panel per chain, with the passage's generation 0 repeated for each of its chains."""
    chains = panel.where(F.col("generation") > 0).select("run_id", "passage_id", "chain_id", "style", "variant").distinct()
    start = panel.where(F.col("generation") == 0).drop("chain_id", "style", "variant").join(chains, ["run_id", "passage_id"])
    return panel.where(F.col("generation") > 0).unionByName(start)


def first_absence(panel: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """First absent generation with censoring: observed, unresolved, not observed
    through depth, or baseline not present; and whether the slot came back.

    One aggregation with map-side partials answers it; its state is one small
    number per generation of the key.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    generation, status = F.col("generation"), F.col("status")
    inside = generation.between(1, depth)
    absent, present = status == "absent", status == "present"
    facts = panel.groupBy(*keys).agg(
        F.coalesce(F.bool_or((generation == 0) & present), F.lit(False)).alias("_baseline"),
        F.min(F.when(inside & absent, generation)).alias("_first"),
        F.collect_set(F.when(inside & (absent | present), generation)).alias("_resolved"),
        F.max(F.when(inside & present, generation)).alias("_last_present"),
    )
    end = F.coalesce("_first", F.lit(depth))
    exact = F.size(F.filter("_resolved", lambda g: g <= end)) == end  # every generation up to the end is resolved
    after = F.col("_last_present") > F.col("_first")
    return facts.select(
        *keys,
        F.when(F.col("_baseline"), F.col("_first")).alias("first_absent"),
        F.when(~F.col("_baseline"), "baseline_not_present")
        .when(~exact, "unresolved")
        .when(F.col("_first").isNotNull(), "observed")
        .otherwise("not_observed_through_depth")
        .alias("timing"),
        F.coalesce(F.col("_baseline") & after, F.lit(False)).alias("reappeared"),
    )


def ordering(q_timing: Column, q_first: Column, e_timing: Column, e_first: Column) -> Column:
    open_ended = ("unresolved", "baseline_not_present")
    return (
        F.when(q_timing.isin(*open_ended) | e_timing.isin(*open_ended), "unresolved")
        .when(q_first.isNull() & e_first.isNull(), "neither_observed_absent")
        .when(e_first.isNull() | (q_first < e_first), "qualifier_first")
        .when(q_first.isNull() | (e_first < q_first), "exception_first")
        .otherwise("same_generation")
    )


def loss_order(absences: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per chain and (qualifier, exception) pair of its passage: which went first."""
    keys = ["run_id", "chain_id", "passage_id", "style", "variant"]

    def side(name: str) -> DataFrame:
        return absences.select(
            *keys, F.col("slot_id").alias(name), F.col("first_absent").alias(f"{name}_first_absent"),
            F.col("timing").alias(f"{name}_timing"),
        )

    return (
        pairs.join(side("qualifier"), ["run_id", "passage_id", "qualifier"])
        .join(side("exception"), [*keys, "exception"])
        .withColumn(
            "ordering",
            ordering(
                F.col("qualifier_timing"), F.col("qualifier_first_absent"),
                F.col("exception_timing"), F.col("exception_first_absent"),
            ),
        )
    )


def order_counts(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("style", "ordering").agg(F.count("*").alias("pairs"))


def coverage(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Generated against planned generations per run and chain."""
    keys = ["run_id", "chain_id"]
    generated = texts.where(F.col("generation") > 0).groupBy(*keys).agg(F.count("*").alias("generated"))
    chains = cells.groupBy(*keys, "passage_id", "style", "variant").agg(F.count("*").alias("planned"))
    return (
        chains.join(generated, keys, "left")
        .fillna(0, ["generated"])
        .withColumn("complete", F.col("generated") == F.col("planned"))
    )


def texts_per_generation(texts: DataFrame, depth: int) -> DataFrame:
    """Counts for every run and generation up to depth, zero where nothing was generated."""
    counts = texts.groupBy("run_id", "generation").agg(F.count("*").alias("texts"))
    every = texts.select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("generation")
    )
    return every.join(counts, ["run_id", "generation"], "left").fillna(0, ["texts"])


def survival(panel: DataFrame) -> DataFrame:
    """Present share among read slots by run, generation and slot category, statutory passages."""
    category = (
        F.when(F.col("kind") == "exception", "Exception")
        .when(F.col("attaches_to") == "exception", "Condition on exception")
        .otherwise("Other slots")
    )
    counts = (
        panel.where(F.col("norm_group") == "statutory")
        .groupBy("run_id", "generation", category.alias("slot_category"))
        .agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("present", "absent", "uncertain", "not_read")])
    )
    available = F.col("present") + F.col("absent") + F.col("uncertain")
    return counts.withColumns(
        {
            "available": available,
            "present_fraction": F.round(F.col("present") / F.nullif(available, F.lit(0)), 6),
        }
    )


def trajectory(texts: DataFrame, slots: DataFrame, readings: DataFrame, observations: DataFrame) -> DataFrame:
    """Signed drift of each generation's reading from the source reading.

    Unread generations stay, with ``read`` false and NULL counts. ``net`` is for
    display beside the counts, never instead of them.
    """
    seen = observations.drop("text_id").join(readings.select("run_id", "call_id", "text_id"), ["run_id", "call_id"])
    points = texts.where(F.col("generation") > 0).join(_source_texts(texts), ["run_id", "passage_id"])
    read = points.join(readings.select("run_id", "text_id"), ["run_id", "text_id"], "left_semi")
    baseline = seen.select(
        "run_id", F.col("text_id").alias("source_text_id"), "slot_id", F.col("status").alias("before_status")
    )
    after = seen.select(
        "run_id", "text_id", "slot_id", F.col("status").alias("after_status"),
        F.col("seen_determinacy").alias("after_determinacy"), F.col("seen_modality").alias("after_modality"),
    )
    rows = (
        read.select("run_id", "text_id", "source_text_id", "passage_id")
        .join(
            slots.select("run_id", "passage_id", "slot_id", "kind", "attaches_to", "determinacy", "modality"),
            ["run_id", "passage_id"],
        )
        .join(baseline, ["run_id", "source_text_id", "slot_id"], "left")
        .join(after, ["run_id", "text_id", "slot_id"], "left")
    )
    measured = measure(rows, ["run_id", "text_id"])
    keys = ["run_id", "chain_id", "passage_id", "style", "variant", "generation", "text_id"]
    marked = points.select(*keys).join(
        readings.select("run_id", "text_id", F.lit(True).alias("read")), ["run_id", "text_id"], "left"
    )
    counts = [*SIGNS, "unobservable"]
    joined = marked.fillna(False, ["read"]).join(measured, ["run_id", "text_id"], "left")
    filled = {c: F.when(F.col("read"), F.coalesce(F.col(c), F.lit(0))) for c in counts}
    return joined.withColumns(filled).withColumn("net", F.col("loosening") - F.col("tightening"))


# --- Calls and reports ---------------------------------------------------------------------------


def error_summary(calls: DataFrame) -> DataFrame:
    """Failed responses by HTTP status and reason; an unparsable body is an http_error."""
    reason = F.coalesce(F.get_json_object("body", "$.error.type"), F.lit("http_error"))
    return (
        calls.where((F.col("event") == "received") & (F.col("http_status") != 200))
        .groupBy("http_status", reason.alias("reason"))
        .agg(F.count("*").alias("errors"))
    )


def settle(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Per run: what received responses cost, and what is still held.

    A hold stays only for a started call without a receipt. The model comes from
    the request, or from the response where the request is lost; a model without
    a price costs zero.
    """
    event = F.col("event")
    started, received = event == "started", event == "received"
    per_call = calls.groupBy("run_id", "call_id").agg(
        F.max(F.when(started, F.col("model"))).alias("_asked"),
        F.max(F.when(received, F.col("model"))).alias("_claimed"),
        F.max(F.when(started, F.col("reserved_usd"))).alias("_reserved"),
        F.max(F.when(received, F.col("input_tokens"))).alias("_in"),
        F.max(F.when(received, F.col("output_tokens"))).alias("_out"),
        F.bool_or(started).alias("_started"),
        F.bool_or(received).alias("_received"),
    )
    cost = call_cost(F.col("_in"), F.col("_out"), F.col("input_price"), F.col("output_price"))
    priced = per_call.withColumn("model", F.coalesce("_asked", "_claimed")).join(prices, "model", "left")
    return priced.groupBy("run_id").agg(
        F.round(F.sum(F.when(F.col("_received"), F.coalesce(cost, F.lit(0.0))).otherwise(0.0)), 6).alias("usage_estimate"),
        F.round(
            F.sum(F.when(F.col("_started") & ~F.col("_received"), F.coalesce("_reserved", F.lit(0.0))).otherwise(0.0)), 6
        ).alias("reserved"),
        F.count_if("_received").alias("receipts"),
        F.count_if(F.col("_started") & ~F.col("_received")).alias("open_calls"),
    )


def blind_packet(texts: DataFrame, questions: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(packet, key): texts in seeded order under review ids, questions only; the key apart.

    ``questions`` is (run_id, passage_id, slot_id, question), a short list per passage.
    """
    shuffled = with_ordinal(
        texts.select("run_id", "passage_id", "text_id", "text", F.sha2(F.concat_ws("|", F.lit(str(seed)), "run_id", "text_id"), 256).alias("_draw")),
        ["_draw", "run_id", "text_id"],
        "_n",
    ).withColumn(
        "review_id",
        F.concat(F.lit("review-"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(4), F.length(F.col("_n").cast("string"))), F.lit("0"))),
    )
    asked = questions.groupBy("run_id", "passage_id").agg(
        F.array_sort(F.collect_list(F.struct("slot_id", "question"))).alias("schema")
    )
    packet = shuffled.join(asked, ["run_id", "passage_id"], "left").select(
        "review_id", "text", F.coalesce("schema", F.expr("cast(array() as array<struct<slot_id:string,question:string>>)")).alias("schema")
    )
    return packet, shuffled.select("review_id", "text_id", "run_id")


def reader_scoreboard(readings: DataFrame, reference: str, by_kind: bool = False) -> DataFrame:
    """Per reader model: valid share, present share, agreement with a reference reader.

    Rows are (run_id, model, text_id, slot_id, kind, status, valid). Agreement is over
    the slots both readers answered validly in the same run.
    """
    key = ["run_id", "text_id", "slot_id"]
    against = readings.where((F.col("model") == reference) & F.col("valid")).select(
        *key, F.col("status").alias("_reference")
    )
    groups = ["model", "kind"] if by_kind else ["model"]
    share = lambda condition: F.round(F.avg(condition.cast("double")), 4)
    valid = F.col("valid")
    return readings.join(against, key, "left").groupBy(*groups).agg(
        F.count("*").alias("answers"),
        share(valid).alias("valid_share"),
        share(F.when(valid, F.col("status") == "present")).alias("present_share"),
        share(F.when(valid, F.col("status") == F.col("_reference"))).alias("agreement"),
    )


def writer_scoreboard(writes: DataFrame) -> DataFrame:
    """Per writer model: texts, mean length ratio to the parent, cost."""
    return writes.groupBy("model").agg(
        F.count("*").alias("texts"),
        F.round(F.avg(F.try_divide("chars", "source_chars")), 4).alias("mean_length_ratio"),
        F.round(F.sum("usd"), 6).alias("usd"),
    )


def latest_run(runs: DataFrame, supported: DataFrame) -> DataFrame:
    """The newest run whose two models are both supported."""
    names = supported.select("model").distinct()
    usable = runs.join(names.withColumnRenamed("model", "transformer_model"), "transformer_model", "left_semi").join(
        names.withColumnRenamed("model", "extractor_model"), "extractor_model", "left_semi"
    )
    newest = F.struct("started_at", "run_id")
    return usable.agg(F.max_by("run_id", newest).alias("run_id"), F.max("started_at").alias("started_at"))


# --- Projection of recorded evidence ----------------------------------------------------------------

RECORD_SCHEMAS = {
    "sources": (
        "passage_id string, text string, text_sha256 string, source_sha256 string, source_url string, `group` string,"
        " pair_id string, annotation_status string,"
        " slots array<struct<slot_id:string,kind:string,attaches_to:string,quote:string,question:string,"
        "determinacy:string,modality:string>>"
    ),
    "generations": (
        "text_id string, passage_id string, generation int, parent_text_id string, style string, variant string,"
        " text string, text_sha256 string, parent_sha256 string, call_id string, chain_id string"
    ),
    "readings": (
        "call_id string, text_id string, passage_id string, generation int, model string, response_id string,"
        " slots array<struct<slot_id:string,status:string,quote:string,note:string>>"
    ),
    "calls": "call_id string, event string, at string",
}


def read_records(lines: DataFrame, record: str) -> DataFrame:
    """JSON lines (run_id, value) parsed with the declared schema of a record kind."""
    parsed = lines.select("run_id", "value", F.from_json("value", RECORD_SCHEMAS[record]).alias("_r"))
    extra = ["value"] if record == "calls" else []
    return parsed.select("run_id", *extra, "_r.*")


def project_run(records: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Recorded evidence as the relational run tables.

    ``records`` holds runs (run_id, status, started_at, manifest) and parsed
    sources, generations, readings and calls; calls carry event_index. A source
    without slots keeps its texts; a generation whose source is missing is no text but
    a row of ``rejects`` with its reason.
    """
    sources, generations, readings = records["sources"], records["generations"], records["readings"]
    source_id = F.concat(F.lit("source:"), "passage_id")
    groups = sources.select(
        "run_id", "passage_id", F.coalesce("group", F.lit("statutory")).alias("norm_group"), "pair_id"
    )
    text_columns = [
        "run_id", "text_id", "passage_id", "generation", "parent_text_id", "style", "variant", "text", "text_sha256",
        "source_sha256", "source_url", "call_id", "chain_id", "norm_group", "pair_id",
    ]
    from_sources = sources.select(
        "run_id", source_id.alias("text_id"), "passage_id", F.lit(0).alias("generation"), "text", "text_sha256",
        "source_sha256", "source_url", F.coalesce("group", F.lit("statutory")).alias("norm_group"), "pair_id",
    )
    from_generations = generations.drop("parent_sha256").withColumn(
        "parent_text_id", F.coalesce("parent_text_id", source_id)
    ).join(groups.withColumn("_known", F.lit(True)), ["run_id", "passage_id"], "left")
    orphans = from_generations.where("_known IS NULL").select(
        "run_id", "text_id", "passage_id", F.lit("source missing").alias("reason")
    )
    from_generations = from_generations.where("_known").drop("_known")
    slot = sources.select("run_id", source_id.alias("text_id"), "annotation_status", F.explode("slots").alias("s"))
    read_text = F.when(F.col("generation") == 0, source_id).otherwise(F.col("text_id"))
    observed = readings.select("run_id", "call_id", F.explode("slots").alias("s"))
    return {
        "runs": records["runs"],
        "texts": from_sources.unionByName(from_generations, allowMissingColumns=True).select(*text_columns),
        "source_slots": slot.select(
            "run_id", "text_id", "s.slot_id", "s.kind", "s.attaches_to", "s.quote", "annotation_status"
        ),
        "readings": readings.select("run_id", "call_id", read_text.alias("text_id"), "model", "response_id"),
        "slot_observations": observed.select("run_id", "call_id", "s.slot_id", "s.status", "s.quote", "s.note"),
        "call_events": records["calls"].select(
            "run_id", "event_index", "call_id", "event", F.col("value").alias("receipt")
        ),
        "rejects": orphans,
    }
