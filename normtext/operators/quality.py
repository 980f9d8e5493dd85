"""Data-quality and contract checks. Each returns a report; ``enforce`` raises on it.

Reports are aggregates with map-side partials or equi-joins; uniqueness is a
grouped count, never a window over a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.functions.text import occurrences, squeeze


class ContractError(ValueError):
    """A contract report holds rows; the message shows the first of them."""


def enforce(report: DataFrame, what: str, show: int = 5) -> None:
    """Raises unless the report is empty. Only ``show`` rows reach the driver."""
    rows = report.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def expect(
    df: DataFrame,
    key: str,
    not_null: Sequence[str] = (),
    unique: Sequence[str] = (),
    between: Mapping[str, tuple[float, float]] | None = None,
    rows_between: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per rule: unexpected rows and whether it holds."""
    ranges = between or {}
    plain = {f"not_null({c})": F.count_if(F.col(c).isNull()) for c in not_null}
    plain |= {f"between({c})": F.count_if(~F.col(c).between(lo, hi)) for c, (lo, hi) in ranges.items()}
    if rows_between:
        low, high = rows_between
        plain["row_count"] = F.when(F.count("*").between(low, high), F.lit(0)).otherwise(F.count("*"))
    parts = []
    if plain:
        counted = df.agg(*[v.cast("long").alias(f"_{i}") for i, v in enumerate(plain.values())])
        rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("unexpected")) for i, n in enumerate(plain)])
        parts.append(counted.select(F.explode(rules).alias("r")).select("r.*"))
    for column in unique:
        repeated = duplicate_keys(df, [column]).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("unexpected"))
        parts.append(repeated.select(F.lit(f"unique({column})").alias("rule"), "unexpected"))
    return reduce(DataFrame.unionByName, parts).withColumn("success", F.col("unexpected") == 0)


def unexpected_rows(df: DataFrame, key: str, not_null: Sequence[str] = (), between: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """The key of every row that breaks a row rule, with the rule."""
    broken = [F.when(F.col(c).isNull(), f"not_null({c})") for c in not_null]
    broken += [F.when(~F.col(c).between(lo, hi), f"between({c})") for c, (lo, hi) in (between or {}).items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def coverage_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: missing from actual, or unexpected in it."""
    left = expected.select(key).distinct().withColumn("_e", F.lit(True))
    right = actual.select(key).distinct().withColumn("_a", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.where(F.col("_e").isNull() | F.col("_a").isNull()).select(
        key, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("problem")
    )


def missing_lineage(df: DataFrame, columns: Sequence[str] = ("source_sha256",)) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *[F.count_if(blank(c)).alias(f"missing_{c}") for c in columns])


def reconcile(gold: DataFrame, silver: DataFrame, count: str = "provision_count", key: str = "provision_id") -> DataFrame:
    """Sum of the group counts against the distinct ids upstream."""
    total = gold.agg(F.coalesce(F.sum(count), F.lit(0)).alias("gold_total"))
    distinct = silver.agg(F.countDistinct(key)).scalar()
    return total.withColumn("silver_total", distinct).withColumn("reconciled", F.col("gold_total") == F.col("silver_total"))


def check_chunks(chunks: DataFrame, provisions: DataFrame) -> DataFrame:
    """Lineage, size limits, unique ids, and whether the ordered parts rebuild the text.

    Parts are only collected for provisions whose part lengths add up to the text's
    own length, so no group can outgrow the text it must equal.
    """
    problem = lambda df, name: df.select(F.col("provision_id"), F.lit(name).alias("problem"))
    row_problems = chunks.select(
        "provision_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("retrieval_char_count") > fv.MAX_RETRIEVAL_CHARS, "too many characters"),
                    F.when(F.octet_length("retrieval_text") > fv.MAX_RETRIEVAL_BYTES, "too many bytes"),
                    F.when(blank("source_sha256"), "no lineage"),
                )
            )
        ).alias("problem"),
    )
    repeated = chunks.groupBy("provision_id", "chunk_id").agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = chunks.groupBy("provision_id").agg(
        (F.sum(F.length("content")) + 2 * (F.count("*") - 1)).alias("_length")
    )
    texts = provisions.select("provision_id", "text", F.length("text").alias("_want"))
    sized = texts.drop("text").join(sizes, "provision_id", "left")
    wrong_size = sized.where(~F.col("_length").eqNullSafe(F.col("_want")))
    right_size = sized.where(F.col("_length") == F.col("_want")).select("provision_id")
    rebuilt = (
        chunks.join(right_size, "provision_id", "left_semi")
        .groupBy("provision_id")
        .agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("_parts"))
        .select("provision_id", F.array_join(F.transform("_parts", lambda p: p["content"]), "\n\n").alias("_rebuilt"))
    )
    differs = texts.join(rebuilt, "provision_id").where(F.col("_rebuilt") != F.col("text"))
    return (
        row_problems.unionByName(problem(repeated, "repeated chunk id"))
        .unionByName(problem(wrong_size, "parts do not rebuild the text"))
        .unionByName(problem(differs, "parts do not rebuild the text"))
    )


def check_pool(provisions: DataFrame, expected_documents: int | None = None, expected_provisions: int | None = None) -> DataFrame:
    """Every way a build breaks its pool's contract; empty means clean."""
    counts = provisions.agg(
        F.countDistinct("document_id").alias("documents"),
        F.count("*").alias("provisions"),
        F.count_if(blank("source_sha256")).alias("unsourced"),
    ).withColumn("duplicates", duplicate_keys(provisions, ["provision_id"]).agg(F.count("*")).scalar())
    expected = lambda name, want: F.when(
        F.col(name) != want, F.concat(F.lit(f"{name}: expected {want}, got "), F.col(name).cast("string"))
    )
    problems = [
        expected("documents", expected_documents) if expected_documents is not None else F.lit(None).cast("string"),
        expected("provisions", expected_provisions) if expected_provisions is not None else F.lit(None).cast("string"),
        F.when(F.col("duplicates") > 0, F.concat(F.lit("duplicate provision_id: "), F.col("duplicates").cast("string"))),
        F.when(F.col("unsourced") > 0, F.concat(F.lit("provisions without source_sha256: "), F.col("unsourced").cast("string"))),
    ]
    return counts.select(F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def check_slots(passages: DataFrame) -> DataFrame:
    """Slot contract per passage: ids, vocabulary, question, rungs, and a quote that occurs once."""
    ids = F.transform("slots", lambda s: s["slot_id"])
    text = F.col("text")

    def broken(slot: Column) -> Column:
        return F.struct(
            slot["slot_id"].alias("slot_id"),
            F.when(~F.coalesce(slot["kind"].isin(*fv.SLOT_KINDS), F.lit(False)), "unknown kind")
            .when(~F.coalesce(slot["attaches_to"].isin(*fv.ATTACHMENTS), F.lit(False)), "unknown attachment")
            .when(F.trim(F.coalesce(slot["question"], F.lit(""))) == "", "no question")
            .when(slot["determinacy"].isNotNull() & ~slot["determinacy"].isin(*fv.DETERMINACY_RUNGS), "unknown determinacy")
            .when(slot["modality"].isNotNull() & ~slot["modality"].isin(*fv.MODALITY_RUNGS), "unknown modality")
            .when(slot["quote"].isNotNull() & (slot["quote"] == ""), "quote does not occur exactly once")
            .when(slot["quote"].isNotNull() & (occurrences(text, slot["quote"]) != 1), "quote does not occur exactly once")
            .alias("problem"),
        )

    rows = F.transform("slots", broken)
    repeated = F.when(
        F.size(F.array_distinct(ids)) != F.size(ids),
        F.array(F.struct(F.lit(None).cast("string").alias("slot_id"), F.lit("duplicate slot ids").alias("problem"))),
    ).otherwise(F.expr("cast(array() as array<struct<slot_id:string,problem:string>>)"))
    none = F.when(
        F.size("slots") == 0,
        F.array(F.struct(F.lit(None).cast("string").alias("slot_id"), F.lit("no slots").alias("problem"))),
    ).otherwise(F.expr("cast(array() as array<struct<slot_id:string,problem:string>>)"))
    found = F.filter(F.concat(rows, repeated, none), lambda r: r["problem"].isNotNull())
    return passages.select("passage_id", F.explode(found).alias("r")).select("passage_id", "r.*")


def check_passages(passages: DataFrame) -> DataFrame:
    """Passage contract: required fields, known group, text hash, unique id."""
    required = ["passage_id", "group", "topic", "text", "text_sha256", "source"]
    reason = F.lit(None).cast("string")
    for column in reversed(required):
        reason = F.when(blank(column), f"missing {column}").otherwise(reason)
    reason = F.coalesce(
        reason,
        F.when(~F.col("group").isin(*fv.PASSAGE_GROUPS), "unknown group").when(
            F.sha2("text", 256) != F.col("text_sha256"), "text hash mismatch"
        ),
    )
    rows = passages.select("passage_id", reason.alias("problem")).where(F.col("problem").isNotNull())
    repeated = duplicate_keys(passages, ["passage_id"]).select("passage_id", F.lit("duplicate passage_id").alias("problem"))
    return rows.unionByName(repeated)


ANSWER = "struct<slots:array<struct<slot_id:string,status:string,quote:string,note:string>>>"
ROW_KEYS = ("note", "quote", "slot_id", "status")  # fixed values: the fields an answer row must have


def check_readings(answers: DataFrame) -> DataFrame:
    """Validates JSON answers (answer, text, asked = slot ids) -> valid, reason.

    The first broken rule is the reason.
    """
    parsed = F.col("_a.slots")
    ids = F.transform(parsed, lambda r: r["slot_id"])
    shapes = F.from_json("answer", "struct<slots:array<map<string,string>>>")["slots"]
    shaped = F.forall(shapes, lambda row: F.array_join(F.array_sort(F.map_keys(row)), ",") == ",".join(ROW_KEYS))
    top = F.json_object_keys("answer")
    quote_ok = lambda q: (F.trim(q) != "") & F.contains(F.col("text"), q)
    filled = lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    reason = (
        F.when(top.isNull() | (F.array_join(top, ",") != "slots"), "answer must contain only slots")
        .when(parsed.isNull(), "slots must be a list of objects")
        .when(
            (F.size(ids) != F.size(F.array_distinct(ids)))
            | (F.size(F.array_except(ids, "asked")) > 0)
            | (F.size(F.array_except("asked", ids)) > 0),
            "missing, duplicate or unknown slot ids",
        )
        .when(~yes(shaped), "unexpected fields")
        .when(~F.forall(parsed, lambda r: yes(r["status"].isin(*fv.STATUSES))), "unknown status")
        .when(~F.forall(parsed, lambda r: filled(r["note"])), "note required")
        .when(~F.forall(parsed, lambda r: (r["status"] != "present") | filled(r["quote"])), "present slot needs a quote")
        .when(~F.forall(parsed, lambda r: (r["status"] != "absent") | r["quote"].isNull()), "absent slot has a quote")
        .when(~F.forall(parsed, lambda r: r["quote"].isNull() | quote_ok(r["quote"])), "quote is not in the text")
    )
    return (
        answers.withColumn("_a", F.from_json("answer", ANSWER))
        .withColumn("reason", reason)
        .withColumn("valid", F.col("reason").isNull())
        .drop("_a")
    )


def check_spans(spans: DataFrame) -> DataFrame:
    """Adds whether the span is the text at its offset, and whether it occurs in the
    text once whitespace is squeezed on both sides."""
    text, span = F.col("text"), F.col("span")
    return spans.withColumns(
        {
            "verbatim": F.substring(text, F.col("char_offset") + 1, F.length(span)) == span,
            "verbatim_squeezed": F.contains(squeeze(text), squeeze(span)),
        }
    )


def audit_run(runs: DataFrame, texts: DataFrame, readings: DataFrame) -> DataFrame:
    """Problems of recorded runs: hashes, repeated ids, lineage between generations,
    chain metadata, and planned counts of completed runs.

    texts: run_id, text_id, passage_id, generation, parent_text_id, parent_sha256,
    chain_id, style, variant, text, text_sha256. readings: run_id, text_id, passage_id,
    generation. runs: run_id, status, planned_transformations, planned_readings.
    """
    named = lambda df, problem, key="text_id": df.select("run_id", F.col(key).cast("string").alias("id"), F.lit(problem).alias("problem"))
    wrong_hash = texts.where(F.sha2("text", 256) != F.col("text_sha256"))
    repeated_text = duplicate_keys(texts, ["run_id", "text_id"])
    repeated_reading = duplicate_keys(readings, ["run_id", "text_id"])
    parent = texts.select(
        "run_id", F.col("text_id").alias("parent_text_id"), F.col("generation").alias("_g"),
        F.col("text_sha256").alias("_sha"), F.struct("chain_id", "style", "variant").alias("_chain"), F.col("passage_id").alias("_passage"),
    )
    children = texts.where(F.col("generation") > 0).join(parent, ["run_id", "parent_text_id"], "left")
    lineage = children.select(
        "run_id",
        F.col("text_id").alias("id"),
        F.when(F.col("_g").isNull(), "parent text is missing")
        .when(F.col("generation") != F.col("_g") + 1, "generation is not parent + 1")
        .when(F.col("parent_sha256") != F.col("_sha"), "parent hash mismatch")
        .when(F.col("passage_id") != F.col("_passage"), "chain metadata mismatch")
        .when((F.col("_g") > 0) & ~F.struct("chain_id", "style", "variant").eqNullSafe(F.col("_chain")), "chain metadata mismatch")
        .alias("problem"),
    ).where(F.col("problem").isNotNull())
    made = texts.where(F.col("generation") > 0).groupBy("run_id").agg(F.count("*").alias("_made"))
    read = readings.groupBy("run_id").agg(F.count("*").alias("_read"))
    short = (
        runs.where(F.col("status") == "completed")
        .join(made, "run_id", "left")
        .join(read, "run_id", "left")
        .where(
            (F.coalesce("_made", F.lit(0)) != F.col("planned_transformations"))
            | (F.coalesce("_read", F.lit(0)) != F.col("planned_readings"))
        )
    )
    repeated_source = duplicate_keys(texts.where(F.col("generation") == 0), ["run_id", "passage_id"])
    read_text = texts.select("run_id", "text_id", F.col("passage_id").alias("_passage"), F.col("generation").alias("_g"))
    misread = readings.join(read_text, ["run_id", "text_id"]).where(
        ~F.col("passage_id").eqNullSafe(F.col("_passage")) | ~F.col("generation").eqNullSafe(F.col("_g"))
    )
    unknown = readings.join(texts.select("run_id", "text_id"), ["run_id", "text_id"], "left_anti")
    reports = [
        named(wrong_hash, "text hash mismatch"),
        named(repeated_text, "repeated text id"),
        named(repeated_reading, "several readings of one text"),
        named(unknown, "reading of an unknown text"),
        named(misread, "reading target metadata mismatch"),
        named(repeated_source, "duplicate source passage", "passage_id"),
        lineage,
        named(short, "completed run misses generations or readings", "run_id"),
    ]
    return reduce(DataFrame.unionByName, reports)


RUN_KEYS = {  # fixed values: primary keys of the run tables
    "runs": ["run_id"],
    "texts": ["run_id", "text_id"],
    "source_slots": ["run_id", "text_id", "slot_id"],
    "readings": ["run_id", "call_id"],
    "slot_observations": ["run_id", "call_id", "slot_id"],
    "call_events": ["run_id", "event_index"],
}
RUN_REFERENCES = [  # fixed values: child, parent, columns
    ("texts", "runs", ["run_id"]),
    ("source_slots", "texts", ["run_id", "text_id"]),
    ("readings", "texts", ["run_id", "text_id"]),
    ("slot_observations", "readings", ["run_id", "call_id"]),
    ("call_events", "runs", ["run_id"]),
]


def check_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows breaking each primary key, foreign key and value check of the run tables."""
    reports = []

    def add(table: str, rule: str, broken: DataFrame) -> None:
        reports.append(broken.agg(F.count("*").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"
        ))

    for table, keys in RUN_KEYS.items():
        if table in tables:
            add(table, f"primary key ({', '.join(keys)})", duplicate_keys(tables[table], keys))
    for child, parent, keys in RUN_REFERENCES:
        if child in tables and parent in tables:
            orphan = tables[child].join(tables[parent].select(*keys).distinct(), keys, "left_anti")
            add(child, f"references {parent} ({', '.join(keys)})", orphan)
    if "texts" in tables:
        add("texts", "generation >= 0", tables["texts"].where(F.col("generation") < 0))
    if "slot_observations" in tables:
        add("slot_observations", "known status", tables["slot_observations"].where(~F.col("status").isin(*fv.STATUSES)))
    return reduce(DataFrame.unionByName, reports)
