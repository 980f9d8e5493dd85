"""The given tables seen as the engine's inputs.

The given texts hold no Swedish and no deontic words, so these bindings bring a
stand-in lexicon of frequent function words. Every binding reads its whole table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normtext.lexicon import Lexicon, Marker
from normtext.session import dealt

STAND_IN = Lexicon(
    markers=(
        Marker("duty", "the", r"\bthe\b", 2),
        Marker("duty", "with", r"\bwith\b", 1),
        Marker("exception", "and that", r"\band\s+(?:\w+\s+){0,3}?that\b", 3),
        Marker("exception", "are", r"\bare\b", 2),
        Marker("exception", "unless", r"\bunless\b", 3),
        Marker("qualifier", "of", r"\bof\b", 1),
        Marker("qualifier", "by", r"\bby\b", 2),
        Marker("qualifier", "for", r"\bfor\s+\w+\b", 2),
    ),
    specific=r"\b(?:is|was)\s+(?:the|in)\b|\bin\s+the\b",
    vague=r"\bth\b|\bto\s+the\b",
    clause_boundary=r"[,;:]|\b(?:of|is|to)\b",
    ceiling_opener=r"\bthat\b",
    ceiling_bound=r"\b(?:to|for|with\s+(?:\w+\s+){0,2}?the)\b",
)
EARLIER_SPECIFIC = r"\bin\s+the\b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the lineage columns a bronze row has."""
    docs = dealt(table(spark, sf_dir, "documents"))
    document_id = F.concat(F.lit("doc-"), F.col("doc_id"))
    return docs.select(
        document_id.alias("document_id"),
        F.col("source").alias("title"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("version"),
        F.col("lang"),
        F.concat(F.lit("http://texts.example/"), document_id).alias("source_page_url"),
        F.sha2("text", 256).alias("source_sha256"),
        F.concat_ws(":", document_id, F.sha2("text", 256)).alias("document_snapshot_id"),
        F.col("text"),
        F.col("n_chars"),
    )


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provision per non-blank line of every document."""
    docs = documents(spark, sf_dir)
    line = F.col("line")
    return (
        docs.select("*", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .where(F.trim(line) != "")
        .select(
            F.concat("document_id", F.lit(":P"), F.col("at") + 1).alias("provision_id"),
            "document_id",
            "document_snapshot_id",
            F.col("title").alias("document_title"),
            F.col("version").alias("document_version"),
            F.lit("paragraph").alias("kind"),
            F.col("lang").alias("chapter"),
            F.col("title").alias("heading"),
            F.concat(F.lit("P"), F.col("at") + 1).alias("label"),
            (F.col("at") + 1).cast("int").alias("order"),
            line.alias("text"),
            F.length(line).cast("int").alias("char_count"),
            F.concat(F.col("source_page_url"), F.lit("#P"), F.col("at") + 1).alias("source_url"),
            "source_sha256",
        )
    )


# --- Runs: conversations as chains of rewritten texts -------------------------------------------

SLOTS = [  # slot_id, kind, attaches_to, quote, determinacy, modality
    ("operator", "modality", "duty", "the", None, "binding"),
    ("time_limit", "deadline", "duty", "of", "specific", None),
    ("carve_out", "exception", "exception", "and", None, None),
    ("carve_out_condition", "condition", "exception", "with", "vague", None),
    ("cap", "bound", "ceiling", "in", "specific", None),
    ("party", "actor", "duty", "to", None, None),
]
NESTED_SLOTS = [dict(zip(("slot_id", "kind", "attaches_to", "quote", "determinacy", "modality"), row)) for row in SLOTS]
SLOT_SCHEMA = (
    "slot_id string, kind string, attaches_to string, quote string, determinacy string, modality string"
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn 0 is the source text of a passage, each later turn one generation of its chain.

    Three runs hold passages, chains and texts of the same ids.
    """
    turns = table(spark, sf_dir, "conversations")
    number = F.expr("conv_id div 3")
    conv, turn = number.cast("string"), F.col("turn").cast("int")
    style = F.when(number % 2 == 0, "paraphrase").otherwise("allegorize")
    generated = turn > 0
    chain = F.concat(F.lit("conv-"), conv, F.lit(":"), style, F.lit(":a"))
    return turns.select(
        F.concat(F.lit("run-"), (F.col("conv_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("conv-"), conv, F.lit(":"), turn.cast("string")).alias("text_id"),
        F.concat(F.lit("conv-"), conv).alias("passage_id"),
        turn.alias("generation"),
        F.when(generated, F.concat(F.lit("conv-"), conv, F.lit(":"), (turn - 1).cast("string"))).alias("parent_text_id"),
        F.when(generated, style).alias("style"),
        F.when(generated, F.lit("a")).alias("variant"),
        F.when(generated, chain).alias("chain_id"),
        F.when(number % 4 == 0, "categorical").otherwise("statutory").alias("norm_group"),
        F.when(number % 4 == 0, F.concat(F.lit("pair-"), conv)).alias("pair_id"),
        F.col("text"),
        F.sha2("text", 256).alias("text_sha256"),
        F.length("text").alias("chars"),
        F.col("role"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).where(F.col("generation") == 0)


def _held_slots():
    """The slots whose quote stands in the row's text, as an array."""
    vocabulary = F.from_json(F.lit(json.dumps(NESTED_SLOTS)), f"array<struct<{SLOT_SCHEMA.replace(' string', ':string')}>>")
    return F.filter(vocabulary, lambda s: F.contains("text", s["quote"]))


def source_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot stands in a passage if its source text holds the quote."""
    return (
        sources(spark, sf_dir)
        .select("run_id", "text_id", "passage_id", "chars", F.explode(_held_slots()).alias("s"))
        .select(
            "run_id", "text_id", "passage_id", "s.*",
            F.when(F.col("chars") % 2 == 0, "draft").otherwise("ratified").alias("annotation_status"),
        )
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per text, except where the length says it was never read."""
    return (
        texts(spark, sf_dir)
        .where(F.col("chars") % 7 != 0)
        .select(
            "run_id",
            F.concat(F.lit("read:"), "text_id").alias("call_id"),
            "text_id",
            "passage_id",
            "generation",
            F.concat(F.lit("reader-"), F.col("role")).alias("model"),
            "text",
            "chars",
        )
    )


def slot_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verbatim reader's answer for every slot of the passage, with the rung it saw."""
    read = readings(spark, sf_dir)
    slots = source_slots(spark, sf_dir).select("run_id", "passage_id", "slot_id", "quote")
    present = F.contains("text", F.col("quote"))
    status = F.when(F.col("chars") % 5 == 0, "uncertain").when(present, "present").otherwise("absent")
    return read.join(slots, ["run_id", "passage_id"]).select(
        "run_id",
        "call_id",
        "text_id",
        "slot_id",
        status.alias("status"),
        F.when(present, F.col("quote")).alias("quote"),
        F.concat(F.lit("note "), F.col("chars").cast("string")).alias("note"),
        F.when(F.contains("text", F.concat("quote", F.lit(" the"))), "specific")
        .when(F.col("chars") % 3 != 0, "vague")
        .alias("seen_determinacy"),
        F.when(F.contains("text", F.lit(" is ")), "binding").when(F.col("chars") % 3 != 0, "weak").alias("seen_modality"),
    )


# --- Annotated passages and the selection axis ---------------------------------------------------

def annotated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source turns with the slots whose quote they hold, as an array on the row."""
    return sources(spark, sf_dir).select(
        F.concat_ws(":", "run_id", "passage_id").alias("passage_id"),  # runs repeat the ids of passages
        F.col("run_id").alias("experiment"),
        F.when(F.col("role") == "system", "inline").otherwise("statute").alias("domain"),
        F.col("norm_group").alias("group"),
        "text",
        _held_slots().alias("slots"),
    )


GROUP_NAMES = ["virtue", "categorical", "conditional", "statutory"]


def axis_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as axis passages; neighbours form pairs, the language is the topic."""
    docs = dealt(table(spark, sf_dir, "documents"))
    group = F.element_at(F.array(*[F.lit(g) for g in GROUP_NAMES]), (F.col("doc_id") % 4).cast("int") + 1)
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("passage_id"),
        group.alias("group"),
        F.col("lang").alias("topic"),
        F.when(F.col("doc_id") % 40 != 1, F.concat(F.lit("pair-"), F.floor(F.col("doc_id") / 4).cast("string"))).alias("pair_id"),
        "text",
        F.sha2("text", 256).alias("text_sha256"),
        F.col("source"),
    )
