"""Passage ids resolved to text and lineage, per domain, with every check that must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_passages(specs: DataFrame, provisions: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """specs: passage_id, domain, and for inline passages text and text_sha256.

    Statute ids are ``document:suffix``, specification ids ``document:section``.
    Every spec comes back with its text or the first ``problem``: invalid id, hash
    mismatch, no or several matches, empty text.
    """
    known = documents.select(
        "document_id", F.col("title").alias("_title"), F.col("source_page_url").alias("_page"), "source_sha256",
        (F.sha2("raw_xml", 256) == F.col("source_sha256")).alias("_hash_ok"),
    )
    held = provisions.select(F.lit("statute").alias("domain"), "document_id", F.col("provision_suffix").alias("_part"), "text", "source_anchor").unionByName(
        sections.select(
            F.lit("specification").alias("domain"), "document_id", F.col("section").alias("_part"), "text",
            F.concat(F.lit("section-"), "section").alias("source_anchor"),
        )
    )
    split = specs.withColumns(
        {
            "document_id": F.when(F.col("domain") != "inline", F.substring_index("passage_id", ":", 1)),
            "_part": F.when(
                (F.col("domain") != "inline") & F.contains("passage_id", F.lit(":")),
                F.substring(F.col("passage_id"), F.instr("passage_id", F.lit(":")) + 1, F.length("passage_id")),
            ),
        }
    )
    keys = ["domain", "document_id", "_part"]
    held = held.join(split.select(*keys).distinct(), keys, "left_semi")  # only wanted texts are moved
    # One text per id and a count, so a repeated id is reported without gathering its texts.
    unique = held.groupBy("domain", "document_id", "_part").agg(
        F.count("*").alias("_matches"), F.min("text").alias("_text"), F.min("source_anchor").alias("_anchor")
    )
    joined = split.join(known, "document_id", "left").join(unique, ["domain", "document_id", "_part"], "left")
    inline = F.col("domain") == "inline"
    body = F.when(inline, F.col("text")).otherwise(F.col("_text"))
    empty = F.trim(F.coalesce(body, F.lit(""))) == ""
    problem = (
        F.when(inline & empty, "inline passage carries no text")
        .when(inline & F.col("text_sha256").isNull(), "inline passage pins no hash")
        .when(inline & (F.sha2("text", 256) != F.col("text_sha256")), "text hash mismatch")
        .when(~inline & (F.coalesce("_part", F.lit("")) == ""), "invalid passage id")
        .when(~inline & F.col("_hash_ok").isNull(), "document missing")
        .when(~inline & ~F.col("_hash_ok"), "source hash mismatch")
        .when(~inline & F.col("_matches").isNull(), "no such passage")
        .when(~inline & (F.col("_matches") > 1), "several passages with this id")
        .when(empty, "empty text")
    )
    return joined.select(
        "passage_id",
        "domain",
        F.when(problem.isNull(), body).alias("text"),
        F.when(problem.isNull() & ~inline, F.concat_ws("#", "_page", "_anchor")).alias("source_url"),
        F.when(problem.isNull() & ~inline, F.col("source_sha256")).alias("source_sha256"),
        problem.alias("problem"),
    )
