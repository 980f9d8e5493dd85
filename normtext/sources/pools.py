"""Pool selection, incremental intake and the silver build."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.operators.quality import enforce


def title_rule(
    title: Column,
    must: Sequence[str] = tuple(fv.TITLE_MUST_CONTAIN),
    must_not: Sequence[str] = tuple(fv.TITLE_MUST_NOT_CONTAIN),
) -> Column:
    lowered = F.lower(title)
    wanted = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in must], F.lit(False))
    banned = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in must_not], F.lit(False))
    return wanted & ~banned


def select_pool(listing: DataFrame, seeds: DataFrame, count: int, rule: Column) -> DataFrame:
    """Seeds first, then the newest titles passing the rule, until ``count`` ids.

    listing: document_id, title, issued_at. The fill is a top-n, so only ``count``
    rows per task reach the last step. Repeated ids count once.
    """
    fixed = seeds.select("document_id").distinct().withColumn("selected_as", F.lit("seed"))
    taken = fixed.agg(F.count("*")).scalar()
    newest = (
        listing.where(rule)
        .groupBy("document_id")
        .agg(F.max("issued_at").alias("issued_at"))
        .join(fixed.select("document_id"), "document_id", "left_anti")
        .orderBy(F.desc("issued_at"), "document_id")
        .limit(count)
    )
    place = F.row_number().over(Window.orderBy(F.desc("issued_at"), "document_id"))  # at most `count` rows
    fill = (
        newest.withColumn("_n", place)
        .where(F.col("_n") <= F.lit(count) - taken)
        .select("document_id", F.lit("newest").alias("selected_as"))
    )
    return fixed.unionByName(fill)


def new_documents(incoming: DataFrame, existing: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows, failures). Stored ids are kept as they are; only ids not yet stored
    come through, and an invalid one is set apart instead of ending the run."""
    fresh = incoming.join(existing.select("document_id"), "document_id", "left_anti")
    ok = F.coalesce(valid, F.lit(False))
    return fresh.where(ok), fresh.where(~ok).select("document_id")


def enrich(provisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Silver rows: provisions with their document's lineage, ids and anchored url."""
    lineage = documents.select(
        "document_id",
        "document_snapshot_id",
        F.col("title").alias("document_title"),
        F.col("version").alias("document_version"),
        "source_page_url",
        "source_sha256",
        "bronze_ingested_at",
    )
    hashed = provisions.withColumn("_text_sha256", F.sha2("text", 256))  # before the join: a text that nobody asks for isn't moved
    return hashed.join(lineage, "document_id", "left").select(
        F.concat_ws(":", "document_id", "provision_suffix").alias("provision_id"),
        "*",
        F.when(F.coalesce("source_page_url", F.lit("")) != "", F.concat_ws("#", "source_page_url", "source_anchor"))
        .otherwise("")
        .alias("source_url"),
        F.col("_text_sha256").alias("provision_text_sha256"),
        F.current_timestamp().alias("silver_transformed_at"),
    ).drop("_text_sha256")


def unparsable(documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """Documents that gave no provision."""
    return documents.select("document_id").join(provisions.select("document_id").distinct(), "document_id", "left_anti")


def build_provisions(documents: DataFrame, provisions: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(provisions, unparsable ids). A strict build fails if any document is unparsable."""
    lost = unparsable(documents, provisions)
    if strict:
        enforce(lost, "documents without provisions")
    return provisions, lost
