"""Bronze documents: JSON envelopes, XML payloads and the source integrity audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRONZE_FIELDS = [
    "document_snapshot_id", "document_id", "designation", "title", "version", "department", "source_type",
    "source_subtype", "issued_at", "published_at", "retrieved_at", "source_page_url", "source_data_url",
    "source_raw_file", "source_sha256",
]
BRONZE_SCHEMA = ", ".join(f"{f} string" for f in BRONZE_FIELDS) + ", payload_size_bytes long, text string, html string, raw_xml string"


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bronze JSON files, one document each -> (documents, rejects)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return parse_envelopes(files)


def parse_envelopes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_name, value) -> documents with the declared schema, and rejects with a reason.

    The file stem must equal the document id inside.
    """
    stem = F.regexp_replace("file_name", r"\.json$", "")
    parsed = files.select("file_name", stem.alias("_stem"), F.from_json("value", BRONZE_SCHEMA).alias("_d")).withColumn(
        "reason",
        F.when(F.col("_d.document_id").isNull(), "no document_id")
        .when(F.col("_d.document_id") != F.col("_stem"), "file stem differs from document_id"),
    )
    documents = parsed.where(F.col("reason").isNull()).select("_d.*").withColumn("bronze_ingested_at", F.current_timestamp())
    return documents, parsed.where(F.col("reason").isNotNull()).select("file_name", F.col("_d.document_id").alias("document_id"), "reason")


XML_FIELDS = {  # fixed values: element -> column, required
    "dok_id": ("document_id", True),
    "beteckning": ("designation", True),
    "titel": ("title", True),
    "subtitel": ("version", False),
    "organ": ("department", True),
    "typ": ("source_type", True),
    "subtyp": ("source_subtype", True),
    "datum": ("issued_at", True),
    "publicerad": ("published_at", True),
    "text": ("text", True),
    "html": ("html", True),
}
PAYLOADS = ("text", "html")


def documents_from_xml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected_id, content, source_data_url, source_page_url, retrieved_at) -> (documents, rejects).

    ``content`` is the raw bytes. Each payload is parsed once into a declared
    struct. Payload fields keep their spaces; the others are trimmed.
    """
    fields = ", ".join(f"{f}: string" for f in XML_FIELDS)
    options = {"ignoreSurroundingSpaces": "false"}
    raw = F.col("content").cast("string")
    checked = files.withColumn("_lossless", F.is_valid_utf8(raw)).withColumn("raw_xml", F.when(F.col("_lossless"), raw))
    # The generator keeps the optimizer from repeating the parse for every field.
    document = F.from_xml("raw_xml", f"dokument struct<{fields}>", options)
    parsed = checked.select("*", F.explode(F.array(document)).alias("_x")).withColumn("_d", F.col("_x.dokument"))
    values = {
        column: F.col(f"_d.{element}") if column in PAYLOADS else F.nullif(F.trim(F.col(f"_d.{element}")), F.lit(""))
        for element, (column, _) in XML_FIELDS.items()
    }
    wide = parsed.withColumns(values)
    reason = F.when(~F.col("_lossless"), "not lossless UTF-8").when(F.col("_d").isNull(), "no dokument element")
    for element, (column, required) in XML_FIELDS.items():
        if required:
            reason = reason.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", f"missing {element}")
    reason = reason.when(F.col("document_id") != F.col("expected_id"), "document id mismatch").when(
        (F.col("source_type") != "sfs") | (F.col("source_subtype") != "sfst"), "unexpected document type"
    )
    judged = wide.withColumn("reason", reason)
    sha = F.sha2("content", 256)
    documents = judged.where(F.col("reason").isNull()).select(
        F.concat_ws(":", "document_id", sha).alias("document_snapshot_id"),
        *[column for column, _ in XML_FIELDS.values()],
        "retrieved_at",
        "source_page_url",
        "source_data_url",
        F.concat("document_id", F.lit(".xml")).alias("source_raw_file"),
        sha.alias("source_sha256"),
        F.octet_length("content").cast("long").alias("payload_size_bytes"),
        "raw_xml",
    )
    return documents, judged.where(F.col("reason").isNotNull()).select("expected_id", "reason")


def audit_sources(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recomputed hash against the recorded one, and both against the manifest
    (document_id, raw_sha256), documents on either side included."""
    actual = documents.select(
        "document_id", "source_sha256", (F.sha2("raw_xml", 256) == F.col("source_sha256")).alias("hash_ok")
    )
    both = actual.join(manifest.select("document_id", "raw_sha256"), "document_id", "full_outer")
    return both.select(
        "document_id",
        F.coalesce("hash_ok", F.lit(False)).alias("hash_ok"),
        F.when(F.col("source_sha256").isNull(), "missing document")
        .when(F.col("raw_sha256").isNull(), "not in manifest")
        .when(F.col("source_sha256") != F.col("raw_sha256"), "manifest hash differs")
        .otherwise("ok")
        .alias("manifest_status"),
    )
