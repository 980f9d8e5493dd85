"""The corpus pipeline: language, exact and near deduplication, decontamination, packing.

Each stage takes all its predecessor kept, read back from the Parquet it was written to,
and returns the columns of ``documents`` as they were; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from normtext.llm.decontaminate import drop_contaminated
from normtext.llm.exact_chunks import drop_exact_duplicates
from normtext.llm.language_bits import drop_undetermined
from normtext.llm.length_buckets import pack
from normtext.llm.minhash import drop_near_duplicates
from normtext.llm.storage import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE_WORDS = 5  # near duplicates here are documents with 0.8 of their five-word shingles in common


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, or of which too little is known n-grams of one language, go."""
    return drop_undetermined(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates."""
    return drop_near_duplicates(docs, width=SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the remaining documents with bucket, batch and slot."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # n-gram filters are learned, so no SQL gives these rows; tests/llm holds the plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
