"""Case-insensitive phrase search over an index of letter trigrams.

The index is a committed set of three tables: the texts with a row number, the postings
(trigram, row) in the order of the trigrams, so that a common trigram spreads over many files and
a rare one is a few pages of one, and how many rows each trigram has. A phrase is looked up by its rarest
trigrams; the rows that have all of them are candidates, and only their texts are read to verify the
phrase. A phrase of one or two letters takes every trigram that holds it.

Trigrams are three letters in a row of the lower-cased text; a text of fewer letters is
a gram as a whole. An empty phrase is in every text, a null text holds none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normtext.functions.text import sql_literal
from normtext.sources.tables import commit, current

GRAM = 3
RAREST = 3  # trigrams of a phrase that are intersected: each further one hardly drops a row
FEW = 1_000  # candidate rows that are looked up by number; more are joined


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, from one search that takes a letter and looks at the next two."""
    lowered = F.lower(text)
    return F.array_distinct(
        F.when(F.length(lowered) > GRAM, F.regexp_extract_all(lowered, F.lit(rf"(?s)(?=(.{{{GRAM}}})).")))
        .otherwise(F.array(lowered))
    )


def build_text_index(rows: DataFrame, path: str) -> str:
    """Indexes ``text`` of ``rows`` and makes that the current index under ``path``; returns its folder. All columns are kept."""

    def write(folder: str) -> None:
        spark = rows.sparkSession
        # Each task's numbers are a range of their own, so a row's number also says which file holds it.
        numbered = rows.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_of"))
        numbered.write.parquet(f"{folder}/texts")
        told = spark.read.parquet(f"{folder}/texts").select("_row", F.explode(grams(F.col("_of.text"))).alias("gram"))
        told.repartitionByRange("gram", "_row").sortWithinPartitions("gram", "_row").write.parquet(f"{folder}/postings")
        counted = spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count("*").alias("n"))
        counted.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")

    return commit(rows.sparkSession, path, write)


def _candidates(spark: SparkSession, folder: str, phrase: str) -> tuple[DataFrame, int | None] | None:
    """``_row`` of the texts that can hold the phrase, and a bound on how many there are; None if none can."""
    postings, counted = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/grams")
    if len(phrase) < GRAM:
        holding = counted.where(F.contains("gram", F.lit(phrase))).select("gram")
        return postings.join(holding, "gram", "left_semi").select("_row").distinct(), None
    wanted = sorted({phrase[i : i + GRAM] for i in range(len(phrase) - GRAM + 1)})
    found = sorted((r["n"], r["gram"]) for r in counted.where(F.col("gram").isin(wanted)).collect())  # one row a trigram
    if len(found) < len(wanted):
        return None
    rarest = [gram for _, gram in found[:RAREST]]
    rows = postings.where(F.col("gram").isin(rarest)).groupBy("_row").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
    return rows.select("_row"), found[0][0]


def search_texts(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """The indexed rows whose text holds the phrase, whatever the case."""
    folder = current(spark, path)
    texts = spark.read.parquet(f"{folder}/texts")
    lowered = spark.range(1).select(F.lower(F.lit(phrase))).first()[0]  # as Spark lower-cases the texts
    if lowered:
        candidates = _candidates(spark, folder, lowered)
        if candidates is None:
            texts = texts.limit(0)
        else:
            rows, most = candidates
            if most is not None and most <= FEW:
                texts = texts.where(F.col("_row").isin([r["_row"] for r in rows.collect()]))  # at most FEW numbers, pushed to the scan
            else:
                texts = texts.join(rows, "_row", "left_semi")
    return texts.where(F.expr(f"contains(lower(_of.text), {sql_literal(lowered)})")).select("_of.*")


def text_search(spark: SparkSession, path: str, phrase: str, chars: int = 150, keep: Sequence[str] = ("provision_id", "document_title")) -> DataFrame:
    """Found rows with the beginning of their text."""
    return search_texts(spark, path, phrase).select(*keep, F.substring("text", 1, chars).alias("extract"))
