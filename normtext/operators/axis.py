"""The selection axis: marker counts, lengths, pairs and expectations per passage group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.lexicon import CATEGORIES, SWEDISH, Lexicon
from normtext.operators.markers import hits


def passage_counts(passages: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """Marker hits per category, counted inside the passage's row."""
    found = passages.withColumn("_hits", hits("text", lexicon))
    counts = {c: F.expr(f"size(filter(_hits, h -> h.category = '{c}'))") for c in CATEGORIES}
    return found.select(
        "passage_id", "group", F.length("text").cast("int").alias("chars"), *[v.alias(k) for k, v in counts.items()]
    )


def hit_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("group").agg(
        F.count("*").alias("passages"),
        *[F.sum(c).cast("long").alias(c) for c in CATEGORIES],
        *[F.count_if(F.col(c) > 0).alias(f"passages_with_{c}") for c in CATEGORIES],
    )


def length_summary(passages: DataFrame) -> DataFrame:
    chars = F.length("text").cast("int")
    return passages.groupBy("group").agg(
        F.count("*").alias("n"),
        F.min(chars).alias("min"),
        F.percentile(chars, 0.25).alias("q1"),
        F.percentile(chars, 0.5).alias("median"),
        F.percentile(chars, 0.75).alias("q3"),
        F.max(chars).alias("max"),
        F.round(F.avg(chars), 1).alias("mean"),
    )


def paired_lengths(passages: DataFrame) -> DataFrame:
    """Exactly one categorical and one conditional passage per pair, on one topic.

    Every pair comes back with ``problem`` NULL or the rule it breaks; a passage
    without a pair id is a problem row of its own.
    """
    members = passages.where(F.col("group").isin("categorical", "conditional"))
    of = lambda group, value: F.when(F.col("group") == group, value)
    chars = F.length("text").cast("int")
    pairs = members.groupBy("pair_id").agg(
        F.count_if(F.col("group") == "categorical").alias("_a"),
        F.count_if(F.col("group") == "conditional").alias("_b"),
        F.max(of("categorical", F.col("topic"))).alias("topic"),
        F.max(of("conditional", F.col("topic"))).alias("_topic"),
        F.max(of("categorical", chars)).alias("categorical"),
        F.max(of("conditional", chars)).alias("conditional"),
    )
    problem = (
        F.when(F.coalesce(F.col("pair_id"), F.lit("")) == "", "missing pair_id")
        .when((F.col("_a") > 1) | (F.col("_b") > 1), "duplicate member")
        .when((F.col("_a") == 0) | (F.col("_b") == 0), "incomplete pair")
        .when(F.col("topic") != F.col("_topic"), "topic mismatch")
    )
    return pairs.select(
        "pair_id", "topic", "categorical", "conditional",
        (F.col("conditional") - F.col("categorical")).alias("difference"),
        problem.alias("problem"),
    )


def expectation_checks(counts: DataFrame) -> DataFrame:
    """Expected against observed category pattern; failures are reported, not dropped."""
    pattern = lambda values: F.array_join(F.array(*values), "")
    observed = pattern([F.when(F.col(c) > 0, c[0]).otherwise("-") for c in CATEGORIES])
    expected = F.lit(None).cast("string")
    for group, flags in fv.AXIS_EXPECTATIONS.items():
        code = "".join(c[0] if f else "-" for c, f in zip(CATEGORIES, flags))
        expected = F.when(F.col("group") == group, code).otherwise(expected)
    return counts.select(
        "passage_id", "group", expected.alias("expected"), observed.alias("observed")
    ).withColumn("passed", F.col("expected") == F.col("observed"))


def control_failures(passages: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """Negative controls that fired anyway, with their hits."""
    found = passages.where(F.col("group") == "virtue").withColumn("hits", hits("text", lexicon))
    return found.where(F.size("hits") > 0).select("passage_id", "group", "hits")
