"""Corpus profiles: lengths, concentration, structure, co-occurrence, controls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.functions.ordered import with_running_total
from normtext.functions.text import IGNORE_CASE
from normtext.lexicon import CATEGORIES, SWEDISH, Lexicon
from normtext.operators.shortlist import any_of, fires
from normtext.session import stable

PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def length_profile(provisions: DataFrame, column: str = "char_count", short: int = 120) -> DataFrame:
    """Exact percentiles: the aggregate's state is one counter per distinct length."""
    value = F.col(column)
    return provisions.agg(
        F.count(value).alias("count"),
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.stddev_samp(value), 4).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[F.round(F.percentile(value, q), 4).alias(name) for name, q in PERCENTILES.items()],
        F.round(F.avg((value < short).cast("double")), 6).alias("share_short"),
    )


def per_document(provisions: DataFrame) -> DataFrame:
    return provisions.groupBy("document_id", "document_title").agg(
        F.count("provision_id").alias("provisions"), F.sum("char_count").alias("chars")
    )


def concentration(provisions: DataFrame, top: int = 5) -> DataFrame:
    """Share of all provisions held by the largest documents."""
    documents = per_document(provisions)
    largest = documents.orderBy(F.desc("provisions")).limit(top).agg(F.sum("provisions")).scalar()
    total = documents.agg(F.sum("provisions").alias("provisions"), F.count("*").alias("documents"))
    return total.withColumn("held", largest).select(
        "documents", "provisions", "held", F.round(F.col("held") / F.col("provisions"), 6).alias("top_share")
    )


def structure_profile(provisions: DataFrame) -> DataFrame:
    heading = F.trim(F.coalesce("heading", F.lit("")))
    chapter = F.trim(F.coalesce("chapter", F.lit("")))
    return provisions.groupBy("kind").agg(
        F.count("*").alias("provisions"),
        F.count_if(chapter != "").alias("with_chapter"),
        F.count_if(chapter == "").alias("without_chapter"),
        F.count_if(heading != "").alias("with_heading"),
        F.countDistinct("heading").alias("distinct_headings"),
    )


def top_headings(provisions: DataFrame, count: int = 12) -> DataFrame:
    heading = F.trim(F.coalesce("heading", F.lit("")))
    named = F.when(heading == "", "(none)").otherwise(heading)
    return (
        provisions.groupBy(named.alias("heading"))
        .agg(F.count("*").alias("provisions"))
        .orderBy(F.desc("provisions"), "heading")
        .limit(count)
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def length_position(provisions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Share of the corpus strictly shorter than each chosen row.

    Counted once per distinct length, so the running total runs over lengths and
    not over provisions.
    """
    lengths = stable(provisions.groupBy("char_count").agg(F.count("*").alias("_n")))
    below = with_running_total(lengths, ["char_count"], "_n", "_below").drop("_n")
    total = lengths.agg(F.sum("_n")).scalar()
    return (
        chosen.select("provision_id", "char_count")
        .join(below, "char_count")
        .select("provision_id", "char_count", F.round(F.try_divide("_below", total), 6).alias("share_shorter"))
    )


def with_categories(provisions: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """has_duty, has_exception, has_qualifier from the text itself."""
    text = F.col("text")
    return provisions.withColumns({f"has_{c}": any_of([fires(text, m) for m in lexicon.of(c)]) for c in CATEGORIES})


def category_patterns(flagged: DataFrame) -> DataFrame:
    named = F.concat_ws(" + ", *[F.when(F.col(f"has_{c}"), c) for c in CATEGORIES])
    counts = flagged.groupBy(F.when(named == "", "(none)").otherwise(named).alias("pattern")).agg(
        F.count("*").alias("provisions")
    )
    total = counts.agg(F.sum("provisions")).scalar()
    return counts.select("pattern", "provisions", F.round(F.try_divide("provisions", total), 3).alias("share"))


def co_occurrence(flagged: DataFrame) -> DataFrame:
    """Counts for every pair of categories and the lift over independence, in one aggregate."""
    pairs = [(a, b) for a in CATEGORIES for b in CATEGORIES]
    sums = flagged.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f"has_{a}") & F.col(f"has_{b}")).alias(f"{a}_{b}") for a, b in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left_category"),
                F.lit(b).alias("right_category"),
                F.col(f"{a}_{b}").alias("provisions"),
                F.round(
                    F.col(f"{a}_{b}") * F.col("n") / F.nullif(F.col(f"{a}_{a}") * F.col(f"{b}_{b}"), F.lit(0)), 4
                ).alias("lift"),
            )
            for a, b in pairs
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def with_hit_count(provisions: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    text = F.col("text")
    counts = [F.regexp_count(text, F.lit(IGNORE_CASE + m.pattern)) for m in lexicon.markers]
    return provisions.withColumn("hits", reduce(lambda a, b: a + b, counts).cast("int"))


def _average_rank(values: DataFrame, column: str) -> DataFrame:
    """Average rank of each distinct value, ties sharing the middle of their places."""
    counts = values.groupBy(column).agg(F.sum("_n").alias("_c"))
    below = with_running_total(counts, [column], "_c", "_below")
    return below.select(column, (F.col("_below") + (F.col("_c") + 1) / 2).alias(f"_rank_{column}"))


def _weighted_corr(x: Column, y: Column, n: Column) -> Column:
    total = F.sum(n)
    mean_x, mean_y = F.sum(n * x) / total, F.sum(n * y) / total
    cov = F.sum(n * x * y) / total - mean_x * mean_y
    var_x, var_y = F.sum(n * x * x) / total - mean_x * mean_x, F.sum(n * y * y) / total - mean_y * mean_y
    return F.try_divide(cov, F.sqrt(var_x * var_y))  # a constant column has no correlation


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman. Everything after the first aggregation runs over the
    distinct (x, y) pairs with their counts, so repeated values cost nothing."""
    cells = stable(df.groupBy(x, y).agg(F.count("*").alias("_n")))  # read five times below
    ranked = cells.join(_average_rank(cells, x), x).join(_average_rank(cells, y), y)
    n = F.col("_n").cast("double")
    return ranked.agg(
        F.round(_weighted_corr(F.col(x).cast("double"), F.col(y).cast("double"), n), 6).alias("pearson"),
        F.round(_weighted_corr(F.col(f"_rank_{x}"), F.col(f"_rank_{y}"), n), 6).alias("spearman"),
    )


def length_bucket(length: Column, edges: Sequence[int] = (150, 300, 600, 1200)) -> Column:
    """(low, high] buckets named like ``150-300``."""
    label = F.when(length <= edges[0], f"<{edges[0]}")
    for low, high in zip(edges, edges[1:]):
        label = label.when(length <= high, f"{low}-{high}")
    return label.otherwise(f">{edges[-1]}")


def hits_by_length(counted: DataFrame) -> DataFrame:
    return counted.groupBy(length_bucket(F.col("char_count")).alias("bucket")).agg(
        F.count("*").alias("provisions"),
        F.round(F.avg("hits"), 2).alias("mean_hits"),
        F.round(F.avg((F.col("hits") > 0).cast("double")), 2).alias("share_with_any"),
    )


def double_counting(provisions: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """(provision, category) pairs where a marker repeats or several markers fire, counted in the row."""

    def counted(category: str) -> Column:
        counts = F.array(*[F.regexp_count("text", F.lit(IGNORE_CASE + m.pattern)) for m in lexicon.of(category)])
        return F.struct(
            F.lit(category).alias("category"),
            F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c).alias("hits"),
            F.size(F.filter(counts, lambda c: c > 0)).cast("long").alias("distinct_markers"),
        )

    rows = provisions.select("provision_id", F.explode(F.array(*[counted(c) for c in CATEGORIES])).alias("r"))
    return rows.select("provision_id", "r.*").where(
        (F.col("hits") > F.col("distinct_markers")) | (F.col("distinct_markers") > 1)
    )


def band_comparison(flagged: DataFrame, patterns: Mapping[str, str], low: int = 250, high: int = 600) -> DataFrame:
    """Inside one length band: share holding each pattern, candidates against the rest."""
    text = F.col("text")
    candidate = F.col("has_duty") & F.col("has_exception") & F.col("has_qualifier")
    return (
        flagged.where(F.col("char_count").between(low, high))
        .groupBy(candidate.alias("is_candidate"))
        .agg(
            F.count("*").alias("provisions"),
            *[F.round(F.avg(text.rlike(IGNORE_CASE + p).cast("double")), 3).alias(n) for n, p in patterns.items()],
        )
    )


def source_spread(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("document_title").agg(
        F.count("provision_id").alias("candidates"),
        F.min("rank").alias("best_rank"),
        F.countDistinct(F.when(F.col("rank") <= 50, F.col("document_id"))).alias("documents_in_top_50"),
    )


def pool_comparison(pools: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per pool (provisions, candidates): rate, median score, specific share."""
    rows = []
    for name, (provisions, candidates) in pools.items():
        size = provisions.agg(F.count("*")).scalar()
        found = candidates.agg(
            F.count("*").alias("candidates"),
            F.percentile("score", 0.5).alias("median_score"),
            F.round(F.avg((F.col("determinacy") == "specific").cast("double")), 3).alias("specific_share"),
        )
        rows.append(
            found.withColumn("provisions", size).select(
                F.lit(name).alias("pool"),
                "provisions",
                "candidates",
                F.round(F.try_divide("candidates", "provisions"), 4).alias("candidate_rate"),
                "median_score",
                "specific_share",
            )
        )
    return reduce(DataFrame.unionByName, rows)
