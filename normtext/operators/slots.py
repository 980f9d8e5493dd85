"""Profiles of annotated passages: slot shapes, quote coverage, positions, analysis units.

A passage carries its slots as an array, so everything about one passage is
computed inside its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.operators.direction import sign_of


def slot_rows(passages: DataFrame, keep: Sequence[str] = ("passage_id", "domain", "group")) -> DataFrame:
    text, quote = F.col("text"), F.col("_s.quote")
    return passages.select(*keep, "text", F.explode("slots").alias("_s")).select(
        *keep,
        F.length(text).cast("int").alias("passage_chars"),
        "_s.*",
        F.length(F.coalesce(quote, F.lit(""))).cast("int").alias("quote_chars"),
        F.when(quote != "", F.instr(text, quote) - 1).otherwise(-1).cast("int").alias("quote_start"),
    )


def slot_shape(rows: DataFrame) -> DataFrame:
    per = F.count("*") / F.countDistinct("passage_id")
    return rows.groupBy("domain", "group").agg(
        F.countDistinct("passage_id").alias("passages"),
        F.count("*").alias("slots"),
        F.round(per, 1).alias("slots_per_passage"),
        F.count("quote").alias("anchored_quotes"),
        F.percentile("passage_chars", 0.5).alias("median_passage_chars"),
    )


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Two-way counts with margins; ``values`` are the column labels."""
    counts = rows.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    label = lambda name, flag: F.when(F.col(flag) == 1, "All").otherwise(F.col(name))
    return (
        counts.select(label(row, "_r").alias(row), label(column, "_c").alias("_column"), "n")
        .groupBy(row)
        .pivot("_column", [*values, "All"])
        .agg(F.sum("n"))
        .fillna(0)
    )


def quote_coverage(passages: DataFrame) -> DataFrame:
    """Characters inside the union of the quote intervals, overlaps counted once."""
    text = F.col("text")

    def interval(slot: Column) -> Column:
        start = (F.instr(text, slot["quote"]) - 1).cast("int")
        return F.struct(start.alias("start"), (start + F.length(slot["quote"])).cast("int").alias("end"))

    anchored = F.filter("slots", lambda s: F.coalesce(s["quote"], F.lit("")) != "")
    intervals = F.array_sort(F.filter(F.transform(anchored, interval), lambda i: i["start"] >= 0))
    union = F.aggregate(
        intervals,
        F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach")),
        lambda state, i: F.struct(
            (state["covered"] + F.greatest(F.lit(0), i["end"] - F.greatest(i["start"], state["reach"]))).cast("int").alias("covered"),
            F.greatest(state["reach"], i["end"]).alias("reach"),
        ),
        lambda state: state["covered"],
    )
    return passages.select(
        "passage_id",
        "domain",
        F.length(text).cast("int").alias("chars"),
        union.alias("covered_chars"),
        F.round(F.try_divide(union, F.length(text)), 3).alias("coverage"),
        F.size("slots").alias("slots"),
    )


def quote_positions(rows: DataFrame) -> DataFrame:
    """Relative position of anchored quotes by domain and attachment."""
    relative = F.round(F.col("quote_start") / F.col("passage_chars"), 3)
    return (
        rows.where(F.col("quote_start") >= 0)
        .groupBy("domain", "attaches_to")
        .agg(
            F.count("*").alias("count"),
            F.round(F.avg(relative), 3).alias("mean"),
            F.round(F.percentile(relative, 0.5), 3).alias("median"),
        )
    )


def _is_exception(slot: Column) -> Column:
    return slot["kind"] == "exception"


def _on_exception(slot: Column) -> Column:
    return (slot["attaches_to"] == "exception") & (slot["kind"] != "exception")


def condition_order(passages: DataFrame) -> DataFrame:
    """Each quoted exception with each quoted condition on it: which stands first in the text."""
    text = F.col("text")
    quoted = F.filter("slots", lambda s: F.coalesce(s["quote"], F.lit("")) != "")
    at = lambda slot: F.instr(text, slot["quote"])
    pairs = F.flatten(
        F.transform(
            F.filter(quoted, _is_exception),
            lambda e: F.transform(
                F.filter(quoted, _on_exception),
                lambda c: F.struct(
                    e["slot_id"].alias("exception"),
                    c["slot_id"].alias("condition"),
                    (at(c) > at(e)).alias("condition_after_exception"),
                ),
            ),
        )
    )
    return passages.select("passage_id", "domain", F.explode(pairs).alias("_p")).select("passage_id", "domain", "_p.*")


def analysis_units(chains: DataFrame, passages: DataFrame, depth: int) -> DataFrame:
    """Per experiment: chains are the independent unit, readings are not."""
    per_chain = chains.groupBy("experiment").agg(
        F.countDistinct("chain_id").alias("independent_chains"), F.countDistinct("style").alias("styles")
    )
    per_passage = passages.groupBy("experiment").agg(F.count("*").alias("passages"))
    joined = per_chain.join(per_passage, "experiment")
    return joined.withColumns(
        {
            "chains_per_passage": F.round(F.col("independent_chains") / F.col("passages"), 1),
            "readings": F.col("independent_chains") * depth + F.col("passages"),
            "readings_per_chain": F.lit(depth),
        }
    )


def pair_chains(passages: DataFrame, chains: DataFrame) -> DataFrame:
    """Per passage: exception slots, conditions on them, pairs, and pairs followed through chains."""
    here = chains.groupBy("experiment", "passage_id").agg(F.countDistinct("chain_id").alias("chains"))
    counted = passages.select(
        "experiment",
        "passage_id",
        F.size(F.filter("slots", _is_exception)).alias("exception_slots"),
        F.size(F.filter("slots", _on_exception)).alias("conditions_on_exception"),
    )
    pairs = (F.col("exception_slots") * F.col("conditions_on_exception")).cast("long")
    return (
        counted.join(here, ["experiment", "passage_id"], "left")
        .fillna(0, ["chains"])
        .withColumns({"pairs": pairs, "pair_chains": pairs * F.col("chains")})
    )


def direction_if_lost(rows: DataFrame) -> DataFrame:
    """Distinct slot shapes with the plain reading of losing them, and beside it the
    ratified sign, which for a condition on a duty is the opposite."""
    kind, part = F.col("kind"), F.col("attaches_to")
    plain = (
        F.when((part == "duty") & kind.isin("condition", "deadline", "modality"), "loosens")
        .when(part == "exception", "tightens")
        .otherwise("unclear")
    )
    ratified = (
        F.when(kind == "exception", sign_of(F.lit("part"), F.lit("exception"), F.lit("removed")))
        .when(kind == "bound", sign_of(F.lit("part"), F.lit("ceiling"), F.lit("removed")))
        .when(kind.isin("condition", "deadline"), sign_of(F.lit("condition"), part, F.lit("weakened")))
        .when(kind == "modality", sign_of(kind, part, F.lit("weakened")))
    )
    return (
        rows.select("domain", "kind", "attaches_to", plain.alias("plain_reading"), ratified.alias("ratified_sign"))
        .distinct()
        .groupBy("domain", "plain_reading", "ratified_sign")
        .agg(F.count("*").alias("slot_shapes"))
    )
