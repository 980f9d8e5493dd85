"""Selection audits: what the markers get wrong, and what a changed marker would do."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtext.functions.text import IGNORE_CASE, distinct_lower, matches
from normtext.lexicon import SWEDISH, Lexicon
from normtext.operators.markers import determinacy_of, fires
from normtext.session import stable

WILDCARD_SHAPE = re.compile(r"\\w[+*]|\{\d+,\d*\}")  # fixed value: an open or bounded gap


def seeded(seed: int, *keys: Column | str) -> Column:
    """An ordering that looks random, depends only on the seed and the row's key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]), 256)


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """Rounded part/whole, 0 where the whole is 0."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def crossing_audit(hits: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """Per wildcard-shaped marker: hits, hits that step over a clause boundary, and their rate."""
    spark = hits.sparkSession
    shaped = [(m.category, m.marker, m.pattern) for m in lexicon.markers if WILDCARD_SHAPE.search(m.pattern)]
    inventory = spark.createDataFrame(shaped, "category string, marker string, pattern string")
    crosses = F.col("matched_span").rlike(IGNORE_CASE + lexicon.clause_boundary)
    counted = hits.groupBy("category", "marker").agg(
        F.count("*").alias("hits"), F.count_if(crosses).alias("clause_crossing_hits")
    )
    joined = inventory.join(counted, ["category", "marker"], "left").fillna(0)
    return joined.withColumn("crossing_rate", ratio(F.col("clause_crossing_hits"), F.col("hits"), 4))


def crossing_sample(hits: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` seeded hits per marker. The rank limit is applied before the shuffle."""
    drawn = Window.partitionBy("category", "marker").orderBy(
        seeded(seed, "provision_id", "char_offset"), "provision_id", "char_offset"
    )
    return hits.withColumn("draw", F.row_number().over(drawn)).where(F.col("draw") <= size)


def determinacy_delta(df: DataFrame, before: str, after: str, vague: str) -> DataFrame:
    """Provisions whose rung differs between two specific-patterns, and the terms gained."""
    text = F.col("text")
    weak = text.rlike(IGNORE_CASE + vague)
    rungs = df.withColumns(
        {
            "before": determinacy_of(text.rlike(IGNORE_CASE + before), weak),
            "after": determinacy_of(text.rlike(IGNORE_CASE + after), weak),
        }
    ).where(F.col("before") != F.col("after"))
    gained = F.array_except(distinct_lower(text, IGNORE_CASE + after), distinct_lower(text, IGNORE_CASE + before))
    return rungs.select("provision_id", "before", "after", F.array_join(F.array_sort(gained), ", ").alias("newly_matched"))


def _gate(text: Column, lexicon: Lexicon) -> Column:
    gate = F.lit(True)
    for category in ("duty", "exception", "qualifier"):
        any_fires = F.lit(False)
        for m in lexicon.of(category):
            any_fires = any_fires | fires(text, m)
        gate = gate & any_fires
    return gate


def compare_lexicons(df: DataFrame, old: Lexicon, new: Lexicon) -> DataFrame:
    """Both gates and the rung on the same row, so old and new need no join."""
    text = F.col("text")
    specific = text.rlike(IGNORE_CASE + old.specific)
    return (
        df.withColumns({"is_before": _gate(text, old), "is_after": _gate(text, new)})
        .where(F.col("is_before") | F.col("is_after"))
        .withColumn("specific", specific)
    )


def leaving(df: DataFrame, old: Lexicon, new: Lexicon) -> DataFrame:
    compared = compare_lexicons(df, old, new)
    return compared.where(F.col("is_before") & ~F.col("is_after")).select("provision_id")


def projected_change(df: DataFrame, old: Lexicon, new: Lexicon) -> DataFrame:
    """What exchanging a marker would do to the candidate set. Nothing is stored."""
    before, after, specific = F.col("is_before"), F.col("is_after"), F.col("specific")
    return compare_lexicons(df, old, new).agg(
        F.count_if(before).alias("candidates_before"),
        F.count_if(after).alias("candidates_after"),
        F.count_if(before & ~after).alias("leaving"),
        F.count_if(before & specific).alias("specific_before"),
        F.count_if(after & specific).alias("specific_after"),
    )


def decisions(gold: DataFrame, texts: DataFrame, patterns: Mapping[str, str], positive: str) -> DataFrame:
    """Per label and pattern: does a match start exactly at the labelled offset?

    ``gold`` has provision_id, char_offset, span, label; ``texts`` provision_id, text.
    """
    text, offset = F.col("text"), F.col("char_offset")
    fired = F.array(
        *[
            F.struct(
                F.lit(name).alias("pattern"),
                F.exists(matches("text", IGNORE_CASE + p), lambda m: m["start"] == offset).alias("fired"),
            )
            for name, p in patterns.items()
        ]
    )
    verbatim = F.substring(text, offset + 1, F.length("span")) == F.col("span")
    return (
        gold.join(texts.select("provision_id", "text"), "provision_id")
        .select("provision_id", "char_offset", "span", "label", verbatim.alias("verbatim"), F.explode(fired).alias("_d"))
        .select("provision_id", "char_offset", "span", "label", "verbatim", "_d.*", (F.col("label") == positive).alias("positive"))
    )


def scorecard(decided: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 per pattern, over labels that still
    match their text; labels that no longer do are counted apart."""
    ok, fired, positive = F.col("verbatim"), F.col("fired"), F.col("positive")
    counts = decided.groupBy("pattern").agg(
        F.count_if(ok & fired & positive).alias("true_positive"),
        F.count_if(ok & fired & ~positive).alias("false_positive"),
        F.count_if(ok & ~fired & positive).alias("false_negative"),
        F.count_if(ok & ~fired & ~positive).alias("true_negative"),
        F.count_if(~ok).alias("not_verbatim"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp, 6),
            "recall": ratio(tp, tp + fn, 6),
            "f1": ratio(2 * tp, 2 * tp + fp + fn, 6),
        }
    )


def decision_changes(decided: DataFrame, old: str, new: str) -> DataFrame:
    """Labels that one pattern decides differently from another: GOOD if the new one is right."""
    key = ["provision_id", "char_offset", "span", "label", "positive"]
    both = (
        decided.where(F.col("pattern").isin(old, new) & F.col("verbatim"))
        .groupBy(*key)
        .agg(
            F.bool_or((F.col("pattern") == old) & F.col("fired")).alias("before"),
            F.bool_or((F.col("pattern") == new) & F.col("fired")).alias("after"),
        )
    )
    return both.where(F.col("before") != F.col("after")).select(
        "provision_id",
        "char_offset",
        "label",
        F.when(F.col("before"), "now silent").otherwise("now fires").alias("movement"),
        F.when(F.col("after") == F.col("positive"), "GOOD").otherwise("COST").alias("verdict"),
    )


def pooled_hits(pools: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Distinct hits over the pools, with the pools and each pool's rank.

    Every pool is (hits, ranks): provision_id, char_offset, matched_span and
    provision_id, rank.
    """
    key = ["provision_id", "char_offset", "matched_span"]
    tagged = None
    for name, (hits, ranks) in pools.items():
        rows = hits.select(*key).join(ranks.select("provision_id", "rank"), "provision_id", "left")
        rows = rows.withColumn("pool", F.lit(name))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy(*key).agg(
        *[F.bool_or(F.col("pool") == p).alias(f"in_{p}") for p in pools],
        *[F.min(F.when(F.col("pool") == p, F.col("rank"))).alias(f"rank_{p}") for p in pools],
    )


def stratified_sample(
    pooled: DataFrame, pools: Sequence[str], boundary: str, size: int, seed: int, top: int = 50
) -> DataFrame:
    """All boundary-crossing hits of the first pool, one seeded hit per top-ranked
    provision, then a seeded fill up to ``size``; each with its reason.

    Only the fill is limited, and a limit of ``size`` rows is all it can ever need. The pooled hits are stored, since
    every stratum reads them.
    """
    pooled = stable(pooled)
    first = pools[0]
    hit = F.struct("provision_id", "char_offset", "matched_span")
    key = ["provision_id", "char_offset", "matched_span"]
    draw = seeded(seed, "provision_id", "char_offset", "matched_span")
    ranked = F.least(*[F.coalesce(f"rank_{p}", F.lit(2**62)) for p in pools]) <= top
    crosses = F.col("matched_span").rlike(IGNORE_CASE + boundary) & F.col(f"in_{first}")
    marked = pooled.withColumns({"_defective": crosses, "_top": ~crosses & ranked, "_draw": draw})
    defective = marked.where("_defective").select(*key, F.lit(f"known-defective-{first}").alias("selection_reason"))
    chosen = (
        marked.where("_top").groupBy("provision_id").agg(F.min_by(hit, F.struct("_draw", "char_offset")).alias("_h"))
    ).select("_h.*", F.lit(f"top-{top}-ranked").alias("selection_reason"))
    mandatory = defective.unionByName(chosen)
    fill = (
        marked.where(~F.col("_defective"))
        .join(chosen.select(*key), key, "left_anti")
        .orderBy("_draw", *key)
        .limit(size)
        .withColumn("_n", F.row_number().over(Window.orderBy("_draw", *key)))  # at most `size` rows
        .where(F.col("_n") <= F.lit(size) - mandatory.agg(F.count("*")).scalar())
        .select(*key, F.lit(f"random-seed-{seed}").alias("selection_reason"))
    )
    return mandatory.unionByName(fill)


def merge_pools(preferred: DataFrame, other: DataFrame, key: str = "provision_id") -> DataFrame:
    """Both pools, the preferred one's row where an id is in both."""
    return preferred.unionByName(other.join(preferred.select(key), key, "left_anti"))


def adjudicate(candidates: DataFrame, hand: DataFrame) -> DataFrame:
    """Computed rung beside the hand rung (provision_id, hand_rung)."""
    return candidates.join(hand, "provision_id").select(
        "provision_id",
        F.col("qualifier_determinacy").alias("computed"),
        "hand_rung",
        F.when(F.col("qualifier_determinacy") == F.col("hand_rung"), "agrees").otherwise("disagrees").alias("agreement"),
    )
