"""Requirement keywords (MUST, SHOULD, MAY ...) in plain-text specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.functions.ordered import with_previous
from normtext.functions.text import UNICODE, quick, squeeze, strip
from normtext.operators.direction import ladder_move, looked_up, modality_rung, sign_of
from normtext.session import stable

LINE_END = r"[\v\x1C\x1D\x1E](?:(?<=\r)\n)?"  # \v: \n \x0B \x0C \r \x85 \u2028 \u2029
SENTENCE_END = r"\s(?<=[.:]\s)\s*(?=[A-Z(])"  # begins with what is quick to rule out, not with the look behind it
KEYWORD = quick(UNICODE, r"\b(" + "|".join(fv.REQUIREMENT_KEYWORDS) + r")\b")
RUNGS = ("binding", "weak", "absent")


def page_line(line: Column) -> Column:
    """Whether a line is a page's head or foot. Most lines hold none of what such a line must hold, and go through no pattern."""
    may_be = F.startswith(line, F.lit("RFC ")) | F.startswith(line, F.lit("Internet-Draft")) | F.contains(line, F.lit("[Page "))
    return may_be & line.rlike(UNICODE + fv.PAGE_LINE)


def blocks_of(text: Column) -> Column:
    """Page lines dropped, wrapped lines joined inside blank-line blocks, whitespace squeezed."""
    lines = F.transform(F.split(text, LINE_END, -1), strip)
    kept = F.filter(lines, lambda line: ~page_line(line))
    blocks = F.split(F.array_join(kept, "\n"), r"\n{2,}", -1)
    return F.filter(F.transform(blocks, squeeze), lambda b: b != "")


def reflow(docs: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    return docs.select(*keep, F.posexplode(blocks_of(F.col("text"))).alias("block_no", "block"))


def sentences(blocks: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """Split after a period or colon that stands before a capital or an opening bracket."""
    cut = F.split("block", UNICODE + SENTENCE_END, -1)
    parts = F.filter(F.transform(cut, strip), lambda s: s != "")
    return blocks.select(*keep, "block_no", F.posexplode(parts).alias("sentence_no", "sentence"))


def requirements(cut: DataFrame) -> DataFrame:
    """Sentences with a keyword: the first one counts. Sentences that quote keywords
    or explain the notation are skipped."""
    sentence = F.col("sentence")
    quoting = (F.length(sentence) - F.length(F.translate(sentence, '"', ""))) >= 2
    notation = quoting | F.contains(sentence, F.lit(fv.NOTATION_PHRASE))
    keyword = F.regexp_extract(sentence, KEYWORD, 1)
    return (
        cut.where(~notation)
        .withColumn("keyword", keyword)
        .where(F.col("keyword") != "")
        .withColumn("modality", looked_up(fv.REQUIREMENT_KEYWORDS, F.col("keyword")))
    )


def read_requirements(docs: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """Documents to requirements in one pass, no shuffle."""
    return requirements(sentences(reflow(docs, keep), keep))


def profile(found: DataFrame, keys: Sequence[str] = ("document_id",), documents: DataFrame | None = None) -> DataFrame:
    """Counts and shares by rung. With ``documents`` (the keys) those without requirements stay."""
    counts = found.groupBy(*keys).agg(
        F.count("*").alias("requirements"), *[F.count_if(F.col("modality") == r).alias(r) for r in RUNGS]
    )
    if documents is not None:
        counts = documents.select(*keys).join(counts, list(keys), "left").fillna(0)
    total = F.greatest(F.col("requirements"), F.lit(1))
    return counts.withColumns({f"{r}_pct": F.round(100.0 * F.col(r) / total, 1) for r in RUNGS})


def masked(sentence: Column) -> Column:
    """The sentence without its keyword, so one requirement matches at any strength."""
    return strip(F.lower(F.regexp_replace(sentence, KEYWORD, fv.KEYWORD_MASK)))


def requirement_drift(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """Requirements of two versions matched by masked sentence, the last duplicate winning.

    ``status`` is changed, added or removed; only changed keywords get a direction,
    and a change inside one rung is neutral.
    """
    columns = [*keys, "sentence", "keyword", "modality", "block_no", "sentence_no"]
    tagged = old.select(*columns, F.lit("old").alias("_side")).unionByName(new.select(*columns, F.lit("new").alias("_side")))

    def last(side: str) -> Column:
        mine = F.col("_side") == side
        return F.max_by(
            F.when(mine, F.struct("sentence", "keyword", "modality")), F.when(mine, F.struct("block_no", "sentence_no"))
        ).alias(side)

    both = tagged.groupBy(*keys, masked(F.col("sentence")).alias("requirement_key")).agg(last("old"), last("new"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.keyword") != F.col("new.keyword"), "changed")
    )
    move = ladder_move(modality_rung(F.col("old.modality")), modality_rung(F.col("new.modality")))
    return (
        both.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(
            *keys,
            "status",
            F.col("old.keyword").alias("from_keyword"),
            F.col("new.keyword").alias("to_keyword"),
            F.when(F.col("status") == "changed", sign_of(F.lit("modality"), F.lit("duty"), move)).alias("direction"),
            F.coalesce("new.sentence", "old.sentence").alias("requirement"),
        )
    )


def posture_series(profiles: DataFrame) -> DataFrame:
    """Binding share per version of a family and its change in points to the version before.

    Rows: family, year, document_id and the profile columns; versions without
    requirements are left out.
    """
    usable = stable(profiles.where(F.col("requirements") > 0))
    stepped = with_previous(usable, ["family"], ["year", "document_id"], ["document_id", "binding_pct"])
    delta = F.round(F.col("binding_pct") - F.col("previous_binding_pct"), 1)
    return stepped.where(F.col("previous_document_id").isNotNull()).select(
        "family",
        F.col("previous_document_id").alias("from_document"),
        F.col("document_id").alias("to_document"),
        delta.alias("binding_share_delta_pp"),
        F.when(delta < 0, "looser").when(delta > 0, "stricter").otherwise("flat").alias("posture"),
    )


def keyword_inventory(found: DataFrame) -> DataFrame:
    return found.groupBy("document_id", "keyword", "modality").agg(F.count("*").alias("requirements"))


def first_examples(found: DataFrame, count: int = 8, chars: int = 180) -> DataFrame:
    """The first requirements of each document; the limit applies before the shuffle."""
    order = Window.partitionBy("document_id").orderBy("block_no", "sentence_no")
    return (
        found.withColumn("example", F.row_number().over(order))
        .where(F.col("example") <= count)
        .select("document_id", "example", "keyword", "modality", F.substring("sentence", 1, chars).alias("text"))
    )
