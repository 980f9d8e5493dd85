"""Debate speeches and votes: lexical screens, positions, and how they agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.functions.text import IGNORE_CASE, UNICODE, matches, sentence_at
from normtext.operators.direction import looked_up


class Cues(NamedTuple):
    """The patterns of one debate language."""

    claim: str = fv.CLAIM_PATTERN
    topic: str = fv.TOPIC_PATTERN
    tighten: str = fv.TIGHTEN_PATTERN
    loosen: str = fv.LOOSEN_PATTERN
    legal_object: str = fv.LEGAL_OBJECT_PATTERN
    own_proposal: str = fv.OWN_PROPOSAL_PATTERN
    attribution: str = fv.ATTRIBUTION_PATTERN
    party_names: Mapping[str, str] = fv.PARTY_NAMES
    harmonised: Mapping[str, str] = fv.PARTY_HARMONISED
    roles_dropped: Sequence[str] = tuple(fv.ROLES_DROPPED)


SWEDISH_CUES = Cues()


def eligibility(speeches: DataFrame, cues: Cues = SWEDISH_CUES) -> DataFrame:
    """Share of speeches with a claim about a rule, and debates that touch the topic."""
    text = F.col("speech_text")
    claims = F.count_if(text.rlike(IGNORE_CASE + cues.claim))
    total = F.count("*")
    return speeches.agg(
        total.alias("speeches"),
        claims.alias("deontic_claims"),
        F.when(total > 0, F.round(100.0 * claims / total, 1)).otherwise(0.0).alias("share_pct"),
        F.countDistinct(F.when(text.rlike(IGNORE_CASE + cues.topic), F.col("debate_title"))).alias("topic_debates"),
    )


def harmonised_party(party: Column, cues: Cues = SWEDISH_CUES) -> Column:
    upper = F.upper(F.coalesce(party, F.lit("")))
    return F.coalesce(looked_up(dict(cues.harmonised), upper), upper) if cues.harmonised else upper


def cue_hits(speeches: DataFrame, cues: Cues = SWEDISH_CUES, keep: Sequence[str] = ()) -> DataFrame:
    """First tightening and first loosening cue of each speech, with its sentence."""
    text = F.col("speech_text")
    party = harmonised_party(F.col("party"), cues)

    def first(direction: str, pattern: str) -> Column:
        pattern = IGNORE_CASE + pattern
        start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
        return F.when(
            text.rlike(pattern),
            F.struct(
                F.lit(direction).alias("direction"),
                F.lower(F.regexp_extract(text, pattern, 0)).alias("cue"),
                sentence_at(text, start, fv.SENTENCE_CAPS["screen"]).alias("sentence"),
            ),
        )

    found = F.array_compact(F.array(first("tightening", cues.tighten), first("loosening", cues.loosen)))
    return (
        speeches.withColumn("party", party)
        .where(~F.col("party").isin(*cues.roles_dropped))
        .select("party", F.col("debate_title").alias("issue"), "session", "speaker", "source_url", *keep, F.explode(found).alias("_c"))
        .select("party", "issue", "session", "speaker", "source_url", *keep, "_c.*")
    )


def party_summary(hits: DataFrame) -> DataFrame:
    """Distinct (issue, session) per direction, their difference, share and lean."""

    def debates(direction: str) -> Column:
        return F.countDistinct(F.when(F.col("direction") == direction, F.struct("issue", "session")))

    counts = hits.groupBy("party").agg(
        debates("tightening").alias("tighten_debates"), debates("loosening").alias("loosen_debates")
    )
    tight, loose = F.col("tighten_debates"), F.col("loosen_debates")
    total = tight + loose
    return counts.withColumns(
        {
            "net": tight - loose,
            "loosen_share_pct": F.when(total > 0, F.round(100.0 * loose / total, 1)).otherwise(0.0),
            "lean": F.when(tight > loose, "tightening").when(loose > tight, "loosening").otherwise("even"),
        }
    ).orderBy(F.desc(total), "party")


def issue_summary(hits: DataFrame, order: Sequence[str], top: int = 40) -> DataFrame:
    """Hits per party and direction for the issues with most hits, first example kept."""

    def count(direction: str) -> Column:
        return F.count_if(F.col("direction") == direction)

    def example(direction: str) -> Column:
        return F.min_by("sentence", F.when(F.col("direction") == direction, F.struct(*order)))

    issues = hits.groupBy("issue").agg(F.count("*").alias("total_hits")).orderBy(F.desc("total_hits"), "issue").limit(top)
    cells = hits.groupBy("issue", "party").agg(
        count("tightening").alias("tightening"),
        count("loosening").alias("loosening"),
        example("tightening").alias("tightening_example"),
        example("loosening").alias("loosening_example"),
    )
    return cells.join(F.broadcast(issues), "issue")  # at most `top` rows


def title_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, UNICODE + r"\s+", " ")))


DECISION = ["session", "designation", "title_key"]


def vote_positions(votes: DataFrame, order: Sequence[str], parties: Sequence[str]) -> DataFrame:
    """Modal position per decision and party; the position seen first wins a tie.

    Counted per position first, so a decision with very many votes is reduced
    before anything meets in one task.
    """
    keyed = votes.where(F.col("party").isin(*parties)).withColumn("title_key", title_key(F.col("title")))
    seen = F.struct(*order)
    per_position = keyed.groupBy(*DECISION, "party", "party_position").agg(
        F.count("*").alias("n"), F.min(seen).alias("first"), F.max_by("source_url", seen).alias("url"), F.max(seen).alias("last")
    )
    points = keyed.groupBy(*DECISION, "party").agg(F.countDistinct("point").alias("points"))
    modal = per_position.groupBy(*DECISION, "party").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("party_position", "n")))).alias("distribution"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "party_position"))).alias("_ranked"),
        F.max_by("url", "last").alias("vote_url"),
    )
    return (
        modal.withColumn("position", F.get("_ranked", F.lit(0))["party_position"])
        .drop("_ranked")
        .join(points, [*DECISION, "party"])
    )


def law_refs(votes: DataFrame, motions: DataFrame, order: Sequence[str], first: int = 6) -> DataFrame:
    """The first distinct law references per designation: a bill label in the motion's
    title, else its reference."""
    linked = votes.groupBy("vote_id").agg(F.max("designation").alias("designation"))
    bill = F.regexp_extract("motion_title", fv.BILL_REFERENCE, 0)
    label = F.when(bill != "", bill).otherwise(F.col("motion_reference"))
    seen = F.struct(*order)
    distinct = (
        motions.join(linked, "vote_id")
        .withColumn("label", label)
        .where(F.coalesce(F.col("label"), F.lit("")) != "")
        .groupBy("designation", "label")
        .agg(F.min(seen).alias("_first"), F.min_by("motion_url", seen).alias("url"))
    )
    place = Window.partitionBy("designation").orderBy("_first", "label")
    return distinct.withColumn("place", F.row_number().over(place)).where(F.col("place") <= first).drop("_first")


def debate_direction(speeches: DataFrame, order: Sequence[str], cues: Cues = SWEDISH_CUES) -> DataFrame:
    """Argued direction per title and party, with confidence.

    The first four cues per speech and direction count. A cue is strong if its
    sentence names a legal object, is the speaker's own proposal, attributes
    nothing to others and names no other party.
    """
    caps = fv.SENTENCE_CAPS

    def first_four(direction: str, pattern: str) -> Column:
        found = F.slice(matches("speech_text", IGNORE_CASE + pattern), 1, 4)
        return F.transform(found, lambda m: F.struct(F.lit(direction).alias("direction"), m["start"].alias("start")))

    def names(pattern: str) -> Column:
        return F.col("sentence").rlike(IGNORE_CASE + pattern)

    other = F.lit(False)
    for code in cues.party_names:
        rest = "|".join(f"(?:{p})" for c, p in cues.party_names.items() if c != code)
        other = F.when(F.col("party") == code, names(rest)).otherwise(other)

    cells = (
        speeches.where(F.col("party").isin(*cues.party_names))
        .withColumn("title_key", title_key(F.col("debate_title")))
        .select(
            "title_key", "party", "speaker", "source_url", "speech_text", *order,
            F.explode_outer(F.concat(first_four("t", cues.tighten), first_four("l", cues.loosen))).alias("_m"),
        )
        .select(
            "title_key", "party", "speaker", "source_url", *order, "_m.*",
            F.substring(
                sentence_at(F.col("speech_text"), F.col("_m.start"), caps["decision"]), 1, caps["decision_total"]
            ).alias("sentence"),
        )
        .withColumn("strong", names(cues.legal_object) & names(cues.own_proposal) & ~names(cues.attribution) & ~other)
    )

    def count(direction: str, strong: bool) -> Column:
        confident = F.col("strong") if strong else ~F.col("strong")
        return F.count_if((F.col("direction") == direction) & confident)

    def example(direction: str) -> Column:
        rank = F.struct((~F.col("strong")).alias("weak"), *order, "start")
        return F.min_by(
            F.struct("sentence", "speaker", "source_url", "strong"), F.when(F.col("direction") == direction, rank)
        )

    return cells.groupBy("title_key", "party").agg(
        count("t", True).alias("tighten"),
        count("t", False).alias("tighten_low"),
        count("l", True).alias("loosen"),
        count("l", False).alias("loosen_low"),
        example("t").alias("tighten_example"),
        example("l").alias("loosen_example"),
    )


def decision_report(positions: DataFrame, directions: DataFrame) -> DataFrame:
    """Votes beside argued direction per decision and party: argued, talk without
    backing, dissent. Parties that only spoke about a decided title stay in."""
    decisions = positions.select(*DECISION).distinct()
    spoken = directions.select("title_key", "party", "tighten", "loosen", "tighten_low", "loosen_low")
    argued_rows = decisions.join(spoken, "title_key")
    debated = directions.select("title_key").distinct().withColumn("has_debate", F.lit(True))
    both = positions.select(*DECISION, "party", "position").join(argued_rows, [*DECISION, "party"], "full_outer")
    counts = ["tighten", "loosen", "tighten_low", "loosen_low"]
    argued = (F.col("tighten") + F.col("loosen")) > 0
    return (
        both.fillna(0, counts)
        .join(debated, "title_key", "left")
        .fillna(False, ["has_debate"])
        .withColumns(
            {
                "argued": argued,
                "talk_no_back": argued & F.coalesce(F.col("position").isin(*fv.VOTES_NOT_BACKING), F.lit(False)),
                "dissent": F.coalesce(F.col("position") == fv.VOTE_AGAINST, F.lit(False)),
            }
        )
    )


def report_totals(report: DataFrame) -> DataFrame:
    per_decision = report.groupBy(*DECISION).agg(
        F.bool_or("has_debate").alias("debate"), F.bool_or("talk_no_back").alias("conflict")
    )
    return per_decision.agg(
        F.count("*").alias("decisions_total"),
        F.count_if("debate").alias("decisions_with_debate"),
        F.count_if("conflict").alias("decisions_with_conflict"),
    )
