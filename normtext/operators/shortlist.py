"""Selection: the rank score and the ranked shortlist.

The score orders a reading list. It must never feed a metric.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.functions.ordered import with_ordinal
from normtext.functions.text import IGNORE_CASE, quick
from normtext.lexicon import CATEGORIES, SWEDISH, Lexicon
from normtext.operators.markers import determinacy_of, fires, with_qualifier_determinacy
from normtext.session import stable


def _flag(category: str, index: int) -> str:
    return f"_{category}_{index}"


def with_flags(df: DataFrame, lexicon: Lexicon = SWEDISH, found: str | None = None) -> DataFrame:
    """One boolean column per marker, so each pattern runs once per text.

    ``found`` names a column with all hits of the text; then no pattern runs at all.
    """
    text = F.col("text")
    if found is None:
        fired = lambda m: fires(text, m)
    else:
        df = df.withColumn("_fired", F.array_distinct(F.transform(found, lambda h: h["position"])))
        fired = lambda m: F.when(
            text.isNotNull(), F.array_contains("_fired", F.lit(lexicon.markers.index(m)))
        )
    flagged = df.withColumns(
        {_flag(c, i): fired(m) for c in CATEGORIES for i, m in enumerate(lexicon.of(c))}
    )
    return flagged if found is None else flagged.drop("_fired")


def complete(text: Column, lexicon: Lexicon = SWEDISH) -> Column:
    """Whether every category fires, the category that most texts miss asked first: a text that misses one is done."""
    return reduce(
        lambda a, b: a & b,
        [any_of([fires(text, m) for m in lexicon.of(c)]) for c in ("exception", "duty", "qualifier")],
    )


def _flags(lexicon: Lexicon, category: str) -> list[Column]:
    return [F.col(_flag(category, i)) for i in range(len(lexicon.of(category)))]


def _drop_flags(lexicon: Lexicon) -> list[str]:
    return [_flag(c, i) for c in CATEGORIES for i in range(len(lexicon.of(c)))]


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def strength(lexicon: Lexicon, category: str) -> Column:
    """The heaviest fired weight plus at most two for further markers; 0 if none fires."""
    flags, markers = _flags(lexicon, category), lexicon.of(category)
    heaviest = F.greatest(F.lit(0), F.lit(0), *[F.when(f, m.weight).otherwise(0) for f, m in zip(flags, markers)])
    count = reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))
    return F.when(count > 0, heaviest + F.least(F.lit(2), count - 1)).otherwise(0).cast("int")


def top_marker(lexicon: Lexicon, category: str) -> Column:
    """The heaviest fired marker; the earlier one in the lexicon wins a tie."""
    ranked = sorted(enumerate(lexicon.of(category)), key=lambda im: (-im[1].weight, im[0]))
    return F.coalesce(
        *[F.when(F.col(_flag(category, i)), F.lit(m.marker)) for i, m in ranked],
        F.lit(None).cast("string"),
    )


def strengths(df: DataFrame, lexicon: Lexicon = SWEDISH, keep: Sequence[str] = ("provision_id",)) -> DataFrame:
    """Per provision and category: strength and carrying marker."""
    return with_flags(df, lexicon).select(
        *keep,
        *[strength(lexicon, c).alias(f"{c}_strength") for c in CATEGORIES],
        *[top_marker(lexicon, c).alias(f"{c}_marker") for c in CATEGORIES],
    )


def score(df: DataFrame, lexicon: Lexicon = SWEDISH, found: str | None = None) -> DataFrame:
    """Adds the score components and ``score``; all NULL unless every category fires.

    The categories gate first: a text that misses one is never graded further. ``found`` is as in ``with_flags``.
    """
    text = F.col("text")
    gated = with_flags(df, lexicon, found).withColumns(
        {f"has_{c}": any_of(_flags(lexicon, c)) for c in CATEGORIES}
    )
    complete = F.col("has_duty") & F.col("has_exception") & F.col("has_qualifier")
    graded = gated.withColumns(
        {
            "_complete": complete,
            "_specific": complete & text.rlike(quick(IGNORE_CASE, lexicon.specific)),
            "_vague": complete & text.rlike(quick(IGNORE_CASE, lexicon.vague)),
            "char_count": F.length(text).cast("int"),
        }
    )
    fits = F.col("char_count").between(fv.IDEAL_MIN_CHARS, fv.IDEAL_MAX_CHARS)
    when = lambda value: F.when(F.col("_complete"), value)
    parts = {f"{c}_strength": when(strength(lexicon, c)) for c in CATEGORIES} | {
        "specific_bonus": when(F.when(F.col("_specific"), fv.SPECIFIC_BONUS).otherwise(0)),
        "vague_bonus": when(F.when(F.col("_vague"), fv.VAGUE_BONUS).otherwise(0)),
        "length_bonus": when(F.when(fits, fv.LENGTH_BONUS).otherwise(0)),
        "determinacy": when(determinacy_of(F.col("_specific"), F.col("_vague"))),
    }
    parts |= {f"{c}_marker": when(top_marker(lexicon, c)) for c in CATEGORIES}
    total = [c for c in parts if c.endswith(("_strength", "_bonus"))]
    return (
        graded.withColumns(parts)
        .withColumn("score", reduce(lambda a, b: a + b, [F.col(c) for c in total]).cast("double"))
        .drop(*_drop_flags(lexicon), "_complete", "_specific", "_vague")
    )


CANDIDATE_COLUMNS = [
    "provision_id", "score", "has_duty", "has_exception", "has_qualifier", "determinacy",
    "qualifier_determinacy", "duty_marker", "exception_marker", "qualifier_marker", "char_count",
]


def candidates(
    df: DataFrame,
    lexicon: Lexicon = SWEDISH,
    min_chars: int = 0,
    max_chars: int = 0,
    keep: Sequence[str] = (),
    graded: bool = False,
) -> DataFrame:
    """Every provision carrying all three parts, unranked: one narrow pass, no shuffle.

    ``graded`` rows have the columns of a candidate from ``score`` and ``with_qualifier_determinacy`` already.
    """
    if graded:
        n = F.col("char_count")
        complete_rows = df.where(F.col("score").isNotNull() & (n >= min_chars) & (n <= (max_chars or 2**31 - 1)))
        return complete_rows.select(*CANDIDATE_COLUMNS, *keep)
    length = F.length("text")
    sized = df.where(length >= min_chars) if min_chars else df
    sized = sized.where(length <= max_chars) if max_chars else sized
    gated = score(sized.where(complete(F.col("text"), lexicon)), lexicon)
    return with_qualifier_determinacy(gated, lexicon).select(*CANDIDATE_COLUMNS, *keep)


def ranked(unranked: DataFrame) -> DataFrame:
    """1-based rank by score (high first), length (short first), id.

    The candidates are stored first: range partitioning samples its input, and
    without the stored rows that would scan every text a second time.
    """
    return with_ordinal(stable(unranked), [F.desc("score"), F.asc("char_count"), F.asc("provision_id")])


def shortlist(
    df: DataFrame,
    lexicon: Lexicon = SWEDISH,
    min_chars: int = 0,
    max_chars: int = 0,
    keep: Sequence[str] = (),
    graded: bool = False,
) -> DataFrame:
    """The candidates in reading order."""
    return ranked(candidates(df, lexicon, min_chars, max_chars, keep, graded))
