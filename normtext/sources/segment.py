"""Documents into provisions: HTML paragraphs, transitional sections, numbered sections.

A document is one row and is read inside its task: HTML by ``html_reader``, sections with
array expressions. No shuffle and no window over a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.functions.text import strip
from normtext.sources.html_reader import PARAGRAPH, REJECT, TRANSITIONAL_PROVISION, read_statutes

HEADING_LINE = r"(?m)^(?=\d+(?:\.\d+)*\.?[^\S\n]+\S)"


def segment_provisions(documents: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """One row per paragraph anchor, in order. A repeated anchor keeps its rows: the
    second one is suffixed ``:occurrence:2``. Documents without anchors yield nothing."""
    return read_statutes(documents, keep, (PARAGRAPH,))


def segment_transitional(documents: DataFrame, keep: Sequence[str] = ("document_id",)) -> tuple[DataFrame, DataFrame]:
    """(provisions, rejects) of the transitional section, cut at lines that are only
    ``YYYY:N``. No section yields nothing; a section without markers is a reject."""
    reason = F.lit("transitional section without markers").alias("reason")
    return read_statutes(documents, keep, (TRANSITIONAL_PROVISION,)), read_statutes(documents, keep, (REJECT,)).select(*keep, reason)


def segment_statutes(documents: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """The rows of ``segment_provisions`` and the provisions of ``segment_transitional``, each source read once."""
    return read_statutes(documents, keep, (PARAGRAPH, TRANSITIONAL_PROVISION))


def segment_sections(documents: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """Numbered sections of plain-text specifications, page furniture dropped.

    The heading line stays in the body. A repeated number keeps its last body.
    """
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    furniture = lambda l: l.startswith("\f") | l.rlike(fv.SECTION_FOOTER) | l.rlike(fv.SECTION_HEADER)
    clean = F.array_join(F.filter(lines, lambda l: ~furniture(l)), "\n")
    bodies = F.filter(F.split(clean, HEADING_LINE, -1), lambda b: b.rlike(HEADING_LINE.replace("(?m)^", r"\A")))
    cut = documents.select(*keep, bodies.alias("_bodies"))
    cut = cut.withColumn("_numbers", F.transform("_bodies", lambda b: F.regexp_extract(b, r"\A(\d+(?:\.\d+)*)", 1)))
    # Sorted with their places, a number is the last of its kind where the next one differs.
    last = F.expr(
        "get(transform(array(array_sort(transform(_numbers, (n, i) -> named_struct('n', n, 'place', i)))), q -> transform(array_sort("
        "transform(q, (x, i) -> named_struct('place', x.place, 'last', coalesce(get(q, i + 1).n <> x.n, true)))), x -> x.last)), 0)"
    )
    rows = cut.select(*keep, F.posexplode(F.arrays_zip("_bodies", "_numbers", last.alias("_last"))).alias("_i", "_z"))
    return rows.where(F.col("_z._last")).select(
        *keep,
        F.col("_z._numbers").alias("section"),
        strip(F.regexp_extract("_z._bodies", r"\A\d+(?:\.\d+)*\.?[^\S\n]+(\S[^\n]*)", 1)).alias("title"),
        strip(F.col("_z._bodies")).alias("text"),
    )
