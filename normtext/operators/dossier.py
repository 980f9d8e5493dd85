"""Everything known about a provision, on one row."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.lexicon import SWEDISH, Lexicon
from normtext.operators.markers import (
    ceiling_windows,
    clauses_of,
    hits_with_clauses,
    in_reading_order,
    with_determinacy,
    with_qualifier_determinacy,
    without_ahead,
)
from normtext.operators.shortlist import score
from normtext.session import stable


def dossier(
    provisions: DataFrame,
    ranks: DataFrame | Callable[[DataFrame], DataFrame],
    lexicon: Lexicon = SWEDISH,
    digest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Spans, clauses, both rungs, score breakdown, rank and ceiling flags per provision.

    ``ranks`` is the ranked shortlist (provision_id, rank), or a function that makes it from the rows graded
    here, which are then stored, so that no text is graded twice. The spans come from the
    provision's own text, so only the rank needs a join. Each marker is searched once; flags, spans
    and clauses all come from its hits. ``digest`` names columns made of the dossier's own before that
    join: only they, the id, the rank and ``table_rows`` are then carried through it.
    """
    read = provisions.select("provision_id", "text").withColumn("_hits", hits_with_clauses("text", lexicon))
    qualifiers = F.filter("_hits", lambda h: h["category"] == "qualifier")
    graded = score(read, lexicon, found="_hits").drop("determinacy")
    graded = graded.withColumn("qualifier_clauses", clauses_of(qualifiers))
    graded = with_qualifier_determinacy(with_determinacy(graded, lexicon), lexicon, F.col("qualifier_clauses"))
    wide = graded.withColumns(
        {
            "marker_spans": in_reading_order(without_ahead(F.col("_hits"))),
            "ceiling_flags": F.filter(ceiling_windows("text", lexicon), lambda w: w["has_bound"]),
            "_n": F.size("_hits"),
        }
    ).drop("_hits")
    if digest is not None:
        wide = wide.select("provision_id", "_n", *[column.alias(name) for name, column in digest.items()])
    if callable(ranks):
        wide = stable(wide)
        ranks = ranks(wide)
    return (
        wide.join(ranks.select("provision_id", "rank"), "provision_id", "left")
        .withColumn("is_candidate", F.col("rank").isNotNull())
        .withColumn(
            "table_rows",
            F.struct(
                F.lit(1).alias("provisions"),
                F.col("is_candidate").cast("int").alias("candidates"),
                F.col("_n").alias("marker_hits"),
            ),
        )
        .drop("_n")
    )
