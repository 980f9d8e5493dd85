"""Readers: text to slot observations, and literal evidence for a quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.functions.text import matches_sql, spaced_pattern


def verbatim_read(pairs: DataFrame) -> DataFrame:
    """Rows of (text, quote, ...): present iff the quote stands in the text verbatim."""
    quote = F.col("quote")
    present = F.coalesce((quote != "") & F.contains(F.col("text"), quote), F.lit(False))
    return pairs.withColumns(
        {
            "status": F.when(present, "present").otherwise("absent"),
            "found_quote": F.when(present, quote),
        }
    )


def quote_audit(pairs: DataFrame) -> DataFrame:
    """Whitespace-tolerant literal search: status, count and the spans found.

    The pattern differs per row, so it is a column; only whitespace may vary.
    """
    usable = (F.trim("text") != "") & (F.trim("quote") != "")
    searched = pairs.withColumn("_pattern", F.when(usable, spaced_pattern(F.col("quote"))))
    found = F.expr(matches_sql("text", "_pattern", computed=True))
    return (
        searched.withColumn("evidence", F.when(F.col("_pattern").isNotNull(), found))
        .withColumns(
            {
                "occurrences": F.when(F.col("evidence").isNotNull(), F.size("evidence")),
                "literal_status": F.when(F.col("evidence").isNull(), "text and quote must be nonempty")
                .when(F.size("evidence") > 0, "found")
                .otherwise("not_found_requires_review"),
            }
        )
        .drop("_pattern")
    )
