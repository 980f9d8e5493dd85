"""The marker lexicon as data: a Python tuple for pattern literals, a table for joins."""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from normtext import fixed_values as fv

CATEGORIES = ("duty", "exception", "qualifier")


class Marker(NamedTuple):
    category: str
    marker: str
    pattern: str
    weight: int


class Lexicon(NamedTuple):
    """Markers plus the patterns the other scans of a language need."""

    markers: tuple[Marker, ...]
    specific: str
    vague: str
    clause_boundary: str
    ceiling_opener: str
    ceiling_bound: str
    ceiling_window: int = fv.CEILING_WINDOW

    def of(self, category: str) -> list[Marker]:
        return [m for m in self.markers if m.category == category]

    def replacing(self, marker: str, pattern: str) -> Lexicon:
        """The same lexicon with one marker's pattern exchanged."""
        return self._replace(
            markers=tuple(m._replace(pattern=pattern) if m.marker == marker else m for m in self.markers)
        )


SWEDISH = Lexicon(
    tuple(Marker(*row) for row in fv.SWEDISH_MARKERS),
    fv.SPECIFIC_PATTERN,
    fv.VAGUE_PATTERN,
    fv.CLAUSE_BOUNDARY_PATTERN,
    fv.CEILING_OPENER,
    fv.CEILING_BOUND_PATTERN,
)

def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of ``pattern`` holds at least one; none if no such list can be told.

    Read off the parsed pattern: a sequence requires what any of its parts requires, and the part with the longest
    shortest literal is taken; an alternative requires one of what its branches require.
    """

    def of(parts) -> tuple[str, ...]:
        found: list[tuple[str, ...]] = []
        run = ""
        for kind, value in [*parts, (None, None)]:
            if kind is kinds.LITERAL:
                run += chr(value)
                continue
            if run and not any(c in "σςΣİı" or len(c.upper()) > 1 for c in run):  # these have several forms
                found.append((run.upper().lower(),))
            run = ""
            if kind is kinds.SUBPATTERN:
                found.append(of(value[3]))
            elif kind is kinds.BRANCH:
                branches = [of(b) for b in value[1]]
                found.append(tuple(dict.fromkeys(x for b in branches for x in b)) if all(branches) else ())
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
            elif kind is kinds.ATOMIC_GROUP:
                found.append(of(value))
        return max(filter(None, found), key=lambda x: min(map(len, x)), default=())

    try:
        return of(parser.parse(pattern))
    except re.error:  # a pattern of another dialect is tried on every text
        return ()


MARKER_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("marker", T.StringType(), False),
        T.StructField("weight", T.IntegerType(), False),
        T.StructField("pattern", T.StringType(), False),
    ]
)


def markers_table(spark: SparkSession, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """One row per marker; ``position`` is its place in the ranking order."""
    rows = [
        (position, m.category, m.marker, m.weight, m.pattern)
        for position, m in enumerate(lexicon.markers)
    ]
    return spark.createDataFrame(rows, MARKER_SCHEMA)
