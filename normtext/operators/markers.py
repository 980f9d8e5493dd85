"""Selection: marker occurrences, determinacy and qualifier clauses of a text.

Everything is computed inside the row that holds the text, so the scan is one
narrow pass with no shuffle. Nothing here says what a text means; the direction
operators never import this module.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.functions.text import (
    BLOCK,
    IGNORE_CASE,
    around,
    distinct_lower,
    folded,
    found_sql,
    marked_sql,
    matches,
    one_line,
    quick,
    search,
    sql_literal,
)
from normtext.lexicon import CATEGORIES, SWEDISH, Lexicon, Marker, required_literals

HIT_TYPE = (
    "array<struct<category:string,marker:string,position:int,"
    "matched_span:string,char_offset:int,char_end:int>>"
)
CLAUSE_REST = r"[^.,;:]*"


def hits(
    text: str = "text",
    lexicon: Lexicon = SWEDISH,
    markers: Sequence[Marker] | None = None,
    ahead: str | None = None,
    ahead_of: Sequence[str] = CATEGORIES,
) -> Column:
    """All occurrences of all markers as an array of structs, marker by marker.

    Overlaps between different markers are kept: each marker is scanned alone. ``ahead`` is a pattern for
    text to read after each match of a marker of the categories ``ahead_of``; it is empty for the others.
    """
    chosen = lexicon.markers if markers is None else markers
    if not chosen:
        return F.expr(f"cast(array() AS {HIT_TYPE.replace('>>', ',ahead:string>>') if ahead else HIT_TYPE})")
    extra = ", 'ahead', x.ahead" if ahead else ""
    return F.expr(
        f"flatten(transform({marked_sql(text)}, v -> flatten(transform({able_sql(text, lexicon, chosen, ahead, ahead_of)},"
        f" m -> transform({found_sql(text, 'm.pattern', 'm.replacement')},"
        " x -> named_struct('category', m.category, 'marker', m.marker, 'position', m.position, 'matched_span', x.span,"
        f" 'char_offset', x.start, 'char_end', x.end{extra}))))))"
    )


def able_sql(
    text: str, lexicon: Lexicon, chosen: Sequence[Marker], ahead: str | None = None, ahead_of: Sequence[str] = CATEGORIES
) -> str:
    """SQL for the markers that can fire on ``text``, as structs with their pattern: those of which a required literal occurs.

    The lexicon is data in the plan, not a branch of it, so the plan is as small for eighty markers as for one.
    """

    def row(m: Marker) -> str:
        pattern, replacement = search(quick(IGNORE_CASE, m.pattern), ahead if m.category in ahead_of else None)
        literals = required_literals(m.pattern)
        needed = f"array({', '.join(map(sql_literal, literals))})" if literals else "cast(array() AS array<string>)"
        return (
            f"named_struct('category', {sql_literal(m.category)}, 'marker', {sql_literal(m.marker)}, 'weight', {m.weight},"
            f" 'position', {lexicon.markers.index(m)}, 'pattern', {sql_literal(pattern)}, 'replacement', {sql_literal(replacement)}, 'literals', {needed})"
        )

    rows = f"array({', '.join(map(row, chosen))})"
    return f"flatten(transform(array({folded(text)}), f -> filter({rows}, m -> size(m.literals) = 0 OR exists(m.literals, l -> contains(f, l)))))"


def in_reading_order(found: Column) -> Column:
    """The hits by start, the longer one first, then by marker."""
    keyed = F.transform(
        found,
        lambda h: F.struct(h["char_offset"], (-h["char_end"]).alias("_e"), h["position"], h.alias("hit")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["hit"])


def ordered_hits(text: str = "text", lexicon: Lexicon = SWEDISH) -> Column:
    """The hits in reading order: by start, the longer one first, then by marker."""
    return in_reading_order(hits(text, lexicon))


def hits_with_clauses(text: str = "text", lexicon: Lexicon = SWEDISH) -> Column:
    """All hits, those of qualifiers with the rest of their clause in ``ahead``: one search for hits, flags and clauses."""
    return hits(text, lexicon, ahead=CLAUSE_REST, ahead_of=("qualifier",))


def without_ahead(found: Column) -> Column:
    """The hits as ``hits`` gives them, from those of ``hits_with_clauses``."""
    return F.transform(found, lambda h: h.dropFields("ahead"))


def marker_hits(df: DataFrame, lexicon: Lexicon = SWEDISH, keep: Sequence[str] = ("provision_id",)) -> DataFrame:
    """One row per occurrence, over every provision, with verbatim span and offsets."""
    return df.select(*keep, F.explode(hits("text", lexicon)).alias("_h")).select(*keep, "_h.*")


def fires(text: Column, marker: Marker) -> Column:
    return text.rlike(quick(IGNORE_CASE, marker.pattern))


def _fired_sql(text: str, lexicon: Lexicon, chosen: Sequence[Marker]) -> str:
    return f"filter({able_sql(text, lexicon, chosen)}, m -> rlike({text}, m.pattern))"


def fired(text: str = "text", lexicon: Lexicon = SWEDISH, category: str | None = None) -> Column:
    """The labels that fire, once each, in lexicon order."""
    chosen = lexicon.markers if category is None else lexicon.of(category)
    if not chosen:
        return F.expr("cast(array() AS array<string>)")
    return F.expr(f"transform({_fired_sql(text, lexicon, chosen)}, m -> m.marker)")


def fired_markers(df: DataFrame, lexicon: Lexicon = SWEDISH, keep: Sequence[str] = ("provision_id",)) -> DataFrame:
    """One row per (provision, marker) that fires at least once."""
    entries = F.expr(
        f"transform({_fired_sql('text', lexicon, lexicon.markers)}, m -> named_struct('category', m.category, 'marker', m.marker, 'weight', m.weight))"
    )
    return df.select(*keep, F.explode(entries).alias("_m")).select(*keep, "_m.*")


def determinacy_of(specific: Column, vague: Column) -> Column:
    return F.when(specific, "specific").when(vague, "vague").otherwise("unmarked")


def determinacy(text: Column, lexicon: Lexicon = SWEDISH) -> Column:
    """The rung a text reaches: specific, vague or unmarked."""
    return determinacy_of(
        text.rlike(quick(IGNORE_CASE, lexicon.specific)), text.rlike(quick(IGNORE_CASE, lexicon.vague))
    )


def with_determinacy(df: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """Adds the rung and the distinct lower-cased terms behind it."""
    text = F.col("text")
    return df.withColumns(
        {
            "determinacy": determinacy(text, lexicon),
            "specific_terms": distinct_lower(text, quick(IGNORE_CASE, lexicon.specific)),
            "vague_terms": distinct_lower(text, quick(IGNORE_CASE, lexicon.vague)),
        }
    )


def clauses_of(found: Column) -> Column:
    """The clauses from hits of qualifiers with the rest of their clause ahead."""

    def clause(hit: Column) -> Column:
        return F.struct(
            hit["marker"].alias("marker"),
            F.concat(hit["matched_span"], hit["ahead"]).alias("clause"),
            hit["char_offset"].alias("clause_start"),
            (hit["char_end"] + F.length(hit["ahead"])).cast("int").alias("clause_end"),
        )

    return F.transform(found, clause)


def qualifier_clauses(text: str = "text", lexicon: Lexicon = SWEDISH) -> Column:
    """The clause each qualifier hit opens: up to the next ``.,;:`` or the end of the text."""
    return clauses_of(hits(text, lexicon, lexicon.of("qualifier"), ahead=CLAUSE_REST))


def qualifier_spans(df: DataFrame, lexicon: Lexicon = SWEDISH, keep: Sequence[str] = ("provision_id",)) -> DataFrame:
    clauses = F.explode(qualifier_clauses("text", lexicon))
    return df.select(*keep, clauses.alias("_q")).select(*keep, "_q.*")


def _clause_terms(clauses: Column, pattern: str) -> Column:
    found = F.transform(
        clauses, lambda c: F.regexp_extract_all(c["clause"], F.lit(quick(IGNORE_CASE, pattern)), F.lit(0))
    )
    return F.array_sort(F.array_distinct(F.transform(F.flatten(found), F.lower)))


def with_qualifier_determinacy(
    df: DataFrame, lexicon: Lexicon = SWEDISH, found: Column | None = None
) -> DataFrame:
    """The rung reached inside the qualifier clauses only, with the terms behind it.

    ``found`` gives the clauses where they are known already. The rung asks for a first match only, so the
    terms cost nothing where nobody reads them.
    """
    clauses = F.col("_clauses")
    graded = df.withColumn("_clauses", qualifier_clauses("text", lexicon) if found is None else found).withColumns(
        {
            "qualifier_specific": _clause_terms(clauses, lexicon.specific),
            "qualifier_vague": _clause_terms(clauses, lexicon.vague),
        }
    )
    holds = lambda pattern: F.exists(clauses, lambda c: c["clause"].rlike(quick(IGNORE_CASE, pattern)))
    rung = determinacy_of(holds(lexicon.specific), holds(lexicon.vague))
    return graded.withColumn("qualifier_determinacy", rung).drop("_clauses")


def ceiling_windows(text: str = "text", lexicon: Lexicon = SWEDISH) -> Column:
    """Each opener with the characters after it, and whether a bound word stands there."""

    def window(hit: Column) -> Column:
        span = F.concat(hit["span"], hit["ahead"])
        return F.struct(
            hit["start"].alias("char_offset"),
            one_line(span).alias("window"),
            span.rlike(quick(IGNORE_CASE, lexicon.ceiling_bound)).alias("has_bound"),
        )

    after = f"(?s:.{{0,{lexicon.ceiling_window}}})"
    return F.transform(matches(text, quick(IGNORE_CASE, lexicon.ceiling_opener), after), window)


def ceiling_flags(df: DataFrame, lexicon: Lexicon = SWEDISH, keep: Sequence[str] = ("provision_id",)) -> DataFrame:
    windows = F.explode(ceiling_windows("text", lexicon))
    return df.select(*keep, windows.alias("_w")).select(*keep, "_w.*")


def ceiling_scan(gated: DataFrame, lexicon: Lexicon = SWEDISH) -> DataFrame:
    """How many texts have an opener, and how many of those a bound word behind it; no share without an opener."""
    seen = gated.select(F.transform(ceiling_windows("text", lexicon), lambda w: w["has_bound"]).alias("bounds"))
    opener, flagged = F.size("bounds") > 0, F.exists("bounds", lambda b: b)
    return seen.agg(
        F.count("*").alias("candidates"),
        F.count_if(opener).alias("with_opener"),
        F.count_if(flagged).alias("flagged"),
        F.round(F.try_divide(100.0 * F.count_if(flagged), F.count_if(opener)), 1).alias("flagged_pct"),
    )


def kwic(hits_with_text: DataFrame, width: int) -> DataFrame:
    """Adds ``context``: ``width`` characters either side of each hit, on one line."""
    return hits_with_text.withColumn(
        "context", around(F.col("text"), F.col("char_offset"), F.col("char_end"), width)
    )


def layer_spans(df: DataFrame, lexicon: Lexicon = SWEDISH, keep: Sequence[str] = ("provision_id",)) -> DataFrame:
    """Cut each text at every span edge; list the spans covering each piece.

    One fold over the sorted edges, inside the row that holds the text: it carries the
    spans that are open, and finishes a piece at each new edge. Matches of one marker
    never overlap each other, so at most one span per marker is open, however long the
    text. The narrowest span wins the piece. Nothing is shuffled.
    """
    open_span = "struct<seq:int,width:int,category:string,marker:string>"
    piece = "struct<piece:int,start:int,end:int,piece_text:string,covering:string,narrowest:string>"
    edges = (
        "array_sort(concat(transform(q, (h, i) -> named_struct('at', h.char_offset, 'opens', 1, 'seq', i)),"
        " transform(q, (h, i) -> named_struct('at', h.char_end, 'opens', 0, 'seq', i)),"
        " array(named_struct('at', length(text), 'opens', 2, 'seq', -1))))"
    )
    opened = (
        "named_struct('seq', x.seq, 'width', get(q, x.seq).char_end - get(q, x.seq).char_offset,"
        " 'category', get(q, x.seq).category, 'marker', get(q, x.seq).marker)"
    )
    item = (
        "array(named_struct('piece', s.piece, 'start', s.at, 'end', x.at, 'piece_text', substring(text, s.at + 1, x.at - s.at),"
        " 'covering', array_join(transform(s.active, a -> concat_ws(':', a.category, a.marker)), ', '),"
        " 'narrowest', array_min(transform(s.active, a -> named_struct('width', a.width, 'seq', a.seq, 'category', a.category))).category))"
    )
    full, cuts = f"size(s.block) >= {BLOCK}", "x.at > s.at"
    fold = (
        f"aggregate({edges}, named_struct('at', 0, 'piece', 0, 'active', cast(array() AS array<{open_span}>),"
        f" 'block', cast(array() AS array<{piece}>), 'done', cast(array() AS array<array<{piece}>>)),"
        f" (s, x) -> named_struct('at', x.at, 'piece', if({cuts}, s.piece + 1, s.piece),"
        f" 'active', CASE x.opens WHEN 1 THEN concat(s.active, array({opened}))"
        f" WHEN 0 THEN filter(s.active, a -> a.seq <> x.seq) ELSE s.active END,"
        f" 'block', if({cuts}, if({full}, {item}, concat(s.block, {item})), s.block),"
        f" 'done', if({cuts} AND {full}, concat(s.done, array(s.block)), s.done)),"
        f" s -> flatten(concat(s.done, array(s.block))))"
    )
    found = df.select(*keep, "text", ordered_hits("text", lexicon).alias("_hits"))
    pieces = F.expr(f"get(transform(array(_hits), q -> {fold}), 0)")
    return found.select(*keep, F.explode(pieces).alias("_p")).select(*keep, "_p.*")
