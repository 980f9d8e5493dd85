"""The marker scan against plain matching, and what it does per text."""

import random
import re

from pyspark.sql import functions as F

from normtext.functions.text import MARKS, matches
from normtext.lexicon import SWEDISH, required_literals
from normtext.operators import markers
from normtext.plans.bindings import STAND_IN

WORDS = (
    "ska skall får inte om inte dock måste SKA Får endast när i den utsträckning till den del särskilda skäl undantag undantagsvis trots vad"
    " utan hinder av är skyldig förbjudet FÖRBUD rätt att the with of by for unless and this that are åligger annat än , . ; : \n"
).split(" ")


def texts(rng, n):
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(80))) for _ in range(n)]
    out += ["", "om", "﷐ska﷑ får ﷒inte﷐ om", "ſka ſkall İnte får ınte", "ska " * 3000, "🙂 ska 🙂🙂 får x y inte 🙂"]
    return out


def plain(text, lexicon):
    return [
        (m.marker, i, found.group(), found.start(), found.end())
        for i, m in enumerate(lexicon.markers)
        for found in re.finditer(m.pattern, text, re.I)
    ]


def test_hits_match_plain(spark):
    rows = list(enumerate(texts(random.Random(41), 150)))
    table = spark.createDataFrame(rows, "provision_id int, text string").repartition(4)
    for lexicon in (SWEDISH, STAND_IN):
        found = {}
        for r in markers.marker_hits(table, lexicon).collect():
            found.setdefault(r.provision_id, []).append((r.marker, r.position, r.matched_span, r.char_offset, r.char_end))
        for i, text in rows:
            if "ınte" not in text:  # the two engines fold the dotted and dotless i differently
                assert found.get(i, []) == plain(text, lexicon), text
        fired = {(r.provision_id, r.marker) for r in markers.fired_markers(table, lexicon).collect()}
        assert fired == {(i, h[0]) for i, hits in found.items() for h in hits}
        named = table.select("provision_id", markers.fired("text", lexicon).alias("f")).collect()
        assert {(r.provision_id, m) for r in named for m in r.f} == fired


def test_gate_hides_nothing(spark):
    """With and without the gate, also where letters have several forms."""
    rows = [(i, t) for i, t in enumerate(texts(random.Random(42), 100))]
    table = spark.createDataFrame(rows, "provision_id int, text string")
    for m in SWEDISH.markers:
        assert required_literals(m.pattern), m
    gated = {tuple(r) for r in markers.marker_hits(table).collect()}
    every = set()
    for i, m in enumerate(SWEDISH.markers):
        alone = table.select("provision_id", F.explode(matches("text", markers.IGNORE_CASE + m.pattern)).alias("x"))
        every |= {(r.provision_id, m.category, m.marker, i, r.x.span, r.x.start, r.x.end) for r in alone.collect()}
    assert gated == every


def test_passes_over_a_text(spark):
    """One search in the plan for all markers; a text without their words is searched by none."""
    table = spark.createDataFrame([("rad ett av text", 0), ("detta ska dock ske", 2), ("får inte", 4)], "text string, n int")
    assert len(SWEDISH.markers) == 28
    plan = table.select(markers.hits().alias("h"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract_all" not in plan and "rlike" not in plan.lower()
    tried = table.select("n", F.expr(markers.able_sql("text", SWEDISH, SWEDISH.markers)).alias("able")).collect()
    assert [len(r.able) for r in tried][:2] == [0, 2] and all(len(r.able) <= max(r.n, 6) for r in tried)


def test_clauses_and_marks_in_texts(spark):
    text = f"om {MARKS[0]}a{MARKS[1]} när b; om c"
    table = spark.createDataFrame([(1, text)], "provision_id int, text string")
    found = markers.qualifier_spans(table).orderBy("clause_start", "marker").collect()
    assert [(r.marker, r.clause, r.clause_start, r.clause_end) for r in found] == [
        ("om", text[:12], 0, 12), ("när/vid", "när b", 7, 12), ("om", "om c", 14, 18)
    ]


def test_required_literals():
    assert required_literals(r"\bom\b") == ("om",) and required_literals(r"\w+") == () and required_literals("(") == ()
    assert required_literals(r"(?:ab|cde)x?") == ("ab", "cde") and required_literals(r"(?:ab|\d)") == ()
    assert required_literals(r"(?:ab){0,2}c+") == ("c",) and required_literals("STRAẞE|ß") == ()
