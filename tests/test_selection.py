import random
import re

from pyspark.sql import functions as F

from normtext import fixed_values as fv
from normtext.lexicon import SWEDISH, markers_table
from normtext.operators import audits, markers, shortlist
from normtext.functions.text import IGNORE_CASE, leading_letters, quick
from normtext.operators.dossier import dossier
from normtext.plans import selection

RULE = (
    "Arbetsgivaren ska lämna besked inom två veckor, om inte särskilda skäl finns. Beskedet får dock\n"
    "inte dröja längre än tre månader; detta gäller inte om arbetstagaren är skyldig att vänta 😀 om något."
)
PLAIN = "Lagen träder i kraft den dag regeringen bestämmer."


def provisions(spark, *texts):
    rows = [(f"doc:P{i}", text) for i, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "provision_id string, text string")


def expected_hits(text):
    return sorted(
        (m.category, m.marker, found.group(0), found.start(), found.end())
        for m in SWEDISH.markers
        for found in re.finditer(m.pattern, text, re.IGNORECASE)
    )


def test_lexicon_has_every_marker(spark):
    table = markers_table(spark)
    assert table.count() == 28
    assert {r.category for r in table.collect()} == {"duty", "exception", "qualifier"}


def test_hits_and_offsets_equal_a_plain_scan(spark):
    got = markers.marker_hits(provisions(spark, RULE, PLAIN, "")).collect()
    found = sorted(
        (r.category, r.marker, r.matched_span, r.char_offset, r.char_end) for r in got if r.provision_id == "doc:P1"
    )
    assert found == expected_hits(RULE)
    assert all(RULE[r.char_offset : r.char_end] == r.matched_span for r in got if r.provision_id == "doc:P1")


def test_many_hits_cross_block_borders(spark):
    text = "om " * 1000
    got = markers.marker_hits(provisions(spark, text)).where("marker = 'om'").orderBy("char_offset").collect()
    assert [r.char_offset for r in got] == list(range(0, 3000, 3))


def test_score_and_rank(spark):
    scored = shortlist.score(provisions(spark, RULE, PLAIN)).orderBy("provision_id").collect()
    assert scored[1].score is None
    row = scored[0]
    assert (row.duty_strength, row.exception_strength, row.qualifier_strength) == (2 + 2, 3 + 2, 2 + 1)
    assert (row.specific_bonus, row.vague_bonus, row.length_bonus) == (4, 0, 4)
    assert row.duty_marker == "ska" and row.exception_marker == "dock" and row.qualifier_marker == "särskilda skäl"
    ranked = shortlist.shortlist(provisions(spark, RULE, RULE + " Mer.", PLAIN, RULE)).orderBy("rank").collect()
    assert [(r.rank, r.provision_id) for r in ranked] == [(1, "doc:P1"), (2, "doc:P4"), (3, "doc:P2")]


def test_determinacy_of_text_and_of_clauses(spark):
    text = "Hen ska svara inom två månader. Om det finns särskilda skäl får tiden dock vara skälig."
    row = markers.with_qualifier_determinacy(markers.with_determinacy(provisions(spark, text))).first()
    assert row.determinacy == "specific" and row.specific_terms == ["två månader"]
    assert row.qualifier_determinacy == "vague" and row.qualifier_vague == ["skälig"]


def test_clauses_end_at_punctuation(spark):
    row = markers.qualifier_spans(provisions(spark, "Detta gäller om det behövs, annars inte.")).first()
    assert (row.marker, row.clause, row.clause_start, row.clause_end) == ("om", "om det behövs", 13, 26)


def test_ceiling_window(spark):
    flags = markers.ceiling_flags(provisions(spark, "Tiden får dock\nvara högst sex månader. Dock ej alltid.")).collect()
    assert [f.has_bound for f in flags] == [True, False]
    assert "\n" not in flags[0].window


def test_layers_cover_the_text_once(spark):
    df = provisions(spark, RULE)
    pieces = markers.layer_spans(df).orderBy("start").collect()
    assert "".join(p.piece_text for p in pieces) == RULE
    joined = [p for p in pieces if p.covering.count(":") > 1]
    assert joined and all(p.narrowest for p in joined)


def test_scorecard_of_five_patterns(spark):
    texts = ["om den inte kommer", "om att det är sant och inte falskt", "om vapnet eller delen inte finns", "om hen inte vill"]
    labels = ["conditional", "spurious", "conditional", "conditional"]
    gold = spark.createDataFrame(
        [
            (f"doc:P{i}", 0, re.match(fv.NEGATED_CONDITION_PATTERNS["tempered_coord"] + "|om.*?inte", t).group(0), label)
            for i, (t, label) in enumerate(zip(texts, labels), 1)
        ],
        "provision_id string, char_offset int, span string, label string",
    )
    decided = audits.decisions(gold, provisions(spark, *texts), fv.NEGATED_CONDITION_PATTERNS, "conditional")
    cards = {r.pattern: r for r in audits.scorecard(decided).collect()}
    for name, pattern in fv.NEGATED_CONDITION_PATTERNS.items():
        fires = [bool(re.match(pattern, t, re.IGNORECASE)) for t in texts]
        positive = [label == "conditional" for label in labels]
        assert cards[name].true_positive == sum(f and p for f, p in zip(fires, positive))
        assert cards[name].false_positive == sum(f and not p for f, p in zip(fires, positive))


def test_override_does_not_leak(spark):
    changed = SWEDISH.replacing("om inte", r"\bom\s+inte\b")
    assert [m.pattern for m in SWEDISH.markers if m.marker == "om inte"] == [r"\bom\s+(?:\w+\s+){0,3}?inte\b"]
    df = provisions(spark, "Hen ska vänta om den dagen inte är fri.")
    result = audits.projected_change(df, SWEDISH, changed).first()
    assert (result.candidates_before, result.candidates_after, result.leaving) == (1, 0, 1)


def test_dossier_agrees_with_the_tables(spark):
    df = provisions(spark, RULE, PLAIN)
    rows = {r.provision_id: r for r in dossier(df, shortlist.shortlist(df)).collect()}
    assert rows["doc:P1"].rank == 1 and not rows["doc:P2"].is_candidate
    assert len(rows["doc:P1"].marker_spans) == len(expected_hits(RULE))
    starts = [(s.char_offset, -s.char_end) for s in rows["doc:P1"].marker_spans]
    assert starts == sorted(starts)


def test_sample_is_stable_under_repartitioning(spark):
    hits = markers.marker_hits(provisions(spark, *[f"om {i} om" for i in range(50)]))
    one = {(r.provision_id, r.char_offset) for r in audits.crossing_sample(hits, 5, 7).collect()}
    two = {(r.provision_id, r.char_offset) for r in audits.crossing_sample(hits.repartition(7), 5, 7).collect()}
    assert one == two and len(one) == 5


def test_ceiling_scan_reads_the_whole_text(spark):
    text = "x " * 5000 + "Tiden är dock högst sex månader."
    assert markers.ceiling_flags(provisions(spark, text)).where(F.col("has_bound")).count() == 1


def documents_at(spark, tmp_path, *texts):
    """A documents table of the given texts, every third one in German."""
    rows = [(i, text, "de" if i % 3 == 0 else "en", "web", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    return str(tmp_path)


def test_dossier_searches_each_marker_once(spark):
    """Hits, flags and clauses come from one search, and a digest alone goes through the join."""
    texts = provisions(spark, RULE, PLAIN, "", RULE + "\n" + RULE, "\ufdd0 " + RULE)
    ranks = shortlist.shortlist(texts)
    wide = dossier(texts, ranks)
    plain = shortlist.score(texts).drop("determinacy")
    plain = markers.with_qualifier_determinacy(markers.with_determinacy(plain)).withColumns(
        {"marker_spans": markers.ordered_hits(), "qualifier_clauses": markers.qualifier_clauses()}
    )
    same = [c for c in plain.columns if c != "text"]
    order = lambda df: sorted(map(str, df.select(*same).collect()))
    assert order(wide) == order(plain)

    digest = dossier(texts, ranks, digest={"spans": F.size("marker_spans"), "score": F.col("score")})
    assert sorted(digest.columns) == ["is_candidate", "provision_id", "rank", "score", "spans", "table_rows"]
    found = {r.provision_id: (r.spans, r.score) for r in digest.collect()}
    assert found == {r.provision_id: (len(r.marker_spans), r.score) for r in wide.collect()}
    plan = digest._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"_(duty|exception|qualifier)_0#\d+, RLIKE|RLIKE\([^()]*\) AS _(duty|exception|qualifier)_", plan)
    assert "array_contains" in plan

    columns = {c: F.col(c) for c in shortlist.CANDIDATE_COLUMNS if c != "provision_id"}
    own = dossier(texts, lambda rows: shortlist.shortlist(rows, graded=True), digest=columns)
    ranked = lambda df: sorted((r.provision_id, r["rank"] or 0, r.score or 0) for r in df.collect())
    assert ranked(own) == ranked(wide) and max(r["rank"] or 0 for r in own.collect()) >= 2
    graded = shortlist.score(texts).transform(markers.with_qualifier_determinacy)
    for bounds in ((0, 0), (150, 250), (150, 0)):
        by_rows, by_texts = (shortlist.candidates(df, min_chars=bounds[0], max_chars=bounds[1], graded=g) for df, g in ((graded, True), (texts, False)))
        assert sorted(by_rows.collect()) == sorted(by_texts.collect())


def test_quick_patterns_match_as_the_plain_ones(spark):
    patterns = [m.pattern for m in SWEDISH.markers] + [SWEDISH.specific, SWEDISH.vague, r"\b(?:is|sk)\b|\bk\w*", r"\bThe\b", r"\bs\w+", r"\bi", r"\bs?k\w", r"\bi{1}s"]
    words = ["SKA", "ſka", "Ska", "\u212aan", "İs", "ıs", "is", "kan", "ska", "inte", "om", "the", "THE", "skall", "månader", ",", "😀", "två"]
    rng = random.Random(3)
    texts = [" ".join(rng.choices(words, k=6)) + rng.choice(["", " " + RULE, "\n" + PLAIN]) for _ in range(200)]
    df = provisions(spark, *texts)
    for p in patterns:
        differs = F.regexp_extract_all("text", F.lit(IGNORE_CASE + p), F.lit(0)) != F.regexp_extract_all(
            "text", F.lit(quick(IGNORE_CASE, p)), F.lit(0)
        )
        assert df.where(differs).count() == 0, p
    assert leading_letters(r"\b(?:is|was)\s+\w|\bin\b") == "iw" and leading_letters(r"\b(?:a)?b") == leading_letters(r"[ab]") == ""


def test_both_sampling_pools_come_from_one_reading(spark, tmp_path, monkeypatch):
    line = "The work of the house and so that it lasts, for us with those that are by the sea."
    sf_dir = documents_at(spark, tmp_path, *[f"{line}\n{'More of it. ' * i}{line}" for i in range(9)])
    reads = []
    real = selection.provisions
    monkeypatch.setattr(selection, "provisions", lambda *a: reads.append(a) or real(*a))
    sample = selection.stratified_sample(spark, sf_dir)
    rows = sample.collect()
    assert len(reads) == 1 and sf_dir not in str(sample.inputFiles())
    assert len(rows) == len({(r.provision_id, r.char_offset) for r in rows}) == 18
    assert {r.selection_reason for r in rows} <= {"known-defective-v1", "top-50-ranked", f"random-seed-{selection.SEED}"}
