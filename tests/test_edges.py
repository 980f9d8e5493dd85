"""Cases the registered queries don't hold: empty inputs, constant columns, runs with equal ids, deep chains, many targets."""

import html
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from normtext.functions.markup import decode_references
from normtext.operators import gold, markers, profile, runs, slots
from normtext.operators.matching import Merges, Tie, match_lengths, sweep

PASSAGES = "passage_id string, chars long"


def nearest_unused(targets, controls):
    """The rule as it is stated, one target after the other."""
    pool = sorted(controls)
    lengths, free, out = np.array([n for _, n in pool]), np.ones(len(pool), bool), []
    for name, length in sorted(targets, key=lambda t: (t[1], t[0])):
        i = int(np.where(free, abs(lengths - length), 1 << 60).argmin())
        free[i] = False
        out.append((pool[i][0], name, int(lengths[i]), int(lengths[i] - length)))
    return sorted(out)


@pytest.mark.parametrize("n, m, longest", [(16, 40, 30), (1000, 1200, 500), (1001, 1001, 200), (5000, 6000, 3000), (400, 8000, 90_000), (50, 900, 3)])
def test_length_matching_at_every_size(spark, n, m, longest):
    rng = random.Random(n)
    targets = [(f"t{i}", rng.randrange(longest)) for i in range(n)]
    controls = [(f"c{i}", rng.randrange(longest)) for i in range(m)]
    found = match_lengths(spark.createDataFrame(targets, PASSAGES), spark.createDataFrame(controls, PASSAGES))
    assert sorted(map(tuple, found.collect())) == nearest_unused(targets, controls)


def test_length_matching_with_chains_of_ties(spark, monkeypatch):
    """Every target stands half way between two lengths, and what one leaves the next one splits: ids decide all along."""
    rng = random.Random(9)
    targets = [(f"t{i}", 10 * (i // 5) + 5) for i in range(1500)]
    controls = [(f"{rng.randrange(1500):05d}", 10 * (i // 7)) for i in range(2200)]  # many equal ids
    sweeps = []
    monkeypatch.setattr("normtext.operators.matching.sweep", lambda *a: sweeps.append(sweep(*a)) or sweeps[-1])
    found = match_lengths(spark.createDataFrame(targets, PASSAGES), spark.createDataFrame(controls, PASSAGES))
    assert sorted(map(tuple, found.collect())) == nearest_unused(targets, controls)
    assert len(sweeps[0].guessed) > 250 and len(sweeps) <= 4


def test_length_matching_with_large_ties(spark):
    """One length holds a third of all controls and ties again and again; answers reach over their window."""
    rng = random.Random(10)
    targets = [(f"t{i}", 50 + (i % 3)) for i in range(4000)]
    controls = [(f"c{rng.random()}", rng.choice([0, 49, 51, 53, 100, 101, 104])) for i in range(9000)]
    found = match_lengths(spark.createDataFrame(targets, PASSAGES), spark.createDataFrame(controls, PASSAGES))
    assert sorted(map(tuple, found.collect())) == nearest_unused(targets, controls)
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_sweep_holds_counts_only():
    """A thousand million rows in three lengths are a few steps."""
    settled = sweep({5: 10**9, 6: 5}, {4: 10**9, 6: 10**9, 9: 1}, Merges())
    assert settled.guessed == {Tie(0, 1, 10**9)}
    merges = Merges()
    merges.learn(0, 1, 10**9 - 2, 4 * 10**8, "0110")
    settled = sweep({5: 10**9, 6: 5}, {4: 10**9, 6: 10**9, 9: 1}, merges)
    assert not settled.guessed and settled.ties == [(0, 0, 4 * 10**8 + 1, 10**9, 6 * 10**8 - 1)]
    assert settled.runs == [(10**9, 16 * 10**8 - 1, 5)]


def test_rows_without_a_length(spark):
    targets = spark.createDataFrame([("t", 3), ("u", None)], PASSAGES)
    controls = spark.createDataFrame([("c", None), ("d", 9), (None, 3)], PASSAGES)
    assert [tuple(r) for r in match_lengths(targets, controls).collect()] == [(None, "t", 3, 0)]
    assert match_lengths(targets.limit(0), controls).count() == 0


def test_too_few_controls(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], PASSAGES)
    with pytest.raises(ValueError, match="not enough controls"):
        match_lengths(one, one.limit(1))


def test_runs_with_equal_ids_stay_apart(spark):
    passages = spark.createDataFrame([("r1", "p", None), ("r2", "p", None)], "run_id string, passage_id string, styles array<string>")
    cells = runs.grid(passages, [("s", "a")], 2)
    texts = spark.createDataFrame([("r1", "p:s:a", 1), ("r2", "p:s:a", 2)], "run_id string, chain_id string, generation int")
    ended = spark.createDataFrame([], "run_id string, chain_id string")
    following = {r.run_id: r.next_generation for r in runs.next_generations(cells, texts, ended).collect()}
    assert following == {"r1": 2, "r2": 1}
    covered = {r.run_id: (r.planned, r.generated, r.complete) for r in runs.coverage(cells, texts).collect()}
    assert covered == {"r1": (2, 1, False), "r2": (2, 1, False)}
    counted = {(r.run_id, r.generation): r.texts for r in runs.texts_per_generation(texts, 2).collect()}
    assert counted == {("r1", 0): 0, ("r1", 1): 1, ("r1", 2): 0, ("r2", 0): 0, ("r2", 1): 0, ("r2", 2): 1}
    answers = [(run, model, "t", "s", "k", status, True) for run, status in (("r1", "present"), ("r2", "absent")) for model in ("ref", "other")]
    board = runs.reader_scoreboard(
        spark.createDataFrame(answers, "run_id string, model string, text_id string, slot_id string, kind string, status string, valid boolean"), "ref"
    )
    assert {(r.model, r.answers, r.agreement) for r in board.collect()} == {("ref", 2, 1.0), ("other", 2, 1.0)}


@pytest.mark.parametrize("depth, missing, lost", [(200, None, None), (200, None, 150), (200, 90, 150), (3, None, 2)])
def test_first_absence_at_any_depth(spark, depth, missing, lost):
    rows = [("k", g, "absent" if g == lost else "not_read" if g == missing else "present") for g in range(depth + 1)]
    found = runs.first_absence(spark.createDataFrame(rows, "key string, generation int, status string"), ["key"], depth).first()
    assert found.first_absent == lost and found.reappeared == (lost is not None and lost < depth)
    assert found.timing == ("unresolved" if missing else "observed" if lost else "not_observed_through_depth")


def test_orphan_generations_are_reported(spark):
    def records(kind, rows):
        return runs.read_records(spark.createDataFrame(rows, "run_id string, value string"), kind)

    tables = runs.project_run({
        "runs": spark.createDataFrame([("r", "completed")], "run_id string, status string"),
        "sources": records("sources", [("r", '{"passage_id":"p","text":"x"}')]),
        "generations": records("generations", [("r", '{"text_id":"a","passage_id":"p","generation":1}'), ("r", '{"text_id":"b","passage_id":"q","generation":1}')]),
        "readings": records("readings", []),
        "calls": records("calls", []).withColumn("event_index", F.lit(1)),
    })
    assert {r.text_id for r in tables["texts"].collect()} == {"source:p", "a"}
    assert [(r.text_id, r.reason) for r in tables["rejects"].collect()] == [("b", "source missing")]
    assert tables["source_slots"].count() == 0


def test_ratios_over_nothing(spark):
    texts = spark.createDataFrame([], "provision_id string, text string, char_count int")
    assert {r.corpus_share for r in gold.marker_frequency(texts).collect()} == {None}
    assert markers.ceiling_scan(texts).first().flagged_pct is None
    none = markers.ceiling_scan(spark.createDataFrame([("no opener here",)], "text string")).first()
    assert (none.candidates, none.with_opener, none.flagged_pct) == (1, 0, None)
    constant = spark.createDataFrame([(1, 2), (1, 3), (1, 5)], "x int, y int")
    assert tuple(profile.correlations(constant, "x", "y").first()) == (None, None)
    assert tuple(profile.correlations(constant.limit(0), "x", "y").first()) == (None, None)
    candidates = spark.createDataFrame([], "score double, determinacy string")
    assert profile.pool_comparison({"none": (texts, candidates)}).first().candidate_rate is None
    passage = spark.createDataFrame([("p", "d", "", [])], "passage_id string, domain string, text string, slots array<struct<quote:string>>")
    assert slots.quote_coverage(passage).first().coverage is None
    writes = spark.createDataFrame([("m", 4, 0, 0.1), ("m", 4, 2, 0.1)], "model string, chars int, source_chars int, usd double")
    assert runs.writer_scoreboard(writes).first().mean_length_ratio == 2.0


def test_character_references(spark):
    texts = [
        "&aring;&Ouml;&sect;&#167;&#xA7;&#XE5; &amp;lt; &lt;b&gt; &copy", "no reference", "AT&T & R&D; &unknown; &;", "&#128578;&apos;&quot;&nbsp;&amp;", "", None, "&",
    ]
    found = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(decode_references(F.col("t")).alias("t")).collect()]
    assert found == [t if t is None else html.unescape(t) for t in texts]
    assert [r.t for r in spark.createDataFrame([("&#0;&#xD800;",)], "t string").select(decode_references(F.col("t")).alias("t")).collect()] == ["��"]
