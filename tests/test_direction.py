import ast
import pathlib

import pytest

from normtext.operators import direction, runs

D = {"absent": 0, "vague": 1, "specific": 2}
M = {"absent": 0, "weak": 1, "binding": 2}
CASES = [
    # kind, part, before, after, scope, presence, sign
    ("condition", "duty", D["specific"], D["absent"], None, None, "tightening"),
    ("condition", "duty", D["vague"], D["specific"], None, None, "loosening"),
    ("condition", "exception", D["specific"], D["vague"], None, None, "loosening"),
    ("condition", "exception", D["vague"], D["specific"], None, None, "tightening"),
    ("condition", "ceiling", D["specific"], D["absent"], None, None, "loosening"),
    ("condition", "duty", 2, 2, None, None, "neutral"),
    ("bound", "ceiling", D["specific"], D["vague"], None, None, "loosening"),
    ("bound", "ceiling", D["vague"], D["specific"], None, None, "tightening"),
    ("modality", "duty", M["binding"], M["weak"], None, None, "loosening"),
    ("modality", "duty", M["weak"], M["binding"], None, None, "tightening"),
    ("modality", "exception", M["binding"], M["weak"], None, None, None),
    ("actor", "duty", None, None, "narrowed", None, "loosening"),
    ("actor", "duty", None, None, "broadened", None, "tightening"),
    ("actor", "exception", None, None, "narrowed", None, "tightening"),
    ("actor", "duty", None, None, "unchanged", None, "neutral"),
    ("part", "exception", None, None, None, "removed", "tightening"),
    ("part", "exception", None, None, None, "inserted", "loosening"),
    ("part", "ceiling", None, None, None, "removed", "loosening"),
    ("part", "ceiling", None, None, None, "inserted", "tightening"),
    ("part", "duty", None, None, None, "removed", None),
]


def test_sign_table(spark):
    rows = [(i, *case[:6], case[6]) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(
        rows, "i int, kind string, part string, before int, after int, scope string, presence string, want string"
    )
    for row in direction.classify(df).collect():
        assert row.sign == row.want, row
        assert (row.unratified_reason is not None) == (row.want is None), row


def test_caps(spark):
    df = spark.createDataFrame(
        [("r", 1, 6.0), ("r", 2, 12.0), ("r", 3, 12.0), ("r", 5, 6.0), ("s", 1, 1.0)], "provision_id string, seq int, magnitude double"
    )
    got = direction.version_drift(df).orderBy("seq").collect()
    assert [(r.seq, r.previous_seq, r.direction) for r in got] == [
        (2, 1, "loosening"), (3, 2, "neutral"), (5, 3, "tightening")
    ]


SLOTS = "p string, slot_id string, kind string, attaches_to string, determinacy string, modality string, before_status string, after_status string, after_determinacy string, after_modality string"


def test_reading_bridge(spark):
    rows = [
        ("a", "1", "condition", "duty", "specific", None, "present", "absent", None, None),
        ("a", "2", "condition", "exception", "specific", None, "present", "present", "vague", None),
        ("a", "3", "condition", "exception", "specific", None, "present", "present", None, None),
        ("a", "4", "exception", "exception", None, None, "present", "present", None, None),
        ("a", "5", "modality", "duty", None, "binding", "present", "absent", None, None),
        ("a", "6", "actor", "duty", None, None, "present", "absent", None, None),
        ("a", "7", "condition", "duty", "specific", None, "present", "uncertain", None, None),
        ("a", "8", "condition", "duty", "specific", None, "absent", "present", None, None),
        ("a", "9", "deadline", "duty", None, None, "present", "absent", None, None),
    ]
    got = {r.slot_id: (r.sign, r.observable, r.reason) for r in direction.read_change(spark.createDataFrame(rows, SLOTS)).collect()}
    assert got["1"][0] == "tightening" and got["2"][0] == "loosening"
    assert got["3"] == (None, False, "slot still present; determinacy rung not observable")
    assert got["4"] == ("neutral", True, "exception intact")
    assert got["5"][0] == "loosening"
    assert not got["6"][1] and got["7"][2] == direction.UNRESOLVED and got["8"][2] == direction.BASELINE_ABSENT
    assert got["9"][2] == "no baseline determinacy annotation"


def test_removed_part_subsumes_its_qualifiers(spark):
    rows = [
        ("a", "x", "exception", "exception", None, None, "present", "absent", None, None),
        ("a", "c", "condition", "exception", "vague", None, "present", "absent", None, None),
        ("b", "c", "condition", "exception", "vague", None, "present", "absent", None, None),
        ("c", "b", "bound", "ceiling", "specific", None, "present", "absent", None, None),
        ("c", "q", "condition", "ceiling", "vague", None, "present", "absent", None, None),
    ]
    got = {r.p: r for r in direction.measure(spark.createDataFrame(rows, SLOTS), ["p"]).collect()}
    assert (got["a"].tightening, got["a"].loosening, got["a"].unobservable) == (1, 0, 1)
    assert got["a"].unobservable_reasons == {"parent exception removed; subsumed": 1}
    assert (got["b"].tightening, got["b"].loosening) == (0, 1)
    assert (got["c"].loosening, got["c"].unobservable) == (1, 1)


def test_first_absence_and_order(spark):
    paths = {
        "lost": ["present", "present", "absent", "present"],
        "kept": ["present", "present", "present", "present"],
        "open": ["present", "uncertain", "absent", "absent"],
        "late": ["present", "absent", "uncertain", "absent"],
        "never": ["absent", "absent", "absent", "absent"],
        "short": ["present", "present"],
    }
    rows = [(k, g, s) for k, states in paths.items() for g, s in enumerate(states)]
    df = spark.createDataFrame(rows, "slot_id string, generation int, status string")
    got = {r.slot_id: (r.first_absent, r.timing, r.reappeared) for r in runs.first_absence(df, ["slot_id"], 3).collect()}
    assert got == {
        "lost": (2, "observed", True),
        "kept": (None, "not_observed_through_depth", False),
        "open": (2, "unresolved", False),
        "late": (1, "observed", False),
        "never": (None, "baseline_not_present", False),
        "short": (None, "unresolved", False),
    }
    with pytest.raises(ValueError):
        runs.first_absence(df, ["slot_id"], 0)


def test_measurement_never_imports_selection():
    root = pathlib.Path(direction.__file__).parent
    for name in ("direction", "reader", "runs"):
        tree = ast.parse((root / f"{name}.py").read_text())
        imported = {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
        assert not imported & {f"normtext.operators.{m}" for m in ("markers", "shortlist", "audits", "dossier", "axis")}
        assert "normtext.lexicon" not in imported
