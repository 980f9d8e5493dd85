import pytest

from compare import compare, connect
from normtext.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLED = [
    "shortlist", "marker_frequency", "retrieval_chunks", "hit_length_correlation", "change_signs", "version_drift",
    "drift_trajectory", "first_absence", "ledger_settlement", "requirement_drift", "debate_direction", "paired_lengths",
    "run_audit", "html_provisions",
]


def test_every_query_has_checking_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_sql(spark, name):
    note, _, ok = compare(spark, connect(SF), SF, name, catalog.queries()[name], catalog.oracle_sql()[name])
    assert ok, note
