"""The document store: replays, late and repeated snapshots, and what a batch reads of it."""

import hashlib
import shutil

import pytest

from normtext.plans import intake as intake_plans
from normtext.streaming import ingest

SCHEMA = "document_snapshot_id string, body string"


@pytest.fixture
def intake(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def add(*keys):
        spark.createDataFrame([(k, "x") for k in keys], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(place="cp"):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.stream_new_documents(stream, store, str(tmp_path / place)).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(store).select("document_snapshot_id").collect())

    return add, run, tmp_path


def test_a_batch_of_new_keys_reads_no_stored_row(intake, monkeypatch):
    add, run, _ = intake
    read = []
    plain = ingest.stored_keys
    monkeypatch.setattr(ingest, "stored_keys", lambda *a: read.append(a[4]) or plain(*a))
    add(*[f"a{i}" for i in range(200)])
    assert len(run()) == 200 and not read
    add(*[f"b{i}" for i in range(200)])
    assert len(run()) == 400 and not read
    add("b7", "b7", "c0", "a3")  # late and repeated ones: two keys are looked up, in their divisions
    assert len(run()) == 401 and len(read) == 1 and 1 <= len(read[0]) <= 2


def test_replays_and_other_streams_add_nothing_twice(intake, spark):
    add, run, folder = intake
    add("a", "a", "b")
    assert run() == ["a", "b"]
    # The last batch is lost from the checkpoint after its rows were written: it runs again.
    shutil.rmtree(folder / "cp" / "commits")
    assert run() == ["a", "b"]
    add("b", "c")
    assert run() == ["a", "b", "c"]
    assert run("other") == ["a", "b", "c"]
    add("d")
    assert run("other") == ["a", "b", "c", "d"] and run() == ["a", "b", "c", "d"]


def test_a_writer_lost_between_filter_and_rows(intake, spark):
    add, run, folder = intake
    add("a")
    run()
    shutil.rmtree(folder / "store")  # the filter knows the key, the store has lost the row
    shutil.rmtree(folder / "cp" / "commits")
    assert run() == ["a"]


def test_a_full_filter_only_costs_reading(intake, monkeypatch):
    """With one word a division every key may be stored: the store decides."""
    monkeypatch.setattr(ingest, "WORDS", 1)
    monkeypatch.setattr(ingest, "BUCKETS", 2)
    add, run, _ = intake
    add(*[f"a{i}" for i in range(300)])
    add(*[f"a{i}" for i in range(150, 450)])
    run()
    add(*[f"a{i}" for i in range(400, 500)])
    assert len(run()) == 500


def test_streamed_documents_are_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(1, 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "parts").glob("part-*.parquet")), tmp_path / "one" / "documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    expected = sorted((f"doc-{i}", hashlib.sha256(text.encode()).hexdigest()) for i, text in rows)
    for folder, wanted in (("one", expected), ("many", expected), ("none", [])):
        assert sorted(map(tuple, intake_plans.streamed_documents(spark, str(tmp_path / folder)).collect())) == wanted
