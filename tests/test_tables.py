"""Sets of tables become current all at once: writers lost at any step, two writers at a time, folders left behind."""

import pytest

from normtext.session import shared_path
from normtext.sources import tables


class Lost(BaseException):
    """A driver that is gone: nothing of it runs any more."""


def rows(spark, path):
    return sorted(r.id for r in tables.read_table(spark, path, "t").collect())


def steps(monkeypatch):
    """Counts the writer's accesses to the store and its writes; ``lost_at`` names the one before which it is lost."""
    seen = {"n": 0, "lost_at": None}

    def counted(function):
        def run(*args, **kwargs):
            if seen["lost_at"] is not None and seen["n"] >= seen["lost_at"]:
                raise Lost
            seen["n"] += 1
            return function(*args, **kwargs)

        return run

    for name in ("create", "delete", "listed", "read", "exists"):
        monkeypatch.setattr(tables._Store, name, counted(getattr(tables._Store, name)))
    return seen


def test_a_writer_lost_at_any_step(spark, monkeypatch):
    path = shared_path(spark, "kills")
    tables.write_tables({"t": spark.range(2)}, path)
    tables.write_tables({"t": spark.range(3)}, path)
    seen = steps(monkeypatch)
    tables.write_tables({"t": spark.range(4)}, path)
    total, size, changed = seen["n"], 4, 0
    assert total > 8
    for step in range(total + 1):
        seen.update(n=0, lost_at=step)
        try:
            tables.write_tables({"t": spark.range(size + 1)}, path)
        except Lost:
            pass
        seen.update(n=0, lost_at=None)
        now = len(rows(spark, path))
        assert now in (size, size + 1)  # the old set or the new one, never none and never half of one
        changed += now == size + 1
        size = now
    assert 0 < changed < total + 1


def test_a_pointer_without_contents(spark):
    """A writer lost between making its pointer and naming its folder leaves the old set current; the next one goes on."""
    path = shared_path(spark, "empty")
    tables.write_tables({"t": spark.range(2)}, path)
    tables._Store(spark, path).create("pointers/000000000002", "abc")
    assert rows(spark, path) == [0, 1]
    tables.write_tables({"t": spark.range(3)}, path)
    assert rows(spark, path) == [0, 1, 2]


def test_the_second_of_two_writers_fails(spark):
    path = shared_path(spark, "race")
    tables.write_tables({"t": spark.range(1)}, path)

    def slow(folder):
        tables.write_tables({"t": spark.range(5)}, path)  # another writer is faster
        spark.range(9).write.parquet(f"{folder}/t")

    with pytest.raises(tables.ConcurrentWrite):
        tables.commit(spark, path, slow)
    assert rows(spark, path) == [0, 1, 2, 3, 4]
    assert len(tables._Store(spark, path).listed("versions")) == 2  # the loser's folder is gone


def test_failed_builds_and_old_sets_go(spark):
    path = shared_path(spark, "old")
    for n in range(1, 6):
        tables.write_tables({"t": spark.range(n), "u": spark.range(n)}, path)
    with pytest.raises(Exception):
        tables.write_tables({"t": spark.range(9), "u": spark.range(2).selectExpr("raise_error('no') AS id")}, path)
    store = tables._Store(spark, path)
    assert rows(spark, path) == [0, 1, 2, 3, 4] and len(store.listed("versions")) == tables.KEPT
    spark.range(1).write.parquet(f"{path}/versions/left/t")  # of a writer that was lost
    tables.write_tables({"t": spark.range(1)}, path)
    assert "left" in store.listed("versions")
    tables.commit(spark, path, lambda folder: spark.range(2).write.parquet(f"{folder}/t"), abandoned_after=-1)
    assert "left" not in store.listed("versions") and rows(spark, path) == [0, 1]


def test_one_set_for_all_views_and_exports(spark, tmp_path):
    path = shared_path(spark, "views")
    with pytest.raises(FileNotFoundError, match="t, u"):
        tables.open_tables(spark, path, ("t", "u"))
    tables.write_tables({"t": spark.range(3), "u": spark.range(4)}, path)
    tables.open_tables(spark, path, ("t", "u"))
    tables.write_tables({"t": spark.range(30), "u": spark.range(40)}, path)
    assert spark.sql("SELECT (SELECT count(*) FROM t), (SELECT count(*) FROM u)").first()[:] == (3, 4)
    out = str(tmp_path / "csv")
    first = tables.export_csv(spark.createDataFrame([("a;b", 'q"x')], "k string, v string"), out)
    assert [tuple(r) for r in spark.read.csv(first, header=True, sep=";", escape='"').collect()] == [("a;b", 'q"x')]
    with pytest.raises(Exception):
        tables.export_csv(spark.range(2).selectExpr("raise_error('no') AS x"), out)
    assert tables.current(spark, out) == first
