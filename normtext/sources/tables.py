"""Writing, registering and exporting tables.

A set of tables is written to a folder of its own that never changes afterwards, and becomes the
current one by a pointer: a numbered file that names the folder, made without overwriting. Readers
take the pointer with the highest number whose contents are whole, so they see the old set or
the new one at any moment, on stores whose renames are copies too. Of two writers that
started from the same set the one whose pointer comes second fails and removes its folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS, POINTERS = "versions", "pointers"
KEPT = 2  # current and earlier sets that stay readable
ABANDONED_AFTER = 7 * 24 * 3600  # seconds after which a folder that no pointer names is taken for a lost writer's


class ConcurrentWrite(RuntimeError):
    """Another writer made its tables the current ones first."""


class _Store:
    """The files under one root, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def listed(self, folder: str) -> dict[str, float]:
        """Names in a folder, and when each was last changed."""
        if not self.exists(folder):
            return {}
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self._files.listStatus(self._path(folder))}

    def create(self, name: str, contents: str) -> None:
        """A new file; an error if there is one of that name."""
        out = self._files.create(self._path(name), False)
        try:
            out.write(bytearray(contents.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self._files.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)


def _pointers(store: _Store) -> list[tuple[int, str | None]]:
    """Number and folder of every pointer, latest first; no folder where a writer was lost before it named one."""
    found = []
    for name in store.listed(POINTERS):
        if name.isdigit():
            contents = store.read(f"{POINTERS}/{name}")
            found.append((int(name), contents.strip() if contents.endswith("\n") else None))
    return sorted(found, reverse=True)


def _expire(store: _Store, kept: int, abandoned_after: float) -> None:
    """Removes sets older than the ``kept`` latest, and folders that no pointer has named for a long time."""
    named = [(number, folder) for number, folder in _pointers(store) if folder]
    for number, folder in named[kept:]:
        store.delete(f"{POINTERS}/{number:012d}")  # first, so that no reader is sent to a folder that goes
        store.delete(f"{VERSIONS}/{folder}")
    current = {folder for _, folder in named}
    for folder, changed in store.listed(VERSIONS).items():
        if folder not in current and time.time() - changed > abandoned_after:
            store.delete(f"{VERSIONS}/{folder}")


def commit(
    spark: SparkSession, path: str, write: Callable[[str], None], kept: int = KEPT, abandoned_after: float = ABANDONED_AFTER
) -> str:
    """Lets ``write`` fill a new folder and makes it the current one under ``path``; returns the folder.

    If anything fails, the folder goes and what was current stays so.
    """
    store = _Store(spark, path)
    last = max((number for number, _ in _pointers(store)), default=0)
    folder = uuid.uuid4().hex
    try:
        write(f"{path}/{VERSIONS}/{folder}")
        try:
            store.create(f"{POINTERS}/{last + 1:012d}", folder + "\n")
        except Exception as error:
            if store.exists(f"{POINTERS}/{last + 1:012d}"):
                raise ConcurrentWrite(f"another writer changed {path} meanwhile") from error
            raise
    except Exception:
        store.delete(f"{VERSIONS}/{folder}")
        raise
    _expire(store, kept, abandoned_after)
    return f"{path}/{VERSIONS}/{folder}"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current set under ``path``."""
    folder = next((folder for _, folder in _pointers(_Store(spark, path)) if folder), None)
    if folder is None:
        raise FileNotFoundError(f"no tables under {path}")
    return f"{path}/{VERSIONS}/{folder}"


def write_tables(tables: Mapping[str, DataFrame], path: str) -> str:
    """Writes all tables and makes them the current set under ``path``, all at once or not at all."""

    def write(folder: str) -> None:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")

    commit(next(iter(tables.values())).sparkSession, path, write)
    return path


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the set that is current now."""
    return spark.read.parquet(f"{current(spark, path)}/{name}")


def open_tables(spark: SparkSession, path: str, names: tuple[str, ...] = ("provisions", "candidates", "marker_hits", "markers")) -> None:
    """Registers the tables of one set as views for SQL; a missing one is named."""
    try:
        folder = current(spark, path)
    except FileNotFoundError:
        raise FileNotFoundError(f"tables missing under {path}: {', '.join(names)}") from None
    store = _Store(spark, folder)
    missing = [n for n in names if not store.exists(n)]
    if missing:
        raise FileNotFoundError(f"tables missing under {path}: {', '.join(missing)}")
    for name in names:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)


def export_csv(df: DataFrame, path: str) -> str:
    """The rows as ``;``-separated files with a header; returns their folder. An earlier export stays until this one is whole."""

    def write(folder: str) -> None:
        df.write.option("header", True).option("sep", ";").option("escape", '"').csv(folder)

    return commit(df.sparkSession, path, write)


def export_run(tables: Mapping[str, DataFrame], run_id: str, path: str) -> str:
    """One run's rows of every table, as Parquet; returns the folder that holds one folder for each table."""

    def write(folder: str) -> None:
        for name, df in tables.items():
            df.where(F.col("run_id") == run_id).write.parquet(f"{folder}/{name}")

    return commit(next(iter(tables.values())).sparkSession, path, write)
