"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "normtext", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the submitter's own settings win: only ``conf`` and the adaptive
    switches are set here, never memory or parallelism.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on one machine that names none, as in a trial, gets a temporary folder. On a
    cluster that is an error: a folder of one machine would not outlive it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="normtext-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends; until then lazy results may read it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stable(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back from there.

    Needed wherever later steps rely on values that a recomputation could change
    (row positions after range partitioning), and to cut lineage between rounds of
    an iteration. A written table also drops the constraints the optimizer would
    otherwise carry from round to round.
    """
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    _delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the session setting ``spark.normtext.scanTasks`` says; as read where it is unset.

    A small file is one split and keeps one core busy; a benchmark over small files sets the number.
    """
    tasks = df.sparkSession.conf.get("spark.normtext.scanTasks", None)
    return df.repartition(int(tasks)) if tasks else df
