"""Tables between the steps of an operator, in the shared folder of the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import returned

from normtext.session import stable

UID = "_uid"


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once and read back from the shared folder."""
    return stable(df)


def with_uid(df: DataFrame) -> DataFrame:
    """A number for each row, so that repeated rows stay apart. Fixed only once the rows are written."""
    return df.withColumn(UID, F.monotonically_increasing_id())


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` as they are, less the rows whose numbers (``with_uid`` over the same stored rows) are in ``dropped``.

    The row travels as one struct, so no column of it can clash with the number.
    """
    numbered = docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias(UID))
    return numbered.join(dropped.select(UID), UID, "left_anti").select("_row.*")


BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a hint to broadcast if its counted ``rows`` of a few numbers each are at most ``most``."""
    return F.broadcast(df) if rows <= most else df


ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = "8m"


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of a few megabytes, whose workers give freed memory back.

    Spark's own bound of 64 MB stands several times beside each core, in the JVM's buffers and in the
    worker. The session's setting is lowered only where nobody has set it.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        conf.set(ARROW_BYTES, BATCH_BYTES)
    return df.mapInArrow(lambda batches: returned(function(batches)), schema)
