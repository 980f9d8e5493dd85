"""Ordinals, running totals and lags over an ordering, without one task per group.

A plain window puts each partition key, or for an unpartitioned window the whole
table, into one task. Here the rows are range-partitioned on the complete order
(group first), so a hot group spreads over many tasks; what crosses the range
boundaries is one row per range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtext.session import stable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def _place(df: DataFrame, order: list[Column | str], parts: int | None) -> DataFrame:
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return stable(placed.withColumn("_part", F.shiftright("_row", _ROW_BITS).cast("int")))


def _before(per_part: DataFrame, value: str) -> DataFrame:
    """Exclusive running sum over the range partitions: one row per partition."""
    window = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", F.coalesce(F.sum(value).over(window), F.lit(0)).alias("_before")
    )


def with_ordinal(
    df: DataFrame, order: list[Column | str], name: str = "rank", parts: int | None = None
) -> DataFrame:
    """1-based position of each row in the global order. ``order`` must be total."""
    placed = _place(df, order, parts)
    offsets = _before(placed.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    position = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), _ROW_BITS)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + position + 1).cast("long"))
        .drop("_part", "_row", "_before")
    )


def with_running_total(
    df: DataFrame,
    order: list[Column | str],
    value: str,
    name: str = "running_total",
    parts: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over all rows strictly before each row in the global order."""
    placed = _place(df, order, parts)
    offsets = _before(placed.groupBy("_part").agg(F.sum(value).alias("_n")), "_n")
    local = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_part", "_row", "_before", "_local")
    )


def with_previous(
    df: DataFrame,
    group: list[str],
    order: list[Column | str],
    columns: list[str],
    prefix: str = "previous_",
    parts: int | None = None,
) -> DataFrame:
    """The preceding row's ``columns`` inside the same group, NULL for the first row."""
    placed = _place(df, [*group, *order], parts)
    carried = F.struct(*group, *columns)
    edge = (
        placed.groupBy("_part")
        .agg(F.max_by(carried, "_row").alias("_last"))
        .select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))
    )
    local = Window.partitionBy("_part").orderBy("_row")
    joined = placed.withColumn("_prev", F.lag(carried).over(local)).join(
        F.broadcast(edge), "_part", "left"
    )
    previous = F.coalesce("_prev", "_edge")
    same = F.lit(True)
    for key in group:
        same = same & previous[key].eqNullSafe(F.col(key))
    return joined.select(
        *df.columns,
        *[F.when(same, previous[c]).alias(prefix + c) for c in columns],
    )
