"""Continuous intake: new documents from a file source, each stored once.

The store is divided by a hash of the key. Beside it lies its filter, a Bloom filter kept as rows: for each
division and word the bits that stored keys have set in it, three in one word of 64 for each key. A
batch looks up its own words; only keys whose bits are all set can be stored already, and only for those are
stored keys read, from their divisions alone. A batch of new keys reads no stored row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 256
WORDS = 1 << 22  # words of a division's filter; only those with a bit are stored


def filter_path(store: str) -> str:
    """The filter lies beside the store, so that reading the store's folder gives documents only."""
    return store.rstrip("/") + ".filter"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _bits(key: str) -> Column:
    h = F.xxhash64(F.col(key), F.lit("bits"))
    places = [F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int") for k in range(3)]
    one, two, three = (F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places)
    return one.bitwiseOR(two).bitwiseOR(three)


def _placed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({
        "bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"),
        "_word": F.pmod(F.xxhash64(F.col(key), F.lit("word")), F.lit(WORDS)).cast("int"),
        "_bits": _bits(key),
    })


def _elsewhere(stream: str, batch_id: int) -> Column:
    """Rows that another batch has written: those of this one, if there are any, are of an attempt that failed."""
    return (F.col("stream") != stream) | (F.col("batch") != batch_id)


def possibly_stored(placed: DataFrame, store: str, stream: str, batch_id: int) -> DataFrame | None:
    """The rows whose bits are all set in the filter; None if there is no filter yet."""
    spark = placed.sparkSession
    if not _exists(spark, filter_path(store)):
        return None
    words = placed.select("bucket", "_word").distinct()
    fields = "_word int, mask long, stream string, batch long, bucket int"
    touched = [r["bucket"] for r in words.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    known = spark.read.schema(fields).parquet(filter_path(store)).where(F.col("bucket").isin(touched) & _elsewhere(stream, batch_id))
    masks = known.join(words, ["bucket", "_word"], "left_semi").groupBy("bucket", "_word").agg(F.bit_or("mask").alias("mask"))
    return placed.join(masks, ["bucket", "_word"]).where(F.col("mask").bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("mask")


def stored_keys(spark: SparkSession, store: str, key: str, kind: str, buckets: list[int], stream: str, batch_id: int) -> DataFrame:
    """The keys of some divisions of the store."""
    fields = f"{key} {kind}, stream string, batch long, bucket int"
    return spark.read.schema(fields).parquet(store).where(F.col("bucket").isin(buckets) & _elsewhere(stream, batch_id)).select(key)


def stream_new_documents(incoming: DataFrame, store: str, checkpoint: str, key: str = "document_snapshot_id") -> StreamingQuery:
    """Appends every snapshot not yet in ``store``, and ends when the input is used up.

    A batch may be replayed after a failure: its rows and its part of the filter are
    written under its own stream and batch folder, which only a replay overwrites, so
    nothing is stored twice. The filter is written first: bits without a row only cost a look into the store. Stored
    keys and bits are read without that folder for the same reason. Another checkpoint is another stream and
    never touches this one's folders. Rows without a key are stored as they come, once a batch.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = _placed(batch.dropDuplicates([key]), key)
        possible = possibly_stored(fresh, store, stream, batch_id)
        buckets = [] if possible is None else [r["bucket"] for r in possible.select("bucket").distinct().collect()]
        if buckets and _exists(spark, store):
            known = stored_keys(spark, store, key, dict(fresh.dtypes)[key], buckets, stream, batch_id)
            fresh = fresh.join(known, key, "left_anti")
        folder = f"stream={stream}/batch={batch_id}"
        bits = fresh.where(F.col(key).isNotNull()).groupBy("bucket", "_word").agg(F.bit_or("_bits").alias("mask"))
        bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{filter_path(store)}/{folder}")
        rows = fresh.drop("_word", "_bits")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{folder}")

    return (
        incoming.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
