"""Packing into optimal length buckets with token-budget batches.

Documents longer than the context are cut into pieces of it. The global histogram of
piece lengths (at most one row per possible length) goes to a dynamic program that
chooses the bucket boundaries with the least padding of all choices of that many
boundaries. Inside a bucket, pieces stand in a seeded order; a batch takes as many as the
token budget holds at the bucket's length.

Positions inside a bucket come from ordinals over range partitions, so a bucket with a
third of all rows spreads over many tasks.

Defined cases: a document without tokens (null, empty, only white space) has nothing to
pack and gives one row with ``n_tokens`` 0 and no bucket or batch; repeated rows and null
ids are packed like others; an empty table gives an empty table; a budget below a
bucket's length makes batches of one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.functions.ordered import with_ordinal
from normtext.llm.storage import UID, with_uid, written

CONTEXT = 2048
BUCKETS = 16
BUDGET = 65_536
SEED = 7

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count(text: str = "text") -> Column:
    """Words and marks of a text: the default measure of length."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Buckets:
    lengths: list[int]  # the longest piece of each bucket, ascending
    rows: list[int]  # pieces in each bucket
    padding: int  # tokens of padding in all


def best_buckets(histogram: dict[int, int], most: int) -> Buckets:
    """The boundaries with the least total padding, ``most`` at most, by dynamic programming.

    cost[j] after k rounds is the least padding of the lengths up to the j-th in k buckets;
    the last bucket then starts after some i < j and pads all its pieces to length j.
    """
    lengths = np.array(sorted(histogram), np.int64)
    n = len(lengths)
    if not n:
        return Buckets([], [], 0)
    times = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    rows = np.concatenate(([0], np.cumsum(times)))
    tokens = np.concatenate(([0], np.cumsum(times * lengths)))
    far = np.iinfo(np.int64).max // 4
    cost = np.full(n + 1, far, np.int64)
    cost[0] = 0
    rounds = min(most, n)
    origin = np.zeros((rounds + 1, n + 1), np.int64)
    for k in range(1, rounds + 1):
        nearer = np.full(n + 1, far, np.int64)
        for j in range(k, n + 1):
            total = cost[k - 1 : j] - lengths[j - 1] * rows[k - 1 : j] + tokens[k - 1 : j]
            i = int(np.argmin(total))
            nearer[j] = total[i] + lengths[j - 1] * rows[j] - tokens[j]
            origin[k, j] = i + k - 1
        cost = nearer
    ends, j = [], n
    for k in range(rounds, 0, -1):
        ends.append(j)
        j = int(origin[k, j])
    ends = ends[::-1]
    return Buckets(
        [int(lengths[e - 1]) for e in ends],
        np.diff(rows[[0, *ends]]).tolist(),
        int(cost[n]),
    )


def cut_pieces(docs: DataFrame, tokens: Column | None = None, context: int = CONTEXT) -> DataFrame:
    """``doc_id, piece, start_token, n_tokens`` and a row number: each document in pieces of the context at most."""
    count = token_count() if tokens is None else tokens
    counted = with_uid(docs.select("doc_id", count.alias("total")))
    pieces = F.greatest(F.ceil(F.col("total") / context), F.lit(1))
    cut = counted.select(UID, "doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)).alias("piece"))
    start = F.col("piece") * context
    return cut.select(
        UID, "doc_id", "piece", start.alias("start_token"), F.least(F.col("total") - start, F.lit(context)).alias("n_tokens")
    )


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    context: int = CONTEXT,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, piece, start_token, n_tokens, bucket, bucket_length, batch_id, slot`` per piece.

    ``tokens`` measures a document (words and marks if not given). ``batch_id`` counts over
    all buckets; ``slot`` is the place in the batch.
    """
    pieces = written(cut_pieces(docs, tokens, context))
    counted = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("times"))
    chosen = best_buckets({r["n_tokens"]: r["times"] for r in counted.collect()}, buckets)  # at most ``context`` rows
    names = ["doc_id", "piece", "start_token", "n_tokens"]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "long"), ("batch_id", "long"), ("slot", "long"))]
    empty = pieces.where("n_tokens = 0").select(*names, *nothing)
    if not chosen.lengths:
        return empty
    each = [max(1, budget // length) for length in chosen.lengths]
    batches = [-(-rows // size) for rows, size in zip(chosen.rows, each)]
    before_rows = np.cumsum([0, *chosen.rows[:-1]]).tolist()
    before_batches = np.cumsum([0, *batches[:-1]]).tolist()

    def of_bucket(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket"))

    bucket = F.lit(0)
    for length in chosen.lengths[:-1]:
        bucket = bucket + (F.col("n_tokens") > length).cast("int")
    placed = pieces.where("n_tokens > 0").withColumn("bucket", bucket).withColumn(
        "_order", F.xxhash64(F.lit(seed), "doc_id", "piece")
    )
    ordered = with_ordinal(placed, ["bucket", "_order", "doc_id", "piece", UID], "_place")
    at = F.col("_place") - 1 - of_bucket(before_rows)
    size = of_bucket(each)
    return ordered.select(
        *names,
        "bucket",
        of_bucket(chosen.lengths).alias("bucket_length"),
        (of_bucket(before_batches) + F.floor(at / size)).alias("batch_id"),
        (at % size).alias("slot"),
    ).union(empty)
