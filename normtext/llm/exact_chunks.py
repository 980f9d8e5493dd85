"""Exact deduplication over content-defined chunk recipes.

A text without its white space is cut where a rolling hash of its own bytes says so, so
equal stretches give equal chunks wherever they stand. Each distinct chunk is moved once
(copies inside a task are dropped before the shuffle) to verify that no two contents
share a fingerprint; a fingerprint that does stand for several contents gets an ordinal
per content. A document is then the ordered list of its chunk identifiers: a few dozen
bytes for a text of many thousands, and equal lists are equal texts.

Defined cases: a null text is empty; empty texts are equal to each other; of equal texts
the one with the most code points in the original stays, then the smallest ``doc_id``
(null last), then any one of the repeated rows: exactly one row of a group is kept. An
empty table gives an empty table. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normtext.llm.buffers import BYTE_VALUE, IS_SPACE, binary_array, pieces, text_bytes
from normtext.llm.storage import UID, mapped, with_uid, without, written

CUT_BITS = 10  # a chunk has about 2**CUT_BITS bytes
WINDOW = 32  # bytes that decide about a cut
MOST = 8 << 10  # a longer stretch without a cut is cut after so many bytes
KEY_BYTES = 16

_GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)


def fingerprint(content: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(content)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all chunks of all documents, and the number of chunks before each document.

    A cut stands after each byte at which the hash of the last ``WINDOW`` bytes of the
    same document has ``CUT_BITS`` zero bits.
    """
    rolling = _GEAR[data]
    width = 1
    while width < WINDOW:
        wider = rolling.copy()
        wider[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = wider, 2 * width
    cuts = np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1
    document = np.searchsorted(offsets, cuts, side="left") - 1
    cuts = cuts[cuts - offsets[document] >= WINDOW]
    edges = np.union1d(cuts, offsets)
    gaps = np.diff(edges)
    if len(gaps) and gaps.max() > MOST:
        parts = -(-gaps // MOST)
        start = np.repeat(edges[:-1], parts)
        nth = np.arange(len(start)) - np.repeat(np.cumsum(parts) - parts, parts)
        edges = np.append(start + nth * MOST, edges[-1])
    return edges, np.searchsorted(edges, offsets)


def _squeezed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    keep = ~IS_SPACE[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return data[keep], before[offsets]


def _chunks(hash_of: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = _squeezed(piece.column("text"))
            edges, _ = cut_points(data, offsets)
            if len(edges) < 2:
                continue
            view = memoryview(np.ascontiguousarray(data))
            fresh: dict[tuple[bytes, bytes], None] = {}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                content = view[a:b]
                fresh.setdefault((hash_of(content), bytes(content)))
            yield pa.record_batch({
                "key": pa.array([k for k, _ in fresh], pa.binary()),
                "content": pa.array([c for _, c in fresh], pa.binary()),
            })


def _recipes(hash_of: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = _squeezed(piece.column("text"))
            edges, first = cut_points(data, offsets)
            view = memoryview(np.ascontiguousarray(data))
            keys = b"".join(hash_of(view[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))
            size = len(keys) // max(1, len(edges) - 1)
            spans = offsets.tolist()
            yield pa.record_batch({
                UID: piece.column(UID),
                "doc_id": piece.column("doc_id"),
                "n_points": pc.fill_null(pc.utf8_length(piece.column("text")), 0).cast(pa.int64()),
                "text_sha256": pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(spans, spans[1:])], pa.string()),
                "recipe": binary_array(np.frombuffer(keys, np.uint8), first * size),
            })


def _occurrences(hash_of: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = _squeezed(piece.column("text"))
            edges, first = cut_points(data, offsets)
            if len(edges) < 2:
                continue
            view = memoryview(np.ascontiguousarray(data))
            uid = np.repeat(piece.column(UID).to_numpy(), np.diff(first))
            yield pa.record_batch({
                UID: pa.array(uid, pa.int64()),
                "place": pa.array(np.arange(len(edges) - 1) - np.repeat(first[:-1], np.diff(first)), pa.int64()),
                "key": pa.array([hash_of(view[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()),
                "content": binary_array(data, edges),
            })


def shared_fingerprints(docs: DataFrame, hash_of: Callable = fingerprint) -> DataFrame:
    """``key, content, ordinal`` of every fingerprint that stands for more than one content.

    Each distinct chunk moves once, and none of its copies inside a task moves at all.
    """
    contents = (
        mapped(docs.select("text"), lambda batches: _chunks(hash_of, batches), "key binary, content binary")
        .groupBy("key", "content")
        .agg(F.count("*").alias("copies"))
    )
    several = contents.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1")
    ordered = Window.partitionBy("key").orderBy("content")
    return contents.join(several, "key", "left_semi").select(
        "key", "content", F.row_number().over(ordered).cast("long").alias("ordinal")
    )


def chunk_recipes(docs: DataFrame, hash_of: Callable = fingerprint) -> DataFrame:
    """``_uid, doc_id, n_points, text_sha256, recipe, ordinals`` per row.

    Texts are equal where ``recipe`` (the fingerprints in order) and ``ordinals`` (which
    content each shared fingerprint stands for, mostly empty) are both equal.
    """
    rows = with_uid(docs.select("doc_id", "text"))
    recipes = written(
        mapped(
            rows, lambda batches: _recipes(hash_of, batches),
            f"{UID} long, doc_id long, n_points long, text_sha256 string, recipe binary",
        )
    )
    clashes = written(shared_fingerprints(docs, hash_of))
    if clashes.isEmpty():
        return recipes.withColumn("ordinals", F.lit(""))
    # Some fingerprint stands for several contents: add the ordinal of the content to each chunk that has it.
    numbered = written(
        mapped(
            rows, lambda batches: _occurrences(hash_of, batches), f"{UID} long, place long, key binary, content binary"
        )
        .join(clashes, ["key", "content"], "left")
        .select(UID, "place", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
        .where("ordinal > 0")
        .groupBy(UID)
        .agg(F.array_sort(F.collect_list(F.struct("place", "ordinal"))).alias("marks"))
        .select(UID, F.concat_ws(",", F.transform("marks", lambda x: F.concat_ws(":", x["place"], x["ordinal"]))).alias("ordinals"))
    )
    return recipes.join(numbered, UID, "left").withColumn("ordinals", F.coalesce("ordinals", F.lit("")))


def exact_groups(docs: DataFrame, hash_of: Callable = fingerprint) -> DataFrame:
    """``exact_duplicates`` with the row number of each row of ``docs``."""
    recipes = chunk_recipes(docs, hash_of)
    rank = F.struct(
        (-F.col("n_points")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(UID).alias("uid")
    )
    groups = recipes.groupBy("recipe", "ordinals").agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    return recipes.join(groups, ["recipe", "ordinals"]).select(
        UID,
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col(UID) == F.col("best.uid")).alias("kept"),
        "text_sha256",
        F.length("recipe").cast("long").alias("n_recipe_bytes"),
    )


def exact_duplicates(docs: DataFrame, hash_of: Callable = fingerprint) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_recipe_bytes`` per row, dropped ones too.

    ``docs`` has ``doc_id`` and ``text`` and may be read several times: it must give its rows alike each time.
    """
    return exact_groups(docs, hash_of).drop(UID)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts."""
    return without(docs, written(exact_groups(docs).where("NOT kept").select(UID)))
