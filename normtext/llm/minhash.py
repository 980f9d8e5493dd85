"""Near duplicates by circulant MinHash, banding and exact verification.

A document is its set of distinct word shingles. Two permutations of the 2**32 shingle
places make the whole signature: the first scatters the places once, the second is
applied again and again, shifted by one place more each time (wrapping round), and each
shift gives the smallest image of the set as one coordinate. Runs of coordinates are
bands; documents that share a band are candidates. Every candidate link is confirmed on
the full sets of 64-bit shingle hashes before it counts.

The work follows the number of different sets, not of pairs. Documents with the same set
are one class from the start. Inside a bucket, every class is compared with the most
central one; only classes that are then still in different components go on. Of those, a
class whose own shingles (found in none of the others) leave too few to share can have no
link and goes, and so does a pair whose parity sketches differ in too many bits: both
bounds are exact. What is left is compared. So a group of thousands of near copies costs
one comparison per member and band, and no candidate link between different components
goes unseen. The texts of candidates are picked out once.

With the default 32 bands of 6, a pair of similarity 0.8 is a candidate with probability
0.99994, one of 0.85 with 0.9999997, one of 0.3 with 0.02.

Defined cases: a null or blank text has no set, is linked with nothing and stays; fewer
words than a shingle takes are one shingle, the whole sequence; links join rows, so
repeated rows are one group of which one row is kept; a null ``doc_id`` sorts last and is
the component's id only if all its ids are null. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import IS_SPACE, LOWER, mix, pieces, span_hashes, text_bytes, window_hashes, words_of
from normtext.llm.components import components
from normtext.llm.storage import UID, mapped, small, with_uid, without, written

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 6
BLOCK = 1 << 16  # shingles hashed at a time
SKETCH = 2048  # bits
MOST_IDS = 1_000_000  # ids of 8 bytes that may be broadcast
KNOWN = 1 << 21  # shingle hashes kept for the next pairs while confirming

_FIRST = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))  # odd multipliers of the two permutations
_SECOND = (np.uint32(0x9E3779B1), np.uint32(0x27D4EB2F))


def _permuted(x: np.ndarray, factors: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x *= factors[0]
    x ^= x >> np.uint32(15)
    x *= factors[1]
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, in a row, and where each set begins."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    begin, end, first = words_of(IS_SPACE[data], offsets)
    words = span_hashes(data, begin, end)
    whole = window_hashes(words, width)
    sets, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= width:
            found = np.sort(whole[a : b - width + 1])
            found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            found = mix(window_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            continue
        sizes[i] = len(found)
        sets.append(found)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` coordinates per non-empty set: the smallest image under each shift of the second permutation."""
    places = _permuted((sets >> np.uint64(32)).astype(np.uint32), _FIRST)
    out = np.full((len(starts), count), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(places), BLOCK):
        part = places[low : low + BLOCK]
        one = int(np.searchsorted(starts, low, side="right")) - 1
        end = int(np.searchsorted(starts, low + len(part), side="left"))
        edges = np.maximum(starts[one:end] - low, 0)
        for shift in range(count):
            images = _permuted(part + np.uint32(shift), _SECOND)
            column = out[one:end, shift]
            np.minimum(column, np.minimum.reduceat(images, edges), out=column)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys + signature[:, k::rows][:, :bands].astype(np.uint64))
    return keys


def _signed(width: int, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets, starts = shingle_sets(piece.column("text"), width)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            keys = band_keys(signatures(sets, starts[full], bands * rows), bands, rows).view(np.int64)
            bytes_of = memoryview(sets).cast("B") if len(sets) else memoryview(b"")
            digests: list[bytes | None] = [None] * len(sizes)
            for i in full.tolist():
                digests[i] = hashlib.sha256(bytes_of[8 * starts[i] : 8 * starts[i + 1]]).digest()
            at = np.zeros(len(sizes) + 1, np.int32)
            at[1:][full] = bands
            yield pa.record_batch({
                UID: piece.column(UID),
                "doc_id": piece.column("doc_id"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(keys.ravel(), pa.int64())),
            })


def signed(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, digest of the set and band keys per row."""
    return mapped(
        with_uid(docs.select("doc_id", "text")), lambda batches: _signed(width, bands, rows, batches),
        f"{UID} long, doc_id long, n_shingles long, digest binary, bands array<long>",
    )


def _confirmed(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}
    held = 0

    def set_of(node: int, text: str | None) -> np.ndarray:
        nonlocal held
        if node not in known:
            if held > KNOWN:
                known.clear()
                held = 0
            known[node] = shingle_sets(pa.array([text], pa.string()), width)[0]
            held += len(known[node])
        return known[node]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            left = set_of(a[i], batch.column("text_a")[i].as_py())
            right = set_of(b[i], batch.column("text_b")[i].as_py())
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep[i] = both > 0 and 100 * both >= percent * (len(left) + len(right) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def confirmed_links(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough. ``texts`` has ``node, text``."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return mapped(both, lambda batches: _confirmed(width, percent, batches), "a long, b long")


def _similar_size(x: str, y: str, percent: int):
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, node, n, root`` of the buckets whose members lie in several components."""
    rooted = members.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rooted.join(mixed.select("bucket"), "bucket", "left_semi")


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets, starts = shingle_sets(piece.column("text"), width)
            node = np.repeat(piece.column("node").to_numpy(), np.diff(starts))
            yield pa.record_batch({"node": pa.array(node, pa.int64()), "shingle": pa.array(sets.view(np.int64))})


def _sketched(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets, starts = shingle_sets(piece.column("text"), width)
            document = np.repeat(np.arange(piece.num_rows), np.diff(starts))
            place = document * SKETCH + (sets & np.uint64(SKETCH - 1)).astype(np.int64)
            odd = (np.bincount(place, minlength=piece.num_rows * SKETCH) & 1).astype(np.uint8)
            words = np.packbits(odd).view(np.int64)
            at = np.arange(0, len(words) + 1, SKETCH // 64, dtype=np.int32)
            yield pa.record_batch({"node": piece.column("node"), "sketch": pa.ListArray.from_arrays(pa.array(at), pa.array(words))})


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """``node, sketch``: the parity of the set's shingles in each of ``SKETCH`` places.

    Two sketches differ in at most as many bits as the sets differ in shingles, so too
    many bits prove that a pair is no link, without its texts.
    """
    return mapped(texts.select("node", "text"), lambda batches: _sketched(width, batches), "node long, sketch array<long>")


def _unshared(texts: DataFrame, width: int) -> DataFrame:
    """``node, u``: how many shingles of a text no other of the given texts has."""
    shingles = mapped(texts.select("node", "text"), lambda batches: _sets(width, batches), "node long, shingle long")
    once = shingles.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("node").alias("node")).where("texts = 1")
    return once.groupBy("node").agg(F.count("*").alias("u"))


def _can_link(apart: DataFrame, percent: int) -> DataFrame:
    """``apart`` with ``s``, the shingles that can be shared, less the members that fit no other of their bucket.

    An overlap of at most s with a set of m gives a similarity of at most s / (n + m - s),
    so m must be at most s * (100 + percent) / percent - n. Copies that strayed too far from
    all others hold shingles of their own, and go here, before any pair is made.
    """
    shared = apart.withColumn("s", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    least = shared.groupBy("bucket").agg(F.min("n").alias("least"))
    fit = shared.join(least, "bucket").where(
        (F.col("s") * (100 + percent) >= percent * (F.col("n") + F.col("least"))) & (100 * F.col("s") >= percent * F.col("n"))
    )
    mixed = fit.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return fit.join(mixed.select("bucket"), "bucket", "left_semi").select("bucket", "node", "n", "s", "root")


def near_groups(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``near_duplicates`` with the row number of each row of ``docs``."""
    rows_of = written(signed(docs, width, bands, rows))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(UID).alias("uid"))
    classes = written(
        rows_of.where("n_shingles > 0").groupBy("digest").agg(
            F.min(UID).alias("node"), F.min(rank).alias("best"), F.count("*").alias("n_copies"),
            F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        )
    )
    # Buckets of at least two classes, each with its most central class: the one that shares
    # the fullest buckets, which in a group of copies is the one nearest to their origin.
    places = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = written(places.join(shared, "bucket"))
    central = members.groupBy("node").agg(F.sum("members").alias("company"))
    placed = members.join(central, "node")
    centres = placed.groupBy("bucket").agg(F.max(F.struct("company", -F.col("node"), "n")).alias("c")).select(
        "bucket", (-F.col("c.col2")).alias("centre"), F.col("c.n").alias("centre_n")
    )
    stars = written(
        members.join(centres, "bucket").where("node <> centre").where(_similar_size("n", "centre_n", percent))
        .select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    )
    wanted = written(members.select("node").distinct())
    texts = with_uid(docs.select("doc_id", "text")).select(F.col(UID).alias("node"), "text")
    texts = written(texts.join(small(wanted, wanted.count(), MOST_IDS), "node", "left_semi"))
    first = written(confirmed_links(stars, texts.join(_ends(stars), "node", "left_semi"), width, percent))

    # What the stars left in different components of one bucket, less what can have no link there.
    apart = written(_apart(members.drop("members"), components(first)))
    alone = _unshared(texts.join(apart.select("node").distinct(), "node", "left_semi"), width)
    rest = written(_can_link(apart.join(alone, "node", "left"), percent))
    rest = written(rest.join(_sketches(texts.join(rest.select("node").distinct(), "node", "left_semi"), width), "node"))
    other = rest.select(
        "bucket", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), F.col("root").alias("root_b"), F.col("sketch").alias("sketch_b")
    )
    most = F.least("s", "s_b")  # shingles that both can have
    differ = sum(
        (F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0)
    )
    pairs = written(
        rest.withColumnRenamed("node", "a").join(other, "bucket")
        .where((F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")))
        .where(100 * most >= percent * (F.col("n") + F.col("n_b") - most))
        .where((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n_b")))
        .select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    )
    second = written(confirmed_links(pairs, texts.join(_ends(pairs), "node", "left_semi"), width, percent))
    nodes = components(first.union(second))

    # From classes to rows: the best row of a component stays.
    parts = written(
        classes.join(nodes, "node", "left").select("digest", "best", "n_copies", F.coalesce("root", "node").alias("root"))
    )
    heads = parts.groupBy("root").agg(F.min("best").alias("head"))
    of_digest = parts.join(heads, "root").select("digest", "n_copies", "head")
    linked = rows_of.where("n_shingles > 0").join(of_digest, "digest").select(
        UID, "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col(UID) == F.col("head.uid")).alias("kept"), "n_copies"
    )
    alone = rows_of.where("n_shingles = 0").select(
        UID, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n_copies")
    )
    return linked.union(alone)


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_copies`` per row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` reachable over links, ``n_copies`` the rows
    with the very same set; one row of each component is kept. ``docs`` is read several
    times and must give its rows alike each time, as a stored table does.
    """
    return near_groups(docs, width, percent, bands, rows).drop(UID)


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all its columns, one row of each component of near duplicates."""
    return without(docs, written(near_groups(docs, width, percent).where("NOT kept").select(UID)))
