"""Language identification by bit-sliced Bloom filters of byte n-grams.

Each language has a Bloom filter of its frequent n-grams. The filters lie side by side:
row p of the table holds bit p of every language's filter as one mask, so the AND of a
few rows gives, for an n-gram, all languages that contain it. A text's n-grams are looked
up in one sweep; the count per language, corrected for the false positives that its
filter's fill lets expect, decides.

Texts are lower-cased; every byte outside letters (ASCII letters and all bytes of other
characters) is a separator. An n-gram belongs to a language if it makes up at least
``LEAST_SHARE`` of its n-grams (so a language has at most 1 / LEAST_SHARE of them, and the
table's size has a bound) and is not ``FOREIGN`` times as frequent in another one (words
quoted from there). The model is fitted on about ``FIT_ROWS`` labelled rows, chosen by a
hash of ``doc_id``; every row is predicted.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text with
letters but no known n-gram gets the most frequent language with score 0; equal counts
go to the alphabetically first language; without labelled rows all is ``und``. Rows
without ``doc_id`` are predicted and never learned from. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import pieces, text_bytes
from normtext.llm.storage import mapped, written

UNDETERMINED = "und"
GRAM = 4  # bytes
LEAST_SHARE = 2e-5
FOREIGN = 50
FIT_ROWS = 20_000
LEAST_SCORE = 0.3  # a text of which less is known n-grams of its best language is rejected
HASHES = 3
PIECE = 256 << 10  # bytes of text looked up at a time: arrays of some 40 times as much stand beside them
PLACE_BITS = 20  # rows of the table: 2**20, over 20 for each n-gram that a language can have

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # most frequent first
    table: np.ndarray  # (rows, words of 64 languages)
    false_positive: np.ndarray


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of all texts in a row, as integers, and the index of the text of each."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    data = _LETTERS[data]
    n = max(0, len(data) - GRAM + 1)
    grams = np.zeros(n, np.uint32)
    for k in range(GRAM):
        grams |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    document = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = (document[:n] == document[GRAM - 1 :]) & (grams != np.uint32(0x20202020))
    return grams[inside], document[:n][inside]


def _places(grams: np.ndarray) -> list[np.ndarray]:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << PLACE_BITS) - 1)
    return [((h >> np.uint64(64 - PLACE_BITS * (k + 1))) & low).astype(np.uint32) for k in range(HASHES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = batch.column("lang").unique()
        for language in languages.to_pylist():
            rows = batch.filter(pc.equal(batch.column("lang"), language))
            for piece in pieces(rows, "text", PIECE):
                grams, times = np.unique(_grams(piece.column("text"))[0], return_counts=True)
                yield pa.record_batch({
                    "lang": pa.array([language] * len(grams), pa.string()),
                    "gram": pa.array(grams.astype(np.int64)),
                    "times": pa.array(times.astype(np.int64)),
                })


def fit(labelled: DataFrame) -> LanguageModel:
    """Learns from ``text, lang`` of all given rows."""
    counts = mapped(
        labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"), _counted, "lang string, gram long, times long"
    )
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("times").alias("times")))
    totals = counts.groupBy("lang").agg(F.sum("times").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", "total", (F.col("times") / F.col("total")).alias("share"))
    frequent = shares.where(F.col("share") >= LEAST_SHARE)
    best = frequent.groupBy("gram").agg(F.max("share").alias("most"))
    # At most 1 / LEAST_SHARE rows a language: small enough for the driver at any input size.
    rows = frequent.join(best, "gram").where(F.col("share") * FOREIGN >= F.col("most")).select("lang", "gram", "total").collect()
    total = {r["lang"]: r["total"] for r in rows}
    languages = sorted(total, key=lambda x: (-total[x], x))
    table = np.zeros((1 << PLACE_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    for i, language in enumerate(languages):
        grams = np.array([r["gram"] for r in rows if r["lang"] == language], np.int64).astype(np.uint32)
        for places in _places(grams):
            table[places, i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
    if len(languages) <= 8:
        table = table.astype(np.uint8)
    return LanguageModel(languages, table, fill**HASHES)


def _language_counts(model: LanguageModel, grams: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    places = _places(grams)
    found = model.table[places[0]]
    for other in places[1:]:
        found = found & model.table[other]
    if found.dtype == np.uint8:
        by_mask = np.bincount(document * 256 + found[:, 0], minlength=n * 256).reshape(n, 256)
        bits = np.arange(256)[:, None] >> np.arange(len(model.languages)) & 1
        return by_mask @ bits
    return np.stack(
        [
            np.bincount(document, found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), minlength=n)
            for i in range(len(model.languages))
        ],
        axis=1,
    )


def classify(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    n = len(texts)
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n)
    order = np.argsort(model.languages)
    grams, document = _grams(texts)
    size = np.bincount(document, minlength=n)
    counts = _language_counts(model, grams, document, n)
    fixed = np.maximum(0, counts - size[:, None] * model.false_positive) / (1 - model.false_positive)
    fixed /= np.maximum(size, 1)[:, None]
    best = order[np.argmax(fixed[:, order], axis=1)]
    best = np.where(fixed.max(axis=1) > 0, best, 0)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    scores = np.where(lettered, np.clip(fixed.max(axis=1), 0, 1), 0.0)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())], scores


def _predicted(model: LanguageModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            languages, scores = classify(model, piece.column("text"))
            kept = [piece.column(i) for i, c in enumerate(piece.schema.names) if c != "text"]
            names = [c for c in piece.schema.names if c != "text"]
            yield pa.record_batch(
                [*kept, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
            )


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``; only ``text`` decides."""
    rows = docs.select("text", *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return mapped(
        rows, lambda batches: _predicted(model, batches), f"{fields + ', ' if fields else ''}lang_pred string, score double"
    )


def fitting_rows(docs: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """About ``most`` rows of ``docs``, by a hash of ``doc_id``; all of them if there are fewer."""
    share = min(1.0, most / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _learned(docs: DataFrame, fit_rows: int) -> LanguageModel:
    flagged = docs.select("doc_id", "text", "lang", held_out(3, 1).alias("held_out"))
    learnable = flagged.where("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    return fit(fitting_rows(learnable, fit_rows))


def drop_undetermined(docs: DataFrame, least: float = LEAST_SCORE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with all its columns, less the rows that are ``und`` or score under ``least``."""
    model = _learned(docs, fit_rows)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                languages, scores = classify(model, piece.column("text"))
                told = [language != UNDETERMINED and score >= least for language, score in zip(languages, scores.tolist())]
                yield piece.filter(pa.array(told, pa.bool_()))

    return mapped(docs, accepted, docs.schema)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs`` (``doc_id, text, lang``)."""
    flagged = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    return predict(flagged, _learned(docs, fit_rows), ["doc_id", "held_out"])
