"""Periodic runs of words inside a text, by seeds and extension along diagonals.

A run is a stretch of words with smallest period q, at least ``max(LEAST_WORDS, TIMES * q)``
words long, that no neighbouring word extends. Words q apart are equal on all of it, so on
the diagonal of lag q it is a stretch of equal pairs, the overlap, of at least its length
less q.

Lags are taken in classes [2**j, 2**(j+1)). ``3 * 2**j`` words is the overlap that every run
of a class has at least, so every window of so many words in the overlap recurs q words
on. For each class the windows are indexed by position, and each is paired with its nearest
recurrence in the class. That one is enough: were there a nearer one than q, the
window would have both q and their distance as periods, and being as long as both together
also their greatest common divisor, which then would be a smaller period of the run. So a
text gives at most one seed a word and class, never all pairs of a frequent word. A seed is
extended in both directions; the furthest word covered on a lag passes over all further
seeds of that lag up to there. Stretches whose period is a multiple of a smaller one are the
same stretch as that one's, and only the smallest is kept. Runs of one word (q = 1) are read
off their diagonal.

Equality is decided on word numbers, never on hashes; a false recurrence is seen at its first word.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed
text; runs with equal starts stand in the order of their periods; repeated rows each get
their result; an empty table gives an empty table; only ``text`` and the columns asked for
are read, so no other name can clash, and those named may be of any type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import mix, pieces, window_hashes

LEAST_WORDS = 6
TIMES = 4
BLOCK = 64  # words compared at first while extending; doubled with each block

RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal words alike."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _equal_until(ids: np.ndarray, lag: int, at: int) -> int:
    """The first position from ``at`` on whose word differs from the one ``lag`` on."""
    end, block = len(ids) - lag, BLOCK
    while at < end:
        upto = min(at + block, end)
        differs = ids[at:upto] != ids[at + lag : upto + lag]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, block = upto, 2 * block
    return end


def _equal_since(ids: np.ndarray, lag: int, at: int) -> int:
    """The first position of the equal stretch on diagonal ``lag`` that ends before ``at``."""
    block = BLOCK
    while at > 0:
        down = max(0, at - block)
        differs = ids[down:at] != ids[down + lag : at + lag]
        last = int(differs[::-1].argmax())
        if differs[len(differs) - 1 - last]:
            return at - last
        at, block = down, 2 * block
    return 0


def _seeds(grams: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Lag and position of each window's nearest recurrence at a lag in [low, 2 low), by lag and position.

    None if no window recurs at all: then no longer one does.
    """
    order = np.argsort(grams, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = grams[order][1:] != grams[order][:-1]
    if new.all():
        return None
    n = len(grams) + 2 * low
    index = np.cumsum(new) * n + order  # by window, then position; windows stand further apart than any lag
    found = np.searchsorted(index, index + low)
    lags = index[np.minimum(found, len(index) - 1)] - index
    near = (found < len(index)) & (lags < 2 * low) & (lags >= low)
    lags, at = lags[near], order[near]
    sort = np.lexsort((at, lags))
    return lags[sort], at[sort]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of the word numbers, by start and period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    found: dict[tuple[int, int], int] = {}

    def extend(lag: int, at: np.ndarray) -> None:
        covered = 0
        while (i := int(np.searchsorted(at, covered))) < len(at):
            seed = int(at[i])
            end = _equal_until(ids, lag, seed)
            start = _equal_since(ids, lag, seed)
            if end - start + lag >= max(LEAST_WORDS, TIMES * lag):
                found.setdefault((start, end + lag), lag)
            covered = max(end, seed + 1)

    alike = ids[:-1] == ids[1:]
    if np.count_nonzero(alike) >= LEAST_WORDS - 1:
        extend(1, np.flatnonzero(alike))
    low, width = 2, 3 * 2
    grams = window_hashes(ids.astype(np.uint64), 3)
    while n >= TIMES * low:
        grams = mix(mix(grams[: -width // 2]) + grams[width // 2 :])
        seeds = _seeds(grams, low)
        if seeds is None:
            break
        lags, at = seeds
        edges = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            extend(int(lags[a]), at[a:b])
        low, width = 2 * low, 2 * width
    return sorted((start, end - start, period) for (start, end), period in found.items())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def _found(keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            counts, runs, texts = [], [], []
            for text in piece.column("text").cast(pa.large_binary()):
                words = (text.as_py() or b"").split()  # of bytes: parts at [\x20\x09-\x0D]
                told = runs_of(_numbered(words)) if len(words) >= LEAST_WORDS else []
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in told])
                texts.append(_collapsed(words, told))
            yield pa.record_batch(
                [
                    *[piece.column(c) for c in keep],
                    pa.array(counts, pa.int64()),
                    pa.array(runs, pa.list_(RUN_TYPE)),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                [*keep, "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row with ``n_words``, ``runs`` (structs ``start, length, period``) and ``collapsed``.

    ``collapsed`` is the text without the words that a run holds after its first period.
    Starts and lengths count words.
    """
    kept = docs.select(*[F.col(c) for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _found(keep, batches),
        fields + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )


def with_repetition(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the words of one document in ten repeated from some word on.

    With h the crc32 of the id and g a tenth of it, word i at or after a = g % n becomes word
    a + (i - a) % p of the same text, where p = 1 + floor((n - a) / (3 + g % 8)).
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    g = "crc32(cast(doc_id AS string)) DIV 10"
    words = "filter(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')"
    split = docs.select("doc_id", "text", F.when(chosen, F.expr(words)).alias("words"))
    placed = split.select("doc_id", "text", "words", F.expr(f"({g}) % size(words)").alias("a"), F.expr(g).alias("g"))
    placed = placed.withColumn("p", F.expr("1 + (size(words) - a) DIV (3 + g % 8)"))
    repeated = F.expr(
        "array_join(transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p AS int)))), ' ')"
    )
    return placed.select("doc_id", F.when(F.size("words") > 0, repeated).otherwise(F.col("text")).alias("text"))
