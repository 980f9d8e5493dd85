"""Toxic spans by a linear-chain conditional random field; documents by its marginals.

Tokens are lower-cased runs of letters with four features each: the word and its first four, five and
six bytes (stems with changing endings). Labelled tokens come from labelled documents:
a token of a toxic document is toxic if one of its features is in far more toxic than
clean documents than chance allows (a likelihood-ratio test over grouped document counts).
The field has one weight per hashed feature and one per transition between the two tags;
it is trained by full-batch gradient steps whose sums run in a few Spark tasks. Forward and
backward passes give each token's marginal; a logistic function of a document's summed
and largest marginal, fitted on the same rows, is its score. Runs of tokens with a marginal of at
least one half are the offending spans.

Fitting reads about ``FIT_ROWS`` labelled rows, chosen by a hash of ``doc_id``; scoring
reads every row and whole texts. Both passes run over all documents of a batch at a time,
position by position, so a long text costs steps, not memory.

Defined cases: a null, empty or letterless text has no token and gets the score of no
evidence; without toxic or without clean labelled rows every score is the share of toxic
ones (0 without labels); repeated rows each get a score; null ids are scored and never
learned from; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import LOWER, pieces, span_hashes, text_bytes, words_of
from normtext.llm.language_bits import held_out
from normtext.llm.storage import written

FIT_ROWS = 6_000
FEATURE_BITS = 18
PREFIXES = (4, 5, 6)
LEAST_EVIDENCE = 20.0  # of the likelihood-ratio test, for a feature to label tokens
FIT_TASKS = 8  # of a gradient step over the fitting rows, which are few: each sends its sum to the driver
STEPS = 14
RATE = 1.0
DECAY = 1e-6
THRESHOLD = 0.3
PIECE = 4 << 20

_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_WIDTH = 1 + len(PREFIXES)


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray  # one per feature bucket, the last is the bias
    steps: np.ndarray  # transition weights, from row to column
    scale: np.ndarray  # logistic weights of the document score: constant, log summed marginals, largest marginal


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case that keeps every byte in its place: ASCII and the Latin-1 letters."""
    out = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def token_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (tokens x features), first token of each text, and start and end byte of each token."""
    data, offsets = text_bytes(texts)
    data = _folded(data)
    begin, end, first = words_of(_NO_LETTER[data], offsets)
    columns = [span_hashes(data, begin, end)]
    for k, length in enumerate(PREFIXES):
        cut = span_hashes(data, begin, np.minimum(begin + length, end))
        columns.append(cut * np.uint64(2 * k + 3))
    buckets = np.stack([(c >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for c in columns], axis=1) if len(begin) else np.zeros((0, _WIDTH), np.int32)
    return buckets, first, begin, end


def _order(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling length, and how many have a token at each position."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    return first[:-1][order], active


def forward_backward(odds: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of the two tags' forward sums, and of their backward sums, at every token.

    ``odds`` is exp of each token's emission. Only ratios are carried, so nothing can
    overflow however long a text is.
    """
    (stay, enter), (leave, go_on) = np.exp(steps)
    ahead, back = odds.copy(), np.ones_like(odds)
    starts, active = _order(first)
    ends = starts + np.diff(first)[np.argsort(-np.diff(first), kind="stable")]
    if len(active):
        before = ahead[starts[: active[0]]]
        behind = back[ends[: active[0]] - 1]
    for t in range(1, len(active)):
        n = active[t]
        at = starts[:n] + t
        before = odds[at] * (enter + go_on * before[:n]) / (stay + leave * before[:n])
        ahead[at] = before
        at = ends[:n] - 1 - t
        weighted = odds[at + 1] * behind[:n]
        behind = (leave + go_on * weighted) / (stay + enter * weighted)
        back[at] = behind
    return ahead, back


def _emission(buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.full(len(buckets), weights[-1], np.float64)
    for k in range(_WIDTH):
        total += weights[buckets[:, k]]
    return np.exp(np.clip(total, -30, 30))


def marginals(buckets: np.ndarray, first: np.ndarray, model: ToxicModel) -> np.ndarray:
    odds = _emission(buckets, model.weights)
    ahead, back = forward_backward(odds, first, model.steps)
    both = ahead * back
    return both / (1 + both)


def gradient(buckets: np.ndarray, labels: np.ndarray, first: np.ndarray, model: ToxicModel) -> np.ndarray:
    """Of the log-likelihood, for all weights and then the four transitions."""
    odds = _emission(buckets, model.weights)
    ahead, back = forward_backward(odds, first, model.steps)
    both = ahead * back
    miss = labels - both / (1 + both)
    size = len(model.weights)
    out = np.zeros(size + 4)
    for k in range(_WIDTH):
        out[:size] += np.bincount(buckets[:, k], miss, minlength=size)
    out[size - 1] = miss.sum()
    inner = np.ones(len(odds), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    later = np.flatnonzero(inner)
    pair = np.exp(model.steps)[:, :, None] * np.ones((2, 2, len(later)))
    pair[1] *= ahead[later - 1]
    pair[:, 1] *= odds[later] * back[later]
    expected = (pair / pair.sum(axis=(0, 1))).sum(axis=2)
    told = np.zeros((2, 2))
    np.add.at(told, (labels[later - 1].astype(int), labels[later].astype(int)), 1)
    out[size:] = (told - expected).ravel()
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        row = 0
        for piece in pieces(batch, "text", PIECE):
            buckets, first, _, _ = token_features(piece.column("text"))
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                counts[toxic[row], np.unique(buckets[a:b])] += 1
                row += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.record_batch({
            "feature": pa.array(used, pa.int64()), "clean": pa.array(counts[0, used]), "toxic": pa.array(counts[1, used]),
        })


def evidence(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The likelihood-ratio statistic of each feature's document counts, 0 where clean texts hold it as often."""
    total = clean + toxic
    share = n_toxic / (n_clean + n_toxic)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic, toxic * np.log(toxic / (total * share)), 0) + np.where(clean, clean * np.log(clean / (total * (1 - share))), 0))
    return np.where(toxic * n_clean > 5 * clean * n_toxic, g, 0)


def _labelled_tokens(telling: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            buckets, first, _, _ = token_features(piece.column("text"))
            labels = telling[buckets].any(axis=1) & np.repeat(toxic, np.diff(first))
            spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.record_batch({
                "toxic": piece.column("toxic"),
                "features": pa.array([buckets[a:b].tobytes() for a, b in spans], pa.binary()),
                "labels": pa.array([labels[a:b].tobytes() for a, b in spans], pa.binary()),
            })


def _token_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("features"))
    labels, first = text_bytes(batch.column("labels"))
    return np.frombuffer(data.tobytes(), np.int32).reshape(-1, _WIDTH), labels.astype(np.float64), first


def _gradients(model: ToxicModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(model.weights) + 4)
    for batch in batches:
        for piece in pieces(batch, "features", 4 * PIECE):
            buckets, labels, first = _token_rows(piece)
            total += gradient(buckets, labels, first, model)
    at = np.flatnonzero(total)  # the features of a task's rows are few of all
    yield pa.record_batch({
        "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "gradient": pa.array([total[at].tobytes()], pa.binary()),
    })


def gradient_parts(tokens: DataFrame, model: ToxicModel) -> DataFrame:
    """The gradient's non-zero places and values, one row a task: at most ``FIT_TASKS``, however many files hold the rows."""
    return tokens.coalesce(FIT_TASKS).mapInArrow(lambda batches: _gradients(model, batches), "at binary, gradient binary")


def slope(tokens: DataFrame, model: ToxicModel) -> np.ndarray:
    """The gradient over all rows, added up part by part."""
    total = np.zeros(len(model.weights) + 4)
    for part in gradient_parts(tokens, model).collect():
        total[np.frombuffer(part["at"], np.int32)] += np.frombuffer(part["gradient"], np.float64)
    return total


def _summary(p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed marginals above one half, and the largest marginal, of each text."""
    sizes = np.diff(first)
    document = np.repeat(np.arange(len(sizes)), sizes)
    summed = np.bincount(document, np.where(p >= 0.5, p, 0), minlength=len(sizes))
    largest = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        largest[full] = np.maximum.reduceat(p, first[full])
    return summed, largest


def _summaries(model: ToxicModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "features", 4 * PIECE):
            buckets, _, first = _token_rows(piece)
            summed, largest = _summary(marginals(buckets, first, model), first)
            yield pa.record_batch({"toxic": piece.column("toxic"), "summed": pa.array(summed), "largest": pa.array(largest)})


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``x`` has its constant."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


def _columns(summed: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(summed), np.log1p(summed), largest], axis=1)


def fit(labelled: DataFrame) -> ToxicModel:
    """Learns from ``text, toxic`` (0 or 1) of all given rows; the caller bounds them."""
    rows = written(labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")))
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = count.get(0, 0), count.get(1, 0)
    size = (1 << FEATURE_BITS) + 1
    weights, steps = np.zeros(size), np.zeros((2, 2))
    if not n_clean or not n_toxic:
        share = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0
        constant = np.clip(np.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0), -30, 30)
        weights[-1] = -30.0
        return ToxicModel(weights, steps, np.array([constant, 0.0, 0.0]))
    counts = rows.mapInArrow(_document_counts, "feature long, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).toPandas()  # one row for each hash bucket at most
    telling = np.zeros(1 << FEATURE_BITS, bool)
    strong = evidence(counts["clean"].to_numpy(), counts["toxic"].to_numpy(), n_clean, n_toxic) >= LEAST_EVIDENCE
    telling[counts["feature"].to_numpy()[strong]] = True
    tokens = written(
        rows.mapInArrow(lambda batches: _labelled_tokens(telling, batches), "toxic int, features binary, labels binary")
    )
    weights[-1] = -2.0
    past = np.full(size + 4, 1e-8)
    for _ in range(STEPS):
        model = ToxicModel(weights, steps, np.zeros(3))
        uphill = slope(tokens, model)
        uphill[:size] -= DECAY * (n_clean + n_toxic) * weights
        past = past + uphill**2
        move = RATE * uphill / np.sqrt(past)
        weights, steps = weights + move[:size], steps + 0.3 * move[size:].reshape(2, 2)
    model = ToxicModel(weights, steps, np.zeros(3))
    told = tokens.mapInArrow(
        lambda batches: _summaries(model, batches), "toxic int, summed double, largest double"
    ).toPandas()  # three numbers for each fitting row
    scale = _logistic(_columns(told["summed"].to_numpy(), told["largest"].to_numpy()), told["toxic"].to_numpy())
    return ToxicModel(weights.astype(np.float32), steps, scale)


def _scored(model: ToxicModel, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            buckets, first, begin, end = token_features(piece.column("text"))
            p = marginals(buckets, first, model)
            score = 1 / (1 + np.exp(-np.clip(_columns(*_summary(p, first)) @ model.scale, -30, 30)))
            spans = _span_lists(p, first, begin, end, piece.column("text"))
            kept = [c for c in piece.schema.names if c != "text"]
            yield pa.record_batch(
                [*(piece.column(c) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, pa.string())],
                [*kept, "score", "predicted", "spans"],
            )


def _span_lists(p: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, texts: pa.Array) -> list[str]:
    """``start:end`` of every run of toxic tokens in a text, in code points, comma-joined."""
    data, offsets = text_bytes(texts)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out: list[list[str]] = [[] for _ in range(len(first) - 1)]
    hot = np.flatnonzero(p >= 0.5)
    document = np.searchsorted(first, hot, side="right") - 1
    fresh = np.ones(len(hot), bool)
    fresh[1:] = (hot[1:] != hot[:-1] + 1) | (document[1:] != document[:-1])
    runs = np.flatnonzero(fresh)
    last = np.append(runs[1:], len(hot)) - 1 if len(runs) else runs
    for a, b in zip(runs.tolist(), last.tolist()):
        zero = points[offsets[document[a]]]
        out[document[a]].append(f"{points[begin[hot[a]]] - zero}:{points[end[hot[b]]] - zero}")
    return [",".join(x) for x in out]


def score(docs: DataFrame, model: ToxicModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with ``score``, ``predicted`` and ``spans``; only ``text`` decides."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select("text", *keep).mapInArrow(
        lambda batches: _scored(model, threshold, batches), f"{fields}score double, predicted int, spans string"
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` per row of ``docs`` (``doc_id, text``); ``labels`` has ``doc_id, toxic``."""
    told = labels.where("toxic IS NOT NULL").select("doc_id", "toxic", held_out(4, 2).alias("held_out")).where(
        "NOT held_out AND doc_id IS NOT NULL"
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, told.count()))
    chosen = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    model = fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # about ``fit_rows`` ids
    return score(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model, ["doc_id", "held_out"])
