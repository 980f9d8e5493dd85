"""Document quality with hierarchical empirical Bayes over hosts and paths.

A logistic classifier over a handful of text measures gives each document its evidence.
Grouped sums over all documents give each path and host its share of good documents; a
host's share is drawn to the global one and a path's to its host's, the more the fewer
documents they have. How strongly is estimated from the data: the spread of the shares
between hosts (and between paths of a host) beyond what chance makes, by moments of the
beta-binomial. A document's score adds the evidence of its own text to the log odds of
its path without the document itself, so nothing is counted twice.

The classifier is fitted on about ``FIT_ROWS`` labelled rows, chosen by a hash of
``doc_id``; sums and scores cover all rows. A host with a third of all rows is summed in
each task first and joined as one row.

Defined cases: a null or empty text has zero measures and is judged by them and its site;
a null host or path is a site of its own kind with the others that lack one; without
labels, or with labels of one kind only, the evidence is zero or that kind's prior;
repeated rows each count and get a score; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import IS_SPACE, pieces, span_hashes, text_bytes, words_of
from normtext.llm.storage import written

FIT_ROWS = 20_000
KEEP = 0.5
MOST_STRENGTH = 1e6
RIDGE = 1.0

_UPPER = np.array([chr(b).isupper() and b < 128 for b in range(256)])
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_SYMBOL = np.array([b < 128 and not chr(b).isalnum() and chr(b) not in " \t\r\n\v\f.,;:?'\"()-" for b in range(256)])
MEASURES = ("length", "upper", "symbols", "letters", "repeats", "distinct", "word_length")


def text_measures(texts: pa.Array) -> np.ndarray:
    """The measures of each text: one row per text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(MEASURES)))
    sizes = np.diff(offsets)
    before = {k: np.concatenate(([0], np.cumsum(mask[data]))) for k, mask in (("upper", _UPPER), ("symbols", _SYMBOL), ("letters", _LETTER))}
    share = lambda k: (before[k][offsets[1:]] - before[k][offsets[:-1]]) / np.maximum(sizes, 1)
    begin, end, first = words_of(IS_SPACE[data], offsets)
    words = span_hashes(data, begin, end)
    count = np.diff(first)
    again = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        again[2:] = np.cumsum(words[1:] == words[:-1])
    out[:, 0] = np.log1p(sizes)
    out[:, 1], out[:, 2], out[:, 3] = share("upper"), share("symbols"), share("letters")
    inner = np.maximum(count - 1, 0)
    out[:, 4] = (again[first[1:]] - again[np.minimum(first[:-1] + 1, first[1:])]) / np.maximum(inner, 1)
    out[:, 5] = [len(np.unique(words[a:b])) / np.sqrt(b - a) if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    out[:, 6] = sizes / np.maximum(count, 1)
    out[:, 6] = np.log1p(out[:, 6])
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = text_measures(piece.column("text"))
            kept = [c for c in piece.schema.names if c != "text"]
            measures = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(MEASURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*(piece.column(c) for c in kept), measures], [*kept, "measures"])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``measures`` of ``text``: from here on no text moves."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select("text", *keep).mapInArrow(_measured, f"{fields}measures array<double>")


def fit_evidence(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Constant and weights of a ridge logistic regression on the measures, for the log odds of quality."""
    if not len(y):
        return 0.0, np.zeros(len(MEASURES))
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(y)), (x - centre) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(hessian, z.T @ (y - p) - RIDGE * w)
    return float(w[0] - (w[1:] * centre / spread).sum()), w[1:] / spread


def _log_odds(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Rows of prior that fit the spread of the groups' shares around ``centre``: large if they differ by chance only.

    By moments: the squared distances beyond the binomial variance give the spread between groups.
    """
    row = groups.where("n >= 2").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - centre, 2)).alias("squares"),
        F.sum(centre * (1 - centre)).alias("chance"),
        F.sum((F.col("n") - 1) * centre * (1 - centre)).alias("weight"),
    ).first()
    squares, chance, weight = (float(v or 0) for v in row)
    between = (squares - chance) / weight if weight > 0 else 0.0
    return float(np.clip(1 / between - 1, 1.0, MOST_STRENGTH)) if between > 1 / MOST_STRENGTH else MOST_STRENGTH


def site_quality(measured: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """``doc_id, host, path, p_text, p_host, p_path, score, kept`` per row of ``measured``.

    ``measured`` has ``doc_id, host, path`` and the ``measures`` of ``measure``. ``labels`` has ``doc_id, quality`` (0 or 1); a labelled document's own label counts in its site.
    """
    told = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    measured = written(measured.select("doc_id", "host", "path", "measures").join(told, "doc_id", "left"))
    labelled = measured.where("quality IS NOT NULL")
    share = min(1.0, fit_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    fitted = sample.select("measures", "quality").toPandas()  # about ``fit_rows`` rows of seven numbers
    x = np.array(fitted["measures"].tolist(), float).reshape(-1, len(MEASURES))
    constant, weights = fit_evidence(x, fitted["quality"].to_numpy(float))
    line = F.lit(constant)
    for i, w in enumerate(weights.tolist()):
        line = line + F.lit(w) * F.get("measures", F.lit(i))
    p_text = 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))
    judged = written(
        measured.select("doc_id", "host", "path", p_text.alias("p_text"), F.coalesce(F.col("quality").cast("double"), p_text).alias("good"))
    )

    sums = [F.count("*").alias("n"), F.sum("good").alias("good")]
    paths = written(judged.groupBy("host", "path").agg(*sums))
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = min(max(float((whole["good"] or 0) / whole["n"]) if whole["n"] else 0.5, 1e-6), 1 - 1e-6)
    host_strength = _strength(hosts, F.lit(prior))
    drawn = hosts.select(
        F.col("host").alias("of_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"),
        ((F.col("good") + host_strength * prior) / (F.col("n") + host_strength)).alias("host_share"),
    )
    sited = written(paths.join(drawn, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"))
    path_strength = _strength(sited, F.col("host_share"))
    sites = sited.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", F.col("good").alias("path_good"), "host_n", "host_good")
    both = judged.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    p_host = (F.col("host_good") - F.col("good") + host_strength * prior) / (F.col("host_n") - 1 + host_strength)
    with_host = both.withColumn("p_host", p_host)
    p_path = (F.col("path_good") - F.col("good") + path_strength * F.col("p_host")) / (F.col("n") - 1 + path_strength)
    score = _log_odds(F.col("p_text")) - float(np.log(prior / (1 - prior))) + _log_odds(F.col("p_path"))
    scored = with_host.withColumn("p_path", p_path).withColumn("score", 1 / (1 + F.exp(-score)))
    return scored.select("doc_id", "host", "path", "p_text", "p_host", "p_path", "score", (F.col("score") >= keep).alias("kept"))
