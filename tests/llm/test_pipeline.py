"""The pipeline against a plain version made of the same decisions, and the driver contract."""

import random

import corpus_pipeline
from helpers import ODD_TEXTS, prose, stored
from pyspark.sql import functions as F
from test_exact import plain as plain_exact
from test_near import plain as plain_near

from normtext.llm import catalog
from normtext.llm.length_buckets import CONTEXT


def tables(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 40)
    base = prose(rng, 120).split()
    texts = [prose(rng, 60) for _ in range(30)] + [*ODD_TEXTS, "12 34 56 !!"]
    texts += [texts[0] + "  ", texts[0].replace(" ", "\n"), texts[1]]
    for k in range(6):
        text = list(base)
        text[10 * k + 5] = f"n{k}"
        texts.append(" ".join(text))
    texts += [f"{prose(rng, 20)} {item} {prose(rng, 20)}", prose(rng, 5000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path, "documents.parquet")
    stored(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark.parquet")
    return [(i, t) for i, t, *_ in rows], item


def plain(rows, item):
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    keep = {k for _, k, _, _ in plain_exact(left)}
    left = [(i, t) for i, t in left if i in keep]
    near = {i: c for i, _, c in plain_near(left, width=5)}
    left = [(i, t) for i, t in left if near[i] == i]
    return {i for i, t in left if item not in t}


def test_run_matches_plain(spark, tmp_path):
    rows, item = tables(spark, tmp_path)
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    known = {r.doc_id for r in found}
    want = plain(rows, item)
    assert known <= want
    # Rejected for unknown n-grams: only texts unlike all others.
    assert {i for i in want - known} <= {i for i, t in rows if len(set((t or "").split())) < 8}
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, parts in pieces.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.start_token for r in parts] == [CONTEXT * k for k in range(len(parts))]
        assert all(r.n_tokens == CONTEXT for r in parts[:-1])


def test_stages_return_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet").withColumn("_uid", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns, name


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.queries())
    assert numbers == list(range(1, 14))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert list(corpus_pipeline.queries()) == ["pipeline"]
