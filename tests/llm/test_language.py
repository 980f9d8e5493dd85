import random

import pytest
from helpers import ODD_TEXTS, clashing, documents, stored
from pyspark.sql import functions as F

from normtext.llm.language_bits import classify, drop_undetermined, fit, identify

SYLLABLES = {"aa": "ba be bi bo bu da de di do du", "bb": "ka ke ki ko ku ta te ti to tu", "cc": "bá kè ñi ço dü tö ße øk åt il"}


def text_of(lang, rng, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def corpus(spark, tmp_path, n=240):
    rng = random.Random(2)
    rows = [(i, text_of(lang := rng.choice(list(SYLLABLES)), rng, rng.randrange(3, 60)), lang, "s", 0) for i in range(n)]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate([*ODD_TEXTS, "12 34 !!", "🙂🙂", "漢字"])] + [(None, rows[0][1], "aa", "s", 0)]
    return stored(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), tmp_path), rows


def test_held_out_accuracy_and_cases(spark, tmp_path):
    docs, rows = corpus(spark, tmp_path)
    found = {r.doc_id: r for r in identify(docs).collect()}
    told = {r[0]: r[2] for r in rows}
    held = [r for i, r in found.items() if r.held_out and told[i]]
    assert len(held) > 50 and sum(r.lang_pred == told[r.doc_id] for r in held) / len(held) > 0.97
    blank = {1000 + i for i, t in enumerate([*ODD_TEXTS, "12 34 !!", "🙂🙂", "漢字"]) if not any(c.isalpha() for c in t or "")}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == blank
    assert all(0 <= r.score <= 1 and (r.score == 0 or r.lang_pred != "und") for r in found.values())
    assert found[None].lang_pred == found[0].lang_pred and not found[None].held_out


def test_labels_never_decide(spark, tmp_path):
    docs, _ = corpus(spark, tmp_path)
    other = stored(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "zz").otherwise(F.col("lang"))), tmp_path, "other")
    same = sorted(map(tuple, identify(docs).collect()), key=str)
    assert sorted(map(tuple, identify(other).collect()), key=str) == same


def test_stage_keeps_rows_whole(spark, tmp_path):
    docs, rows = corpus(spark, tmp_path)
    left = drop_undetermined(docs)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert {r[0] for r in rows if r[2]} <= ids and 1000 not in ids and 1001 not in ids


def test_counts_match_plain(spark):
    """The filters tell exactly the languages of each n-gram, but for false positives, which the correction removes."""
    rng = random.Random(4)
    rows = [(text_of(lang, rng, 40), lang) for lang in SYLLABLES for _ in range(30)]
    model = fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.languages) == set(SYLLABLES) and (model.false_positive < 1e-3).all()
    import pyarrow as pa

    for lang in SYLLABLES:
        languages, scores = classify(model, pa.array([text_of(lang, rng, 50)]))
        assert languages == [lang] and scores[0] > 0.9


@pytest.mark.parametrize("texts", [[], [None, "no label here"]])
def test_without_labels(spark, tmp_path, texts):
    docs = stored(documents(spark, texts, lang=None), tmp_path)
    assert [r.lang_pred for r in identify(docs).collect()] == ["und"] * len(texts)
