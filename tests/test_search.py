"""Phrase search by trigrams against a scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from normtext.session import shared_path
from normtext.sources.text_index import FEW, build_text_index, grams, search_texts

WORDS = "the of The THE Straße ÉCOLE été İstanbul 🙂 a ab x.y 100% o'clock \\d back_slash".split()


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(51)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["", "a", "ab", "abc", None, "common " + "z" * 5000, "q" * 40] + ["common words in every row"] * (FEW + 500)
    rows = spark.createDataFrame(list(enumerate(texts)), "provision_id int, text string").withColumn("_row", F.lit("clash"))
    path = shared_path(spark, "index")
    build_text_index(rows.repartition(5), path)
    return path, rows.cache()


def test_phrases_of_all_lengths(spark, indexed):
    path, rows = indexed
    rng = random.Random(52)
    texts = [r.text for r in rows.collect() if r.text]
    phrases = ["", "a", "%", "_", "'", "\\d", "ab", "the", "THE OF", "zz", "missing phrase", "COMMON", "common words", "straße", "STRASSE", "école", "İ", "i̇s", "q" * 40, "q" * 41]
    for length in range(1, 41, 3):
        text = rng.choice([t for t in texts if len(t) >= length])
        at = rng.randrange(len(text) - length + 1)
        phrases.append(rng.choice([str.upper, str.lower, str])(text[at : at + length]))
    for phrase in phrases:
        want = rows.where(F.contains(F.lower("text"), F.lower(F.lit(phrase)))).select("provision_id", "text", "_row")
        found = search_texts(spark, path, phrase)
        assert found.columns == ["provision_id", "text", "_row"]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())), phrase


def test_few_texts_are_read(spark, indexed):
    """A rare phrase is found by row numbers pushed to the scan; a missing trigram reads no text."""
    path, _ = indexed
    plan = search_texts(spark, path, "q" * 40)._jdf.queryExecution().toString()
    assert ("EqualTo(_row" in plan or "In(_row" in plan) and "Join" not in plan
    assert search_texts(spark, path, "never seen").collect() == []


def test_grams(spark):
    row = spark.createDataFrame([("Abcab",), ("aB",), ("",), ("🙂é漢x",)], "t string").select(grams(F.col("t")).alias("g")).collect()
    assert [r.g for r in row] == [["abc", "bca", "cab"], ["ab"], [""], ["🙂é漢", "é漢x"]]


def test_grams_are_all_threes_of_letters_from_one_search(spark):
    texts = ["", "a", "aB", "Abc", "abcd", "a\nb\r\nc\u2028d", "x\U0001F600y\U0001F601z\U00020000", "\U0001F600\U0001F601\U0001F602\U0001F603", "åäö ÅÄÖ åäö", " " * 9]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", grams(F.col("t")).alias("g")).collect()
    for t, found in rows:
        if t is None:
            assert not found or found == [None]
        else:
            low = t.lower()
            assert sorted(found) == sorted({low[i : i + 3] for i in range(max(1, len(low) - 2))})
    assert "lambdafunction" not in grams(F.col("t"))._jc.toString()  # letter by letter, a lambda made most of the index's time
