"""Small tables for the tests of the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """A documents table; ``texts`` are texts or (doc_id, text) pairs."""
    rows = []
    for i, x in enumerate(texts):
        doc_id, text = x if isinstance(x, tuple) else (i, x)
        rows.append((doc_id, text, columns.get("lang", "en"), columns.get("source", "s"), len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def stored(df, tmp_path, name="docs"):
    """The rows as a stored table, which reads alike each time."""
    path = f"file://{tmp_path}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clashing(df):
    """The table with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("_uid", "node", "bucket", "digest", "key", "kept", "score", "hash", "_row", "n", "total"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def prose(rng: random.Random, n: int) -> str:
    """Words of letters only, so that no two are the same template."""
    return " ".join("".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(n))


ODD_TEXTS = [None, "", "   \n\t", "a", "b c", "Ünï çødé 漢字 🙂 end", "x" * 50_000, "lorem ipsum dolor sit amet " * 4000]
