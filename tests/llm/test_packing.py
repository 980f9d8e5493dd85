import itertools
import random
from collections import Counter, defaultdict

from helpers import ODD_TEXTS, clashing, documents, stored, words
from pyspark.sql import functions as F

from normtext.llm.length_buckets import best_buckets, pack


def padding(histogram, ends):
    return sum(times * (min(e for e in ends if e >= length) - length) for length, times in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        histogram = {length: rng.randrange(1, 9) for length in rng.sample(range(1, 40), rng.randrange(1, 9))}
        most = rng.randrange(1, 5)
        found = best_buckets(histogram, most)
        lengths = sorted(histogram)
        best = min(
            padding(histogram, (*ends, lengths[-1]))
            for k in range(min(most, len(lengths)))
            for ends in itertools.combinations(lengths[:-1], k)
        )
        assert found.padding == best == padding(histogram, found.lengths)
        assert sum(found.rows) == sum(histogram.values())


def test_batches_hold_their_budget(spark, tmp_path):
    rng = random.Random(3)
    rows = [*enumerate(ODD_TEXTS), *((50 + i, words(rng, rng.randrange(1, 90))) for i in range(120)), (60, "again"), (None, "no id"), (60, "again")]
    docs = stored(clashing(documents(spark, rows)), tmp_path)
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).cast("long")
    found = pack(docs, tokens=count, context=64, buckets=4, budget=256).collect()
    want = Counter()
    for doc_id, text in rows:
        left, piece = len((text or "").split()), 0
        while piece == 0 or left > 0:
            want[(doc_id, piece, 64 * piece, min(left, 64))] += 1
            left, piece = left - 64, piece + 1
    assert Counter((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in found) == want
    packed = [r for r in found if r.n_tokens]
    assert all(r.bucket is None and r.batch_id is None for r in found if not r.n_tokens)
    assert len({(r.batch_id, r.slot) for r in packed}) == len(packed)
    batches = defaultdict(list)
    for r in packed:
        batches[r.batch_id].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for rows_of in batches.values():
        assert len({r.bucket for r in rows_of}) == 1 and len(rows_of) * rows_of[0].bucket_length <= 256
        assert sorted(r.slot for r in rows_of) == list(range(len(rows_of)))
    histogram = Counter(r.n_tokens for r in packed)
    assert sum(r.bucket_length - r.n_tokens for r in packed) == best_buckets(histogram, 4).padding


def test_empty_and_blank(spark, tmp_path):
    assert pack(stored(documents(spark, []), tmp_path, "empty")).collect() == []
    assert [r.batch_id for r in pack(stored(documents(spark, [None, " "]), tmp_path, "blank")).collect()] == [None, None]
