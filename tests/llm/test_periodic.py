import hashlib
import random
import zlib

import numpy as np
from helpers import ODD_TEXTS, clashing, documents, stored

from normtext.llm.periodic_runs import periodic_runs, runs_of, with_repetition
from normtext.llm.queries import registry


def plain_runs(words):
    """Every run, from the definition: each stretch, its smallest period, and its two neighbours."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(words[x] == words[x + r] for x in range(start, start + length - r)) for r in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.add((start, length, q))
            i = j + 1
    return sorted(found)


def plain(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_match_plain():
    rng = random.Random(3)
    cases = [[], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1, 2, 1] * 20, [1] * 9 + [2] + [1] * 9]
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):  # plant repetitions, some of them of repetitions
            at, q = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            block = words[at : at + q] or [0]
            words[at:at] = block * rng.randrange(6)
        cases.append(words[:300])
    for words in cases:
        assert runs_of(np.array(words, np.int64)) == plain_runs(words), words


def test_one_seed_a_class_is_enough_for_long_periods():
    rng = random.Random(5)
    for q in (31, 32, 33, 64, 100, 257):
        block = [rng.randrange(4) for _ in range(q)]
        words = [9, 8] + block * 4 + block[: q // 2] + [7] + [1, 2, 1, 1, 2] * 40
        assert runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_seeds_grow_with_the_words():
    """A text of one word has all its pairs on one diagonal; none of the others is walked."""
    assert runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs_of(np.arange(300_000) % 1000) == [(0, 300_000, 1000)]


def test_query_matches_plain(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, "  " + " \t".join(rng.choice(["a", "b", "É", "漢", "d" * 40]) for _ in range(rng.randrange(80))) + "\n") for i in range(150)]
    rows += [(None, "x y " * 10), (100, rows[20][1]), (7, "x " * 7), (-10, "one two three four " * 6)]
    docs = clashing(documents(spark, rows))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    found = registry.queries["op13_periodic_runs"](spark, f"{tmp_path}/in")
    # One long text of a single phrase is too long for the plain version: only its longest run is compared.
    told = sorted((tuple(r) for r in found.collect()), key=str)
    long = [r for r in told if r[0] == 7 and r[3] and r[3] > 100]
    want = sorted((plain(i, t) for i, t in rows if not (i == 7 and t and len(t) > 1000)), key=str)
    assert [r for r in told if r not in long] == want
    assert [r[1:6] for r in long] in ([(1, 0, 20_000, 5, 4_000_000)], [(1, 0, 20_001, 5, 4_000_200)])


def test_real_outputs_and_empty_table(spark, tmp_path):
    docs = stored(documents(spark, [(1, "so it goes so it goes so it goes so it goes on"), (2, None), (3, "plain text")]), tmp_path)
    found = {r.doc_id: r for r in periodic_runs(docs, ["doc_id", "source"]).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 12, 3)] and found[1].collapsed == "so it goes on" and found[1].source == "s"
    assert found[2].runs == [] and found[2].collapsed == "" and found[3].collapsed == "plain text"
    empty = stored(documents(spark, []), tmp_path, "empty")
    assert periodic_runs(empty, []).count() == 0 and with_repetition(empty).count() == 0
