import collections
import random
import re
import zlib

from helpers import ODD_TEXTS, clashing, documents, words as filler

from normtext.llm.queries import registry
from normtext.llm.spelling_trie import near_words, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts):
    """``word, form, root, n, n_near, form_n`` from the definition, all pairs compared."""
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def plain_counts(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_variants_match_plain(spark):
    rng = random.Random(11)
    counts = {w: rng.choice([5, 5, 6, 30, 200, 1000]) for w in ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "ababaab", "ÿ" * 6, "ÿ" * 7, "é" * 300, "é" * 301, "é" * 299 + "e"]}
    for _ in range(400):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 10)))
        counts[word] = rng.choice([5, 5, 6, 30, 200, 1000])
    for w in list(counts)[:200]:
        i = rng.randrange(len(w) + 1)
        counts.setdefault(w[:i] + rng.choice("ab÷") + w[i:], 5)
    counts = {w: n for w, n in counts.items() if len(w) >= 6}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted((tuple(r) for r in spelling_variants(table).collect()), key=lambda r: r[0]) == plain(counts)


def test_words_of_any_letters(spark):
    """Pairs of short words and of letters outside the query's range are found too."""
    words = ["a", "ab", "b", "\U0001f642x", "x", "漢字", "漢x字", "漢字字", "ba"]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = {(r.word, r.other) for r in near_words(table).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_query_matches_plain(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdeoé") for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    vocabulary += [w[:2] + "z" + w[2:] for w in vocabulary[:40]]
    rows = list(enumerate(ODD_TEXTS))
    for i in range(120):
        told = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        rows.append((1000 + i, " ".join(w.upper() if rng.random() < 0.1 else w for w in told) + " ÉCOLE ×÷ tail"))
    rows += [rows[-1], (None, rows[-1][1]), (5, filler(rng, 50))]
    clashing(documents(spark, rows)).write.parquet(f"{tmp_path}/in/documents.parquet")
    found = registry.queries["op11_spelling_variants"](spark, f"{tmp_path}/in")
    want = plain(plain_counts(rows))
    assert len(want) > 100 and any(r[1] for r in want)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == want


def test_no_words(spark, tmp_path):
    documents(spark, [None, "", "short words only"]).write.parquet(f"{tmp_path}/in/documents.parquet")
    assert registry.queries["op11_spelling_variants"](spark, f"{tmp_path}/in").collect() == []


def test_an_infix_of_a_hot_prefix(spark):
    """A third of all words share a prefix; every word has few children at a node, whatever the words."""
    words = ["prefix" + "".join("abcd"[i // 4**k % 4] for k in range(4)) for i in range(256)]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = {r.word: r.n_near for r in spelling_variants(table).collect()}
    assert found == {w: 12 for w in words}  # three other letters at each of the last four places
