import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from helpers import ODD_TEXTS, clashing, documents, stored, words

from normtext.llm import minhash
from normtext.llm.components import components
from normtext.llm.minhash import drop_near_duplicates, near_duplicates


def shingles(text, width=4):
    found = (text or "").encode().lower().split()
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def plain(rows, width=4, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return sorted(
        ((doc_id, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)), key=str
    )


def cases():
    rng = random.Random(5)
    rows = list(enumerate(ODD_TEXTS))
    base = words(rng, 200).split()
    for k in range(60):  # copies that stray from one origin, many just under the threshold
        text = list(base)
        for _ in range(rng.randrange(14)):
            text[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(text)))
    chain = words(rng, 300).split()
    for k in range(8):  # a chain: neighbours are linked, ends aren't
        rows.append((300 + k, " ".join(chain[12 * k : 12 * k + 200])))
    common = words(rng, 40)
    rows += [(400 + k, common + "\n" + words(rng, 60)) for k in range(30)]
    rows += [(500, "One two THREE"), (501, "one TWO three"), (502, "one two"), (503, "É É É É É"), (504, "é é é é é")]
    rows += [(100, rows[len(ODD_TEXTS)][1]), (None, rows[len(ODD_TEXTS)][1]), (None, None)]
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_components_match_all_pairs(spark, tmp_path):
    docs = stored(clashing(documents(spark, cases())), tmp_path)
    found = near_duplicates(docs)
    want = plain(cases())
    assert got(found) == want
    heads = [r for r in found.collect() if r.kept and r.n_shingles]
    linked = {r[2] for r in want if r[1]}
    assert len(heads) == len(linked)
    assert all(r.kept for r in found.collect() if not r.n_shingles)


def test_five_word_shingles_and_kept_rows(spark, tmp_path):
    docs = stored(clashing(documents(spark, cases())), tmp_path)
    left = drop_near_duplicates(docs, width=5)
    want = plain(cases(), width=5)
    assert left.columns == docs.columns
    assert left.count() == len({r[2] for r in want if r[1]}) + sum(not r[1] for r in want)


def test_empty_table(spark, tmp_path):
    assert near_duplicates(stored(documents(spark, []), tmp_path)).collect() == []
    assert near_duplicates(stored(documents(spark, [None, ""]), tmp_path, "blank")).count() == 2


def test_signature_is_circulant_and_estimates():
    """Every coordinate comes from the same two permutations; equal coordinates estimate the similarity."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    both = np.concatenate([a, b])
    signs = minhash.signatures(both, np.array([0, 2000]), 192)
    assert abs((signs[0] == signs[1]).mean() - 1500 / 2500) < 0.12
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash._permuted(x.copy(), minhash._SECOND))) == len(x)
    shifted = minhash._permuted((minhash._permuted((a >> np.uint64(32)).astype(np.uint32), minhash._FIRST) + np.uint32(7)), minhash._SECOND)
    assert signs[0, 7] == shifted.min()


def test_sets_match_plain():
    texts = [t for _, t in cases()]
    sets, starts = minhash.shingle_sets(pa.array(texts))
    assert np.diff(starts).tolist() == [len(shingles(t)) for t in texts]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 501), (501, 500), (502, 502)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(300)) and found[501] == 500


def test_sketch_bound_is_exact():
    texts = [t for _, t in cases() if shingles(t)]
    batch = pa.record_batch({"node": pa.array(range(len(texts))), "text": pa.array(texts)})
    rows = [r for b in minhash._sketched(4, iter([batch])) for r in b.column("sketch").to_pylist()]
    bits = np.unpackbits(np.array(rows, np.int64).view(np.uint8), axis=1)
    for i in range(0, len(texts), 5):
        for j in range(i):
            assert (bits[i] != bits[j]).sum() <= len(shingles(texts[i]) ^ shingles(texts[j]))
