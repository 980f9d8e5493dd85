import hashlib
import re
from collections import defaultdict

import numpy as np
from helpers import ODD_TEXTS, clashing, documents, stored

from normtext.llm.buffers import IS_SPACE
from normtext.llm.exact_chunks import chunk_recipes, cut_points, drop_exact_duplicates, exact_duplicates


def plain(rows):
    groups = defaultdict(list)
    for place, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id, place))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for m in members:
            out.append((m[2], best[2], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    texts = [*ODD_TEXTS, "a b c", "ab c", "abc", "abc ", "same", "same", "l o r e m", "x" * 50_000 + " ", "🙂 🙂", "🙂🙂"]
    return [*enumerate(texts), (None, "abc"), (7, "again"), (7, "again")]


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_groups_match_plain(spark, tmp_path):
    docs = stored(clashing(documents(spark, cases())), tmp_path)
    found = exact_duplicates(docs)
    assert got(found) == plain(cases())
    kept = [r for r in found.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found.collect()})


def test_shared_fingerprints_are_told_apart(spark, tmp_path):
    """With a fingerprint of four values nearly every chunk clashes; the contents still decide."""
    rows = [*cases(), *((100 + i, f"{i % 40} " * 3000) for i in range(80))]
    docs = stored(documents(spark, rows), tmp_path)
    found = exact_duplicates(docs, hash_of=lambda content: bytes([len(content) % 4]))
    assert got(found) == plain(rows)


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    body = rng.integers(33, 127, 60_000).astype(np.uint8)
    edges, first = cut_points(np.concatenate([body, body[500:], body]), np.array([0, 60_000, 119_500, 179_500]))
    one, two, three = (set((edges[a : b + 1] - edges[a]).tolist()) for a, b in zip(first[:-1], first[1:]))
    assert one == three
    shared = {e + 500 for e in two} & one
    assert len(shared) > 0.9 * len(two) and len(one) > 20
    assert not IS_SPACE[body].any()


def test_empty_table_and_kept_rows(spark, tmp_path):
    empty = stored(documents(spark, []), tmp_path, "empty")
    assert exact_duplicates(empty).collect() == []
    docs = stored(clashing(documents(spark, cases())), tmp_path)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len({x[3] for x in plain(cases())})
    assert chunk_recipes(empty).count() == 0
