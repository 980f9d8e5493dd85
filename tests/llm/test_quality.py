import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, stored, words

from normtext.llm import site_quality as q


def corpus(n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        host = "hot.org" if i % 3 else f"h{i % 10}.org"
        good = rng.random() < (0.9 if host == "hot.org" else 0.5 if host in ("h1.org", "h3.org") else 0.8)
        text = words(rng, 40) if good else " ".join(w.upper() + "!!" for w in words(rng, 20).split() for _ in range(3))
        rows.append((i, text, host, f"/{i % 4}"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000 + i, t, None, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "hot.org", None), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows, labels


def judged(spark, tmp_path, rows, labels):
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), tmp_path)
    told = stored(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    return q.site_quality(q.measure(docs, ["doc_id", "host", "path"]), told).collect()


def strength(groups):
    """The operator's moment estimate over (good, n, centre)."""
    groups = [g for g in groups if g[1] >= 2]
    squares = sum(n * (good / n - c) ** 2 for good, n, c in groups)
    chance = sum(c * (1 - c) for _, _, c in groups)
    weight = sum((n - 1) * c * (1 - c) for _, n, c in groups)
    between = (squares - chance) / weight if weight else 0
    return min(max(1 / between - 1, 1.0), q.MOST_STRENGTH) if between > 1 / q.MOST_STRENGTH else q.MOST_STRENGTH


def test_posteriors_match_plain(spark, tmp_path):
    rows, labels = corpus()
    found = judged(spark, tmp_path, rows, labels)
    assert len(found) == len(rows)
    told = {i: y for i, y, _ in labels}
    good = [float(told.get(r.doc_id, r.p_text)) for r in found]
    host, path = {}, {}
    for r, g in zip(found, good):
        for sums, key in ((host, r.host), (path, (r.host, r.path))):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = (n + 1, s + g)
    prior = sum(good) / len(good)
    k = strength([(s, n, prior) for n, s in host.values()])
    share = {h: (s + k * prior) / (n + k) for h, (n, s) in host.items()}
    kp = strength([(s, n, share[h]) for (h, _), (n, s) in path.items()])
    for r, g in zip(found, good):
        n, s = host[r.host]
        p_host = (s - g + k * prior) / (n - 1 + k)
        n, s = path[r.host, r.path]
        p_path = (s - g + kp * p_host) / (n - 1 + kp)
        assert r.p_host == pytest.approx(p_host, rel=1e-9) and r.p_path == pytest.approx(p_path, rel=1e-9)
        odds = [min(max(p, 1e-6), 1 - 1e-6) for p in (r.p_text, p_path)]
        total = sum(np.log(p / (1 - p)) for p in odds) - np.log(prior / (1 - prior))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9) and r.kept == (r.score >= q.KEEP)
    right = [r.kept == bool(told[r.doc_id]) for r in found if r.doc_id in told]
    assert sum(right) / len(right) > 0.97


def test_measures_match_plain():
    texts = ["Ab cd cd!", "A | B | B", None, "", "ü ü ü x", "  one"]
    found = q.text_measures(pa.array(texts))
    for row, text in zip(found, texts):
        data, parts = (text or "").encode(), (text or "").split()
        size = max(len(data), 1)
        assert row[0] == pytest.approx(np.log1p(len(data)))
        assert row[1] == pytest.approx(sum(65 <= c < 91 for c in data) / size)
        assert row[3] == pytest.approx(sum(c >= 128 or chr(c).isalpha() for c in data) / size)
        assert row[4] == pytest.approx(sum(a == b for a, b in zip(parts, parts[1:])) / max(len(parts) - 1, 1))
        assert row[5] == pytest.approx(len(set(parts)) / np.sqrt(len(parts)) if parts else 0)


def test_without_labels_and_rows(spark, tmp_path):
    rows, labels = corpus(20)
    assert len(judged(spark, tmp_path / "a", rows, [])) == len(rows)
    assert all(r.kept for r in judged(spark, tmp_path / "b", rows, [(i, 1, 0) for i in range(20)]))
    assert judged(spark, tmp_path / "c", [], labels) == []
