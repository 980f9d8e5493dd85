import itertools
import random

import numpy as np
import pyarrow as pa
from helpers import ODD_TEXTS, clashing, stored, words

from normtext.llm import toxic_crf
from normtext.llm.toxic_crf import ToxicModel, forward_backward, gradient, marginals, score_toxicity, token_features


def random_case(seed, sizes=(3, 0, 5, 1)):
    rng = np.random.default_rng(seed)
    first = np.concatenate(([0], np.cumsum(sizes)))
    buckets = rng.integers(0, 12, (first[-1], toxic_crf._WIDTH)).astype(np.int32)
    model = ToxicModel(rng.normal(0, 1, 13), rng.normal(0, 1, (2, 2)), np.zeros(3))
    return buckets, first, rng.integers(0, 2, first[-1]).astype(float), model


def weight(tags, buckets, model):
    total = sum(model.weights[buckets[i]].sum() + model.weights[-1] for i, t in enumerate(tags) if t)
    return np.exp(total + sum(model.steps[a, b] for a, b in zip(tags, tags[1:])))


def test_marginals_match_enumeration():
    for seed in range(10):
        buckets, first, _, model = random_case(seed)
        found = marginals(buckets, first, model)
        for a, b in zip(first, first[1:]):
            all_tags = list(itertools.product((0, 1), repeat=b - a))
            weights = np.array([weight(t, buckets[a:b], model) for t in all_tags])
            for i in range(b - a):
                want = sum(w for t, w in zip(all_tags, weights) if t[i]) / weights.sum()
                assert abs(found[a + i] - want) < 1e-9


def test_gradient_matches_differences():
    buckets, first, labels, model = random_case(3)

    def likelihood(weights, steps):
        m, total = ToxicModel(weights, steps, None), 0.0
        for a, b in zip(first, first[1:]):
            if b > a:
                every = sum(weight(t, buckets[a:b], m) for t in itertools.product((0, 1), repeat=b - a))
                total += np.log(weight([int(x) for x in labels[a:b]], buckets[a:b], m) / every)
        return total

    found = gradient(buckets, labels, first, model)
    for k in range(17):
        up, steps = model.weights.copy(), model.steps.copy()
        (up if k < 13 else steps.ravel())[k if k < 13 else k - 13] += 1e-6
        assert abs((likelihood(up, steps) - likelihood(model.weights, model.steps)) / 1e-6 - found[k]) < 1e-3


def test_long_texts_stay_finite():
    first = np.array([0, 60_000, 60_001])
    ahead, back = forward_backward(np.full(60_001, 1e12), first, np.zeros((2, 2)))
    assert np.isfinite(ahead).all() and np.isfinite(back).all()


def corpus(n=500):
    rng, bad = random.Random(8), "grumf snarl blarg zorch"
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = words(rng, rng.randrange(20, 60), 300).split()
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice([*bad.split(), f"vexo{rng.randrange(99)}", "Vexo" + rng.choice("äöü")]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(10_000 + i, t) for i, t in enumerate([*ODD_TEXTS, "123 !!"])] + [(None, rows[0][1]), (0, rows[0][1])]
    return rows, labels + [(7, 1, None), (None, 1, 1)]


def tables(spark, tmp_path, rows, labels):
    docs = stored(clashing(spark.createDataFrame(rows, "doc_id long, text string")), tmp_path, "docs")
    return docs, stored(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")


def test_held_out_accuracy_and_spans(spark, tmp_path):
    rows, labels = corpus()
    found = score_toxicity(*tables(spark, tmp_path, rows, labels)).collect()
    assert len(found) == len(rows)
    told, text = {i: t for i, _, t in labels if i is not None and t is not None}, dict(rows)
    held = [r for r in found if r.held_out and r.doc_id in told]
    assert len(held) > 80 and sum(r.predicted == told[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    for r in held:
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert any(x in text[r.doc_id][a:b].lower() for x in ("grumf", "snarl", "blarg", "zorch", "vex"))
    assert not any(r.predicted for r in found if (r.doc_id or 0) >= 10_000)


def test_without_labels(spark, tmp_path):
    rows, labels = corpus(12)
    docs, none = tables(spark, tmp_path, rows, [(None, 1, None)])
    assert {r.predicted for r in score_toxicity(docs, none).collect()} == {0}
    docs, one = tables(spark, tmp_path / "one", rows, [(i, 1, 1) for i in range(12)])
    assert {r.predicted for r in score_toxicity(docs, one).collect()} == {1}
    empty, some = tables(spark, tmp_path / "empty", [], labels)
    assert score_toxicity(empty, some).collect() == []


def test_tokens_fold_case_and_keep_places():
    texts = pa.array(["ÉCOLE École école", None, "", "x1y"])
    buckets, first, begin, end = token_features(texts)
    assert first.tolist() == [0, 3, 3, 3, 5]
    assert (buckets[0] == buckets[1]).all() and (buckets[1] == buckets[2]).all()
    assert (end - begin)[:3].tolist() == [6, 6, 6]


def test_few_gradients_reach_the_driver(spark):
    rng = np.random.default_rng(5)
    rows, sums = [], []
    model = ToxicModel(rng.normal(size=(1 << toxic_crf.FEATURE_BITS) + 1) / 10, rng.normal(size=(2, 2)) / 10, np.zeros(3))
    for i in range(40):
        n = int(rng.integers(0, 30))
        buckets = rng.integers(0, 1 << toxic_crf.FEATURE_BITS, (n, 1 + len(toxic_crf.PREFIXES))).astype(np.int32)
        labels = rng.integers(0, 2, n).astype(bool)
        rows.append((i % 2, buckets.tobytes(), labels.tobytes()))
        sums.append(gradient(buckets, labels.astype(float), np.array([0, n]), model))
    tokens = spark.createDataFrame(rows, "toxic int, features binary, labels binary").repartition(30)
    parts = toxic_crf.gradient_parts(tokens, model).collect()
    assert len(parts) <= toxic_crf.FIT_TASKS
    assert sum(len(p["at"]) + len(p["gradient"]) for p in parts) < 12 * 40 * 30 * 4 + 1000
    assert np.allclose(toxic_crf.slope(tokens, model), np.sum(sums, axis=0))
