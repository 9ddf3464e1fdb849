"""Counterfactual pairs of long texts, and pairs by their differences."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import toxicity

TERMS = ("alpha", "beta", "gamma", "delta", "epsilon")


def test_all_pairs_of_a_long_text(spark):
    text = " ".join(f"Some {TERMS[k % 5]} of number {k} is here." for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, "no such thing"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    seeds = {r.doc_id: r.h & 0xFFFF for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h")).collect()}
    want = sum(len(toxicity.counterfactuals(t or "", TERMS, seeds[k])) for k, t in ((1, text), (2, "no such thing"), (3, None)))
    assert want > 300
    sample, pairs, counts = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 100, TERMS)
    assert len(sample) == 3 and counts.sum() == want and len(pairs) <= 25


def test_fit_by_differences_equals_fit_by_whole_pairs():
    rng = np.random.default_rng(1)
    rows, pairs, found = [], [], {}
    for k in range(300):
        toxic = k % 3 == 0
        words = {f"w{x}" for x in rng.integers(0, 30, 6)} | ({"vile", TERMS[k % 2]} if toxic else {TERMS[2 + k % 3]} if k % 2 else set())
        rows.append((toxicity.text_features(words), int(toxic)))
        for a, b in toxicity.counterfactuals(" ".join(sorted(words)), TERMS, k):
            pairs.append((toxicity.text_features(a), toxicity.text_features(b)))
            d = toxicity.difference(a, b)
            found[d] = found.get(d, 0) + 1
    whole = toxicity.fit_rows(rows, pairs)
    short = toxicity.fit_rows(rows, [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in found], counts=np.array(list(found.values()), float))
    assert len(found) < len(pairs) and np.abs(whole.weights).max() > 0.5
    assert np.allclose(whole.weights, short.weights, atol=1e-6) and abs(whole.intercept - short.intercept) < 1e-6
    assert not np.allclose(whole.weights, toxicity.fit_rows(rows, []).weights, atol=1e-2)


def test_intersections_are_exact():
    import numpy as np

    from graphloom.llm.minhash import intersections

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (0, 1, 5, 700, 2500, 2500, 64)] + [pool[:0], np.array([0, (1 << 64) - 1], np.uint64), np.sort(pool)]
    true = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for part in (1, 97, 1 << 17):  # many ranges, or one
        assert (intersections(sets, part=part) == true)[~np.eye(len(sets), dtype=bool)].all()
        assert (intersections(sets[:4], sets[4:], part) == true[:4, 4:]).all()
    assert intersections([pool[:0]], [pool[:0]]).tolist() == [[0]]
