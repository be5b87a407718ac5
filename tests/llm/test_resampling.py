"""Importance resampling against a plain version, and inclusion rates against the weights."""

import math
from collections import Counter

import numpy as np

from millrace.llm import quality
from millrace.llm.ngrams import word_ngrams


def features(text):
    return [int(b) for _, _, buckets, _ in word_ngrams([text], quality.BUCKETS) for b in buckets]


def test_weights_and_top_k(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    text = lambda lean, n: " ".join(words[int(x)] for x in np.minimum(299, rng.exponential(20 + lean, n)))
    docs = {i: text(i % 3 == 0, int(rng.integers(1, 200))) for i in range(240)} | {900: None, 901: " "}
    labels = [(i, int(i % 3 == 0), 0) for i in range(120)]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scored(df, marks, k=100).collect()}
    # Which labelled documents fit the model is the operator's choice, by a hash; all else is done again here.
    order = {r.doc_id: r.h for r in marks.selectExpr("doc_id", "pmod(xxhash64(doc_id), 8) as h").collect()}
    fitted = [i for i, q, _ in labels if q and order[i]]
    raw = Counter(b for t in docs.values() for b in features(t))
    target = Counter(b for i in fitted for b in features(docs[i]))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    smooth = max(1.0, 0.01 * n_target)

    def log_ratio(b):
        p = (raw[b] + 0.5) / (n_raw + 0.5 * quality.BUCKETS)
        return math.log((target[b] + smooth * p) / (n_target + smooth)) - math.log(p)

    keys = {}
    for i, t in docs.items():
        own = features(t)
        if not own:
            assert got[i].weight is None and not got[i].kept
            continue
        weight = quality.LENGTH * sum(map(log_ratio, own)) / (len(own) + quality.PRIOR)
        assert math.isclose(got[i].weight, weight, rel_tol=1e-9, abs_tol=1e-9)
        keys[i] = weight + float(quality.gumbel(np.array([i]), 0)[0])
    kept = set(sorted(keys, key=keys.get)[-100:])
    assert {i for i, r in got.items() if r.kept} == kept
    # The noise decides: the sample isn't the documents of largest weight, nor the same with another seed.
    assert kept != set(sorted(keys, key=lambda i: got[i].weight)[-100:])
    assert {r.doc_id for r in quality.scored(df, marks, seed=1, k=100).collect() if r.kept} != kept


def test_inclusion_follows_the_weights():
    """One draw of the largest key takes each document in proportion to exp(weight)."""
    weight = np.array([0.0, 0.5, 1.0, 2.0, -1.0])
    drawn = np.bincount([np.argmax(weight + quality.gumbel(np.arange(5), seed)) for seed in range(8000)], minlength=5) / 8000
    assert np.abs(drawn - np.exp(weight) / np.exp(weight).sum()).max() < 0.02
