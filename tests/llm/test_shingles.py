"""The pipeline's near-duplicates against all pairs of shingle sets."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from millrace.llm import shingles


def shingle_set(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies(spark, monkeypatch):
    rng, texts = random.Random(3), []
    for _ in range(120):
        own = [f"{rng.randrange(1 << 30):x}" for _ in range(100)]
        texts.append(" ".join(own))
        for _ in range(rng.randrange(1, 4)):
            copy = list(own)
            for k in rng.sample(range(100), rng.choice((1, 2, 2, 3))):
                copy[k] = f"{rng.randrange(1 << 30):x}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))
    close = 0
    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                close += both < 0.85 * (len(sets[i]) + len(sets[j]) - both)
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    assert close > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, x in enumerate(up) if i == x}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want
    # Groups that are compared part by part.
    monkeypatch.setattr(shingles, "CHUNK", 1)
    got = shingles.near_duplicates(docs, 5, 6, 0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(up))


def test_classes_equal_brute_force(spark):
    """All pairs of a whole table by their sets: no link missed, none wrong."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, words=5, radius=6, least=0.8).collect()}
    sets = {r.doc_id: frozenset(shingles.shingles(r.text, 5).tolist()) for r in docs.collect()}
    ids, up = sorted(sets), {i: i for i in sets}
    holders, shared = defaultdict(list), Counter()
    for i in ids:
        met = Counter(j for s in sets[i] for j in holders[s])
        shared.update({(j, i): n for j, n in met.items()})
        for s in sets[i]:
            holders[s].append(i)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    empty = [i for i in ids if not sets[i]]
    links = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + [(empty[0], i) for i in empty[1:]]
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert len(links) > 20
    assert got == {i: find(i) for i in ids}
