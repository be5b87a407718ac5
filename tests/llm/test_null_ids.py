"""Rows without an id link like any other: what they join stays one component, and ids come back as they were."""

import math

import numpy as np

from millrace.llm import neardup_vectors, shingles, simhash

BIG = 2**53 + 1


def test_vectors(spark):
    turn = lambda t: [math.cos(t), math.sin(t), 0.0]
    rows = [(BIG + 2, turn(0.0)), (None, turn(0.3)), (BIG, turn(0.6)), (7, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, -1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(df).collect()), key=str)
    want = [(BIG + 2, 1, BIG, False), (None, 2, BIG, False), (BIG, 1, BIG, True), (7, 0, 7, True), (None, 0, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)


def test_tables_miss_few(spark):
    rng = np.random.default_rng(3)
    tables, projections = neardup_vectors.tables_for(10_000, 0.93)
    hashes = neardup_vectors.Hashes(64, 0.93, tables, projections, 0)
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    a = unit(rng.normal(size=(3000, 64)))
    other = rng.normal(size=(3000, 64))
    other = unit(other - (other * a).sum(1)[:, None] * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * other
    assert (hashes(a) == hashes(b)).any(axis=1).mean() >= 0.999
    assert (hashes(a) == hashes(other)).any(axis=1).mean() <= 0.1


def test_fingerprints(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, 0), (None, 0, 0xF), (2, 0, 0xFF), (5, 0, -1), (None, 0, 1 << 40 | -1 << 50)], "doc_id long, text_hash long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: rows)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(rows, radius=4).collect()}
    assert got == {(1, 0): 1, (None, 0xF): 1, (2, 0xFF): 1, (5, -1): 5, (None, 1 << 40 | -1 << 50): None}


def test_shingles(spark):
    words = [f"w{k}" for k in range(200)]
    near = lambda a, b: " ".join([*words[:a], "x", *words[a + 1 : b], "y", *words[b + 1 :]])
    rows = [(BIG, " ".join(words)), (None, near(50, 150)), (3, near(150, 151)), (4, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df, words=5, radius=6, least=0.8).collect()}
    assert got == {BIG: 3, None: 3, 3: 3, 4: 4}
