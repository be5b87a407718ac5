"""Registered queries over whole small tables against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from millrace.llm import queries as Q


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.fixture(scope="module")
def vectors(duck):
    return {i: (label, np.array(v, np.float64)) for i, label, v in duck.execute("select vec_id, label, embedding from embeddings").fetchall()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_the_other_engine(spark, duck, sf, name):
    from compare import check

    assert check(spark, duck, Q.queries()[name], Q.oracle_sql()[name], sf) == ""


def run(spark, sf, name):
    return Q.queries()[name](spark, sf).toPandas()


def test_quality(spark):
    """On the 1,000 documents with some 400 labels: the smallest table has eleven labelled bad documents."""
    from compare import connect

    sf = "/root/testdata/sf0.01"
    r = run(spark, sf, "op1_quality").set_index("doc_id")
    labels = {i: (q, t) for i, q, t in connect(sf).execute("select * from labels").fetchall()}
    good = [i for i, x in labels.items() if x == (1, 0)]
    bad = [i for i, x in labels.items() if x[0] == 0]
    assert len(r) == 1000
    assert r.kept[good].mean() >= 0.98
    assert r.kept[bad].mean() <= 0.2


def spans(text):
    text, out = text or "", []
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
        ("hex", r"[0-9a-f]+", 0, 24, 0),
    ]
    for order, (kind, pattern, group, least, flags) in enumerate(rules):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark, sf, docs):
    r = run(spark, sf, "op2_secrets")
    assert len(r) == len(docs)
    for x in r.itertuples():
        want = spans(docs[x.doc_id])
        text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s[2] == k for s in want) for k in ("assign", "access", "hex"))
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(x.spans.split(","))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    r = run(spark, sf, "op3_records").sort_values("doc_id")
    start = 0
    assert r.doc_id.tolist() == sorted(docs)
    for x in r.itertuples():
        ids = [*t.encode(docs[x.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_ann(spark, sf, vectors):
    r = run(spark, sf, "op4_ann")
    ids = np.array(sorted(vectors))
    v = np.stack([vectors[i][1] for i in ids])
    hits = 0
    for q, own in r.groupby("query_id"):
        s = v @ vectors[q][1]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -np.round(s, 12)))[:20]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert q not in set(own.vec_id)
        assert np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        hits += len(set(ids[best]) & set(own.vec_id))
    assert r.query_id.nunique() == sum(i % 20 == 0 for i in ids)
    assert hits >= 0.9 * len(r)


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def embedding_classes(vectors, least):
    ids = sorted(vectors)
    pairs = []
    for i, a in enumerate(ids):
        for j in range(i):
            b = ids[j]
            x, y = vectors[a][1], vectors[b][1]
            if vectors[a][0] is not None and vectors[a][0] == vectors[b][0] and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                pairs.append((j, i))
    links = np.bincount(np.array(pairs, int).ravel(), minlength=len(ids))
    return {i: (int(n), ids[c]) for i, n, c in zip(ids, links, roots(len(ids), pairs), strict=True)}


def test_embedding_neardup(spark, sf, vectors):
    from millrace.llm.neardup_vectors import near_duplicates

    r = run(spark, sf, "op5_embedding_neardup")
    want = embedding_classes(vectors, 0.93)
    assert {x.vec_id: (x.n_links, x.component_id) for x in r.itertuples()} == want
    # Planted groups, and buckets that are split.
    rng = np.random.default_rng(0)
    few = {i: vectors[i] for i in sorted(vectors)[:20]}
    for k in range(60):
        base = vectors[k % 7]
        few[1000 + k] = (base[0], base[1] + rng.normal(0, 0.02, 64) * (k % 3))
    df = spark.createDataFrame([(i, v.tolist(), label) for i, (label, v) in few.items()], "vec_id long, embedding array<double>, label int")
    got = near_duplicates(df, chunk=4).toPandas()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got.itertuples()} == embedding_classes(few, 0.93)
    assert got.n_links.sum() > 100


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf, docs):
    r = run(spark, sf, "op6_simhash").sort_values("doc_id")
    ids = sorted(docs)
    fps = [fingerprint(docs[i]) for i in ids]
    assert r.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    pairs = [(j, i) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert r.component_id.tolist() == [ids[c] for c in roots(len(ids), pairs)]


def repeated_lines(docs):
    """Lines with words in later copies of a shortest run of two lines and 12 words or more, or of one line of 40 words."""
    seen, want = set(), {i: set() for i in docs}
    for i in sorted(docs):
        own = (docs[i] or "").split("\n")
        words = [len(x.encode().split()) for x in own]
        enough = lambda a, b: b - a >= 2 and sum(words[a:b]) >= 12
        found = {(k, k + 1) for k, w in enumerate(words) if w >= 40}
        for k in (k for k, w in enumerate(words) if w):
            found |= {(k, b) for b in range(k, len(own) + 1) if enough(k, b) and not enough(k, b - 1)}
            found |= {(a, k + 1) for a in range(k + 1) if enough(a, k + 1) and not enough(a + 1, k + 1)}
        for a, b in sorted(found):
            body = tuple(own[a:b])
            if body in seen:
                want[i] |= {k for k in range(a, b) if words[k]}
            seen.add(body)
    return want


def test_line_dedup(spark, sf, docs):
    from millrace.llm import lines

    r = run(spark, sf, "op7_line_dedup")
    want = repeated_lines(docs)
    for x in r.itertuples():
        ranges = [(y["begin"], y["end"]) for y in x.removed_lines]
        own = (docs[x.doc_id] or "").split("\n")
        assert {k for a, b in ranges for k in range(a, b) if own[k].split()} == want[x.doc_id]
        assert x.text == (lines.without(docs[x.doc_id], ranges) if ranges else docs[x.doc_id])
    assert any(want.values())


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    r = run(spark, sf, "op8_packing").sort_values(["doc_id", "piece"])
    want = []
    for i in sorted(docs):
        ids = [*t.encode(docs[i] or "", add_special_tokens=False).ids, 1]
        want += [(i, k, k * 4096, len(p), crc(p)) for k, p in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))]
    assert [tuple(x) for x in r[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)] == want
    for _, s in r.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 4096
    assert r.sequence_id.nunique() <= -(-r.length.sum() // 4096) + 1


def test_language(spark, sf, duck):
    r = run(spark, sf, "op9_language").set_index("doc_id")
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    for i in r.index:
        assert r.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = r[r.held_out]
    assert (held.lang_pred == held.index.map(lang)).mean() >= 0.97
    assert r.score.between(0, 1).all()


def test_sampling(spark, sf, docs):
    r = run(spark, sf, "op10_sampling")
    assert r.decoded.all()
    assert not r.duplicated(["doc_id", "ids_crc32", "n_tokens"]).any()
    assert (r.groupby("doc_id").size() == 2).all()
    assert r.inclusion.between(0, 1).all()
    again = run(spark, sf, "op10_sampling")
    key = ["doc_id", "sample"]
    assert r.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P
    from millrace.llm.common import table, written

    now = table(spark, sf, "documents")
    columns, before = now.columns, now.count()
    for _, stage in P.STAGES[:-1]:
        now = written(stage(spark, now, sf), "stage")
        assert now.columns == columns
        assert 0 < now.count() <= before
        before = now.count()
    texts = {r.doc_id: r.text for r in now.collect()}
    assert not any(spans(t) for t in texts.values())
    last = P.STAGES[-1][1](spark, now, sf).toPandas()
    assert set(last.doc_id) == set(texts)
    assert len(P.run(spark, sf).toPandas()) == len(last)
