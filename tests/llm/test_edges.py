"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and further columns with clashing names."""

import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ann, common, language, lines, neardup_vectors, packing, quality, queries, records, sampling, secrets, simhash, tokens

LONG = "word " * 60_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "no id here, password = hunter2hunter2"),
    (None, None),
    (6, LONG),
    (7, "a\0b 日本語 ퟿ é ▁x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "k", "n", 1, [1]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, nth string, count int, drop array<int>")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (4, 0, 0), (None, 1, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


PATH = queries.tokenizer_path("piece_bpe_32k.model")


def test_quality(odd, none, labels):
    r = quality.scored(odd, labels).collect()
    assert len(r) == len(TEXTS)
    assert all((x.n_features == 0) == (x.weight is None) for x in r)
    assert not any(x.kept for x in r if x.weight is None)
    assert quality.selected(odd, labels.filter("false")).columns == odd.columns
    assert quality.selected(odd, labels.filter("false")).count() == sum(bool((t or "").strip()) for _, t in TEXTS)
    assert quality.selected(none, labels).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 200)] + [7, 7, -7, 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 50, 103, 206):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    x = np.array([-2.0, -1.5, -0.0, 0.0, 1e-300, 3.0])
    assert (np.diff(quality.sortable(x)) >= 0).all()


def test_secrets(odd, none):
    r = secrets.scan(odd).collect()
    assert len(r) == len(TEXTS)
    assert [x.found["assign"] for x in r if x.doc_id is None and any(x.found.values())] == [[(14, 39)]] or sum(bool(x.found["assign"]) for x in r) == 1
    out = secrets.redacted(odd)
    assert out.columns == odd.columns
    assert Counter(x.text for x in out.collect())["no id here, [SECRET]"] == 1
    assert out.filter("text is null").count() == 2
    assert secrets.scan(none).count() == secrets.redacted(none).count() == 0


@pytest.mark.parametrize("rule", secrets.BASE + secrets.MORE)
def test_trigrams_never_miss(rule):
    samples = {
        "assign": ["PassWord='abcdef", "api_key: abcdefg", "APIKEY=zzzzzz", "passwd:aaaaaa", "Secret = aaaaaa", "token=aaaaaa"],
        "access": ["AKIA" + "A" * 16],
        "hex": ["f" * 24],
        "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY BLOCK-----"],
        "repository_token": ["gh%s_" % c + "a" * 36 for c in "pousr"],
        "chat_token": ["xox%s-0123456789" % c for c in "abprs"],
        "web_token": ["eyJabcdefgh.eyJabcdefgh.x"],
    }[rule.kind]
    query = secrets.trigram_query(rule)
    assert (query is True) == (rule.kind == "hex")

    def holds(q, text):
        return True if q is True else q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(p, text) for p in q[1])

    assert all(holds(query, s.lower()) for s in samples)
    assert rule.kind == "hex" or not holds(query, "the quick brown fox")


def test_records(odd, none, tmp_path):
    path, files = records.write_records(odd, queries.byte_bpe, 2, 50_257, f"file://{tmp_path}/r")
    r = records.read_records(path, files).orderBy("start").collect()
    assert [x.doc_id for x in r] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [x.n_tokens for x in r if x.doc_id in (3, 4)] == [1, 1]
    part = next(p for p in (tmp_path / "r").iterdir() if p.suffix == ".records" and p.stat().st_size)
    data = bytearray(part.read_bytes())
    data[-6] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="wrong checksum"):
        records.read_records(path, files).collect()
    path, files = records.write_records(none, queries.byte_bpe, 2, 50_257, f"file://{tmp_path}/e")
    assert records.read_records(path, files).count() == 0


def test_frames():
    for narrow in (True, False):
        ids = np.array([1, 2, 60_000], np.uint32)
        framed = records.frame(records.serialize(-5, ids, narrow)[0])
        payload, end = records.unframe(b"xx" + framed, 2)
        assert end == len(framed) + 2
        assert records.deserialize(payload)[0] == -5
        assert records.deserialize(payload)[1].tolist() == ids.tolist()
    with pytest.raises(ValueError, match="cut short"):
        records.unframe(framed[:5])


@pytest.mark.parametrize(("name", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, space, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 20)
    monkeypatch.setattr(tokens, "AT_ONCE", 4000)
    e = tokens.Encoder(queries.tokenizer_path(name), space)
    texts = ["", " ", "  ", " a", "a ", "a  b\n\n c", "it's \n\n b", "\n a\n", "x \n\nb", "<|endoftext|> hi", "é ẞ İ don't 12 34's", "a\tb \tc\r\n d", "日本語 テスト", "\0 \1", "ab_c. _d's (x),','", "x² ½µ ªz", "a \n\nb c", "русскaб c", *[" ".join(f"w{i * k}q$$" for i in range(40)) for k in range(9)]]
    for batch in (texts, *[[t] for t in texts]):
        assert [x.tolist() for x in e(batch)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "x") for i, v, g in rows], "vec_id long, embedding array<float>, label int, key string")


ODD_VECTORS = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.99, 0.01], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (None, [1.0, 0.0], 1)]


def test_ann(spark):
    df = vectors(spark, ODD_VECTORS)
    r = ann.nearest(df, df.vec_id < 4, k=3).collect()
    by = {q: [(x["rank"], x.vec_id) for x in sorted(r, key=lambda x: x["rank"]) if x.query_id == q] for q in (1, 3)}
    assert by == {1: [(1, 2), (2, 2), (3, 9)], 3: [(1, 1), (2, 2), (3, 2)]}
    assert ann.nearest(df.filter("false"), df.vec_id < 4).count() == 0


def test_quantiser():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 9))
    q = ann.Quantiser(9).fit(x)
    codes = q.encode(x)
    exact = q.tables(x[:5]).astype(float)
    want = exact[:, np.arange(q.m), codes].sum(-1)
    assert np.allclose(ann.scan(q.tables(x[:5]), ann.packed(codes)), want, atol=1e-4)


def test_embedding_neardup(spark):
    r = neardup_vectors.near_duplicates(vectors(spark, ODD_VECTORS)).collect()
    assert len(r) == len(ODD_VECTORS)
    got = sorted((x.vec_id or 0, x.n_links, x.component_id) for x in r)
    assert got[:5] == [(0, 4, 1), (1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 4, 1)]
    assert all(n == 0 and c == i for i, n, c in got[5:])
    assert neardup_vectors.near_duplicates(vectors(spark, ODD_VECTORS).filter("false")).count() == 0


def test_simhash(odd, none):
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == len(TEXTS)
    assert {x.component_id for x in r if x.doc_id in (1, 2)} == {1}
    assert {x.component_id for x in r if x.doc_id in (3, 4, 5)} == {3}
    out = simhash.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(x.doc_id or 0 for x in out.collect()) == [0, 1, 3, 6, 7]
    assert simhash.deduplicated(none).count() == 0


def test_near_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    flip = lambda n: sum((np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(n))
    fp = np.concatenate([base, base ^ flip(2), base ^ flip(5), base])
    rng.shuffle(fp)
    bounds = np.array([0, 1, 3, 64, 65, 130, 400, 600])
    for radius in (0, 1, 3, 4, 6, 7, 8):
        i, j = simhash.near_pairs(fp, bounds, radius)
        want = {(a, b) for s, e in zip(bounds[:-1], bounds[1:], strict=True) for a in range(s, e) for b in range(a + 1, e) if int(fp[a] ^ fp[b]).bit_count() <= radius}
        assert len(i) == len(want)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_links_of_split_buckets(spark):
    rng = np.random.default_rng(2)
    fps = sorted({int(x) for x in np.int64(0x1234567890ABCDE) ^ (np.int64(1) << rng.integers(0, 60, 300)) ^ (np.int64(1) << rng.integers(0, 60, 300))})
    df = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    for chunk in (3, 10_000):
        found = common.connected_components(simhash.links(df, 2, chunk)).collect()
        up = list(range(len(fps)))
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    x, y = up[a], up[b]
                    up = [min(x, y) if u in (x, y) else u for u in up]
        got = {r.node: r.component for r in found}
        assert [got.get(k, k) for k in range(len(fps))] == up


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (300, 200), (7, 7)] + [(1000, 1000 + k) for k in range(1, 50)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100, **dict.fromkeys(range(1000, 1050), 1000)}
    assert common.connected_components(df.filter("false")).count() == 0


def test_lines(spark, odd, none):
    passage = "\n".join(f"line {k} of a passage that stands in several documents word for word" for k in range(9))
    rows = [(1, f"own start one\n{passage}\nown end one"), (2, f"x y z\nanother own start\n{passage}\nown end two"), (3, "x y z\nclean and\nshort"), (4, "x y z\nclean and\nshort, too"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", common.F.lit("k"))
    out = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[4] == rows[3][1]
    left = sum(line in out[2] for line in passage.split("\n"))
    assert left == 0
    assert out[2] == "x y z\nanother own start\nown end two" and out[None] == ""
    got = lines.deduplicated(odd)
    assert got.columns == odd.columns
    assert Counter(r.text for r in got.collect()) == Counter(t for _, t in TEXTS)
    assert lines.deduplicated(none).count() == 0


def test_packing(odd, none):
    p = packing.pieces(odd, queries.word_bpe, 1, 64)
    r = packing.pack(p, 64).collect()
    assert sum(x.doc_id == 6 for x in r) == math.ceil(60_001 / 64)
    assert [x.length for x in r if x.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack(packing.pieces(none, queries.word_bpe, 1, 64), 64).count() == 0


def test_best_two_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500):
        lengths = rng.integers(1, 101, n)
        out = packing.best_two_fit(lengths, 100)
        assert Counter(x for s in out for x in s) == Counter(lengths.tolist())
        assert all(0 < sum(s) <= 100 for s in out)
    # 60 + 30 leaves 10; 30 gives way to 25 + 15, which fill the gap.
    assert [sorted(s) for s in packing.best_two_fit(np.array([60, 30, 25, 15]), 100)] == [[15, 25, 60], [30]]


def test_language(odd, none):
    model = language.train(odd)
    r = language.predict(odd, model).collect()
    assert len(r) == len(TEXTS)
    assert {x.lang_pred for x in r if x.doc_id in (3, 4, 5)} == {"und"}
    assert {x.lang_pred for x in r if x.doc_id in (1, 2, 6)} == {"en"}
    assert {x.lang_pred for x in language.predict(odd, {}).collect()} == {"und"}
    assert language.train(none) == {}
    assert language.predict(none, model).count() == 0


def test_mixture(spark):
    a, b = "alpha beta gamma delta ", "zorro yxwvu qoqoq zyzzy "
    model = language.train(spark.createDataFrame([(a * 30, "a"), (b * 30, "b")], "text string, lang string"))
    df = spark.createDataFrame([(1, a * 20), (2, b * 20), (3, a * 30 + b * 10)], "doc_id long, text string")
    r = {x.doc_id: x for x in language.predict(df, model).collect()}
    assert (r[1].lang_pred, r[1].score) == ("a", 1.0)
    assert (r[2].lang_pred, r[2].score) == ("b", 1.0)
    assert r[3].lang_pred == "a" and abs(r[3].score - 0.75) < 0.02 and len(r[3].langs) == 2


def test_sampling(odd, none):
    r = sampling.encode(odd, PATH, k=3).collect()
    assert {x.doc_id for x in r if x.n_tokens == 0} == {None, 3, 4}
    assert all(x.decoded for x in r if x.doc_id != 7)
    per = {}
    for x in r:
        per.setdefault(x.doc_id, []).append((x.sample, tuple(x.ids), x.perturbed))
    assert sampling.encode(none, PATH).count() == 0
    assert len(set(i for _, i, _ in per[6])) == 3


def test_sampling_is_exact():
    """First samples are distributed as the model says, and inverse inclusion weights add up to one."""
    n, k, first, weights = 3000, 2, Counter(), []
    p = {}
    for _, found in sampling.samples(["thin"] * n, sampling.row_keys(list(range(n)), 5), PATH, k):
        assert len({tuple(x[0].tolist()) for x in found}) == len(found) == k
        assert found[0][2] >= found[1][2]
        first[tuple(found[0][0].tolist())] += 1
        weights.append(sum(math.exp(x[1]) / x[3] for x in found))
        p |= {tuple(x[0].tolist()): math.exp(x[1]) for x in found}
    assert abs(np.mean(weights) - 1) < 0.02
    for s, q in p.items():
        assert abs(first[s] / n - q) < 5 * math.sqrt(q / n) + 1e-3
    v = sampling.vocabulary(PATH)
    ids = [np.array(x, np.int64) for x in ([], [i for i, b in enumerate(v.bytes) if b == b" th"], [v.byte_ids[0xE2], v.byte_ids[0x82], v.byte_ids[0xAC]])]
    assert v.decoded(ids) == [b"", b" th", "€".encode()]
    assert [v.decode(x.tolist()) for x in ids] == ["", "th", "€"]
    few = sampling.sample_batch(sampling.vocabulary(PATH), ["a"], [1], 5)[0]
    assert 1 <= len(few) < 5 and abs(sum(math.exp(x[1]) for x in few) - 1) < 1e-6
    assert all(x[3] == 1 for x in few)
