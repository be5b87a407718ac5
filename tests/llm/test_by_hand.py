"""Language mixtures and sampled segmentations against plain versions that enumerate and iterate."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from millrace.llm import language, sampling
from millrace.llm.ngrams import STEP, mix

PATH = path("piece_bpe_32k.model")


def buckets(word):
    """Buckets of a word's n-grams, a list a length."""
    data, size = b"\0" + word.encode() + b"\0", language.BUCKETS // len(language.SIZES)
    out = []
    for row, n in enumerate(language.SIZES):
        own = []
        for k in range(len(data) - n + 1):
            h = 0
            for b in data[k : k + n]:
                h = (h * STEP + b + 1) % 2**64
            own.append(int(mix(np.array([h], np.uint64))[0]) % size + row * size)
        out.append(own)
    return out


def mixture(text, table):
    """Shares and chosen set of one text, word by word."""
    words = re.findall("[a-z\x80-\U0010ffff]+", text.lower())
    n = len(table)
    like = [[sum(float(table[j][b]) for own in buckets(w) for b in own) for j in range(n)] for w in words]

    def em(allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(n)]
        for _ in range(language.ROUNDS):
            total = [0.0] * n
            for own in like:
                top = max(own)
                r = [share[j] * math.exp(own[j] - top) for j in range(n)]
                for j in range(n):
                    total[j] += r[j] / (sum(r) + 1e-300)
            share = [x / len(like) for x in total]
        return share, sum(math.log(sum(share[j] * math.exp(own[j] - max(own)) for j in range(n)) + 1e-300) + max(own) for own in like)

    penalty = language.PENALTY * math.log(len(words) + 1)
    single = [sum(own[j] for own in like) for j in range(n)]
    best, score = [float(j == int(np.argmax(single))) for j in range(n)], max(single) - penalty
    full, _ = em(range(n))
    order = sorted(range(n), key=lambda j: -full[j])
    for k in range(2, n + 1):
        share, total = em(order[:k])
        if total - k * penalty > score:
            best, score = share, total - k * penalty
    return best


def test_mixtures(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)
    table = np.array([model[k] for k in sorted(model)], np.float32)
    texts = [t for (t,) in duck.execute("select text from documents where lang is not null order by length(text) limit 60").fetchall() if re.search("[a-z]", t.lower())]
    texts += [f"{a} {b} {a}" for a, b in zip(texts[:20], reversed(texts), strict=False)]
    got = language.mixtures(texts, table)
    for t, own in zip(texts, got, strict=True):
        assert np.allclose(own, mixture(t, table), atol=2e-3), t
    assert sum((own > 0).sum() > 1 for own in got) >= 3


@pytest.fixture(scope="module")
def pieces():
    p = SentencePieceProcessor(model_file=PATH)
    kept = [i for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    rank = {i: k for k, i in enumerate(sorted(kept, key=lambda i: (-p.get_score(i), i)))}
    return {p.id_to_piece(i): (i, 1 / (rank[i] + sampling.SMOOTH)) for i in kept}


def segmentations(word, pieces):
    """All ids and probabilities of a word whose characters are all pieces."""
    if not word:
        return {(): 1.0}
    out = {}
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            i, w = pieces[word[:k]]
            out |= {(i, *rest): w * q for rest, q in segmentations(word[k:], pieces).items()}
    return out


@pytest.mark.parametrize("text", ["thin", "on a", "abcab"])
def test_all_segmentations(pieces, text):
    want = segmentations("▁" + text.replace(" ", "▁"), pieces)
    total = sum(want.values())
    found = sampling.sample_batch(sampling.vocabulary(PATH), [text], [7], 10_000)[0]
    assert {tuple(ids.tolist()) for ids, *_ in found} == set(want)
    for ids, log_p, _, _ in found:
        assert math.isclose(math.exp(log_p), want[tuple(ids.tolist())] / total, rel_tol=1e-9)
    perturbed = [g for _, _, g, _ in found]
    assert perturbed == sorted(perturbed, reverse=True)


def test_top_k_is_without_replacement(pieces):
    """Ordered pairs of samples come with p(a) p(b) / (1 - p(a)), as an enumeration of the lattice says."""
    want, n = segmentations("▁thin", pieces), 6000
    total = sum(want.values())
    p = {s: q / total for s, q in want.items()}
    seen = Counter(tuple(tuple(x[0].tolist()) for x in found) for _, found in sampling.samples(["thin"] * n, sampling.row_keys(list(range(n)), 9), PATH, 2))
    for a, b in permutations(p, 2):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(seen[a, b] / n - q) < 5 * math.sqrt(q / n) + 1e-3
