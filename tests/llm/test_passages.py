"""Planted passages that repeat: found whole, whatever lines surround them."""

import itertools
import random

from millrace.llm import lines


def repeated(docs):
    """Lines with words of the later copies of every run of LEAST_LINES lines and LEAST_WORDS words or more, by brute force."""
    seen, gone = set(), set()
    for i, own in enumerate(docs):
        for a, b in sorted(itertools.combinations(range(len(own) + 1), 2)):
            if b - a >= lines.LEAST_LINES and len(" ".join(own[a:b]).split()) >= lines.LEAST_WORDS:
                run = tuple(own[a:b])
                gone |= {(i, k) for k in range(a, b) if run in seen and own[k]}
                seen.add(run)
    return gone


def planted(shapes, trials):
    rng, docs, where = random.Random(5), [], []
    word = lambda: f"{rng.randrange(1 << 40):x}"
    own = lambda n: [" ".join(word() for _ in range(12)) for _ in range(n)]
    for n, words in shapes:
        for t in range(trials):
            passage = [" ".join(word() for _ in range(words)) for _ in range(n)]
            for k in range(2):
                head = own((t + 3 * k) % 7)
                where.append((len(docs), len(head), n) if k else None)
                docs.append([*head, *passage, *own(rng.randrange(4))])
    return docs, [w for w in where if w]


def removed(spark, docs):
    rows = [(i, "\n".join(own)) for i, own in enumerate(docs)]
    out = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), dropped="gone").collect()
    return {(r.doc_id, k) for r in out for x in r.gone for k in range(x["begin"], x["end"])}


def test_few_long_lines(spark):
    docs, where = planted([(2, 26), (3, 17), (4, 13), (5, 11), (6, 9), (2, 39)], 21)
    got = removed(spark, docs)
    assert got == repeated(docs)
    assert got == {(i, a + k) for i, a, n in where for k in range(n)}


def test_many_short_lines(spark):
    docs, where = planted([(60, 1), (30, 2), (20, 3), (300, 1), (13, 4)], 7)
    got = removed(spark, docs)
    assert got == {(i, a + k) for i, a, n in where for k in range(n)}


def test_runs():
    rng = random.Random(6)
    for _ in range(300):
        own = [b" ".join([b"w"] * rng.choice((0, 1, 2, 7, 12, 41))) for _ in range(rng.randrange(9))]
        own_runs = list(zip(*(x.tolist() for x in lines.runs(own)), strict=True))
        for a, b in own_runs:
            assert b - a == 1 and len(own[a].split()) >= lines.LONG_LINE or b - a >= lines.LEAST_LINES and sum(len(x.split()) for x in own[a:b]) >= lines.LEAST_WORDS
        for a, b in itertools.combinations(range(len(own) + 1), 2):
            if b - a >= lines.LEAST_LINES and sum(len(x.split()) for x in own[a:b]) >= lines.LEAST_WORDS:
                covered = {k for c, d in own_runs if a <= c and d <= b for k in range(c, d)}
                assert {k for k in range(a, b) if own[k]} <= covered
