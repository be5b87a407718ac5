"""The trigram index by itself: its lists, and the candidates that queries take from them."""

import pytest

from millrace.llm import secrets


def fulfils(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(fulfils(q, text) for q in query[1])


def test_lists_and_candidates(spark):
    texts = ["password=abc", "passwd secret", "xx AKIA yy", "token: 1", "api_key", "nothing", "ghp_ eyJ", "-----BEGIN RSA PRIVATE KEY-----", "PASSWORD AKIAAKIA api-key secret", ""]
    queries = {r.kind: q for r in secrets.BASE + secrets.MORE if (q := secrets.trigram_query(r)) is not True}
    grams = sorted(set().union(*map(secrets._trigrams, queries.values())))
    number = {g: k for k, g in enumerate(grams)}
    # Numbers in several blocks, with the ends of blocks among them.
    places = {n: texts[k % len(texts)] for k, n in enumerate([1, 2, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 70_000, 8_589_934_593, 8_589_934_600])}
    rows = [(n, [number[g] for g in grams if g in t.lower()]) for n, t in places.items()]
    numbered = spark.createDataFrame(rows, "number long, trigrams array<int>").filter("size(trigrams) > 0")
    index = secrets.postings(numbered)
    lists = {(r.block, r.trigram): {(r.block - 1) * secrets.BLOCK + k + 1 for k in range(secrets.BLOCK) if r.docs[k // 8] >> k % 8 & 1} for r in index.collect()}
    for g in grams:
        assert set().union(*(v for (_, t), v in lists.items() if t == number[g]), set()) == {n for n, t in places.items() if g in t.lower()}
    got = {r.number: set(r.wanted) for r in secrets.candidates(index, queries, number).collect()}
    want = {n: {k for k, q in queries.items() if fulfils(q, t)} for n, t in places.items()}
    assert got == {n: k for n, k in want.items() if k}


def test_candidates_come_from_the_index(spark, monkeypatch):
    """Without posting lists only the rule that scans every text finds anything."""
    df = spark.createDataFrame([(1, "password=abcdef1 and " + "0f" * 15)], "doc_id long, text string")
    found = lambda: {k: len(v) for k, v in secrets.scan(df).first().found.items() if v}
    assert found() == {"assign": 1, "hex": 1}
    monkeypatch.setattr(secrets, "postings", lambda numbered, full=secrets.postings: full(numbered).limit(0))
    assert found() == {"hex": 1}


@pytest.mark.parametrize("rule", secrets.BASE + secrets.MORE, ids=lambda r: r.kind)
def test_alternatives_say_the_same_as_the_query(rule):
    query = secrets.trigram_query(rule)
    if query is True:
        return
    each = secrets._alternatives(query)
    for chosen in [frozenset().union(*each), *each, *[x - {sorted(x)[0]} for x in each]]:
        text = " ".join(sorted(chosen))
        assert fulfils(query, text) == any(all(g in text for g in x) for x in each)
