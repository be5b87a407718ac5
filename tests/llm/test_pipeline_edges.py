"""Every stage of the pipeline on nulls, empty and repeated rows, clashing columns and empty tables."""

import corpus_pipeline as P
import pytest

CLASHING = ["dropped_lines", "own_id", "own_hash", "drop", "spans", "key", "text_hash", "component_id", "group", "gone", "kept", "weight", "nth"]
LINES = "\n".join(f"some line number {k} with quite a few words of its own in it" for k in range(6))
TEXTS = [(1, LINES), (1, LINES), (2, "other words before\n" + LINES), (3, None), (3, None), (4, ""), (5, " \n "), (None, "a text without an id but with words"), (None, None), (6, LINES), (7, "password=abcdefgh12 and more words than that"), (8, "x " * 20_000)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", f"src{k}", len(t or ""), *[k] * len(CLASHING)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality(spark, odd, folder):
    out = P.keep_quality(spark, odd, folder)
    assert out.columns == odd.columns
    assert texts(out) == sorted([x for x in TEXTS if (x[1] or "").strip()], key=str)


def test_lines(spark, odd, folder):
    out = P.drop_repeated_lines(spark, odd, folder)
    assert out.columns == odd.columns
    got = texts(out)
    assert got.count((1, LINES)) == 2 and (6, LINES) not in got and not any(i == 6 for i, _ in got)
    assert (2, "other words before") in got
    assert {(3, None), (4, ""), (5, " \n "), (None, None)} <= set(got)
    assert {r.doc_id: r.n_chars for r in out.collect()}[2] == len("other words before")


def test_near_duplicates(spark, odd, folder):
    out = P.drop_near_duplicates(spark, odd, folder)
    assert out.columns == odd.columns
    got = texts(out)
    assert sum(i in (1, 2, 6) for i, _ in got) == 1 and (1, LINES) in got
    assert got.count((3, None)) == 1 and not any(i in (4, 5) for i, _ in got) and (7, TEXTS[10][1]) in got and (8, TEXTS[11][1]) in got
    assert (None, "a text without an id but with words") in got


def test_secrets(spark, odd, folder):
    out = P.mask_secrets(spark, odd, folder)
    assert out.columns == odd.columns
    assert texts(out) == sorted([(i, "[SECRET] and more words than that" if i == 7 else t) for i, t in TEXTS], key=str)


def test_packing(spark, odd, folder):
    out = P.pack(spark, odd, folder).collect()
    assert sorted({r.doc_id for r in out}, key=str) == sorted({i for i, _ in TEXTS}, key=str)
    assert max(r.length for r in out) <= P.CAPACITY


def test_empty_tables(spark, odd, folder):
    docs = odd.filter("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
