"""Records in several files and packing in several groups, and a file list that survives repeated tasks."""

import json

import numpy as np

from millrace.llm import packing, queries, records


def test_files_roll_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 2000)
    docs = spark.createDataFrame([(k // 2 if k % 7 else None, f"text {k} " * (k % 50)) for k in range(3000)], "doc_id long, text string")
    path, files = records.write_records(docs, queries.byte_bpe, 2, 50_257, f"file://{tmp_path}/r")
    listed = json.loads((tmp_path / "r" / "files.json").read_text())
    assert [tuple(x.values()) for x in listed] == [tuple(r) for r in files.collect()]
    assert len(listed) > 4
    # What a lost attempt has left isn't read.
    (tmp_path / "r" / "part-000000-000000-999999.records").write_bytes(b"cut short")
    got = records.read_records(path, files).orderBy("start").collect()
    assert len(got) == 3000
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    lengths = np.random.default_rng(4).integers(1, 65, 1000).tolist()
    rows = spark.createDataFrame([(k, n, "x", -1) for k, n in enumerate(lengths)], "k long, length long, group string, offset long")
    got = packing.pack(rows, 64).toPandas()
    assert sorted(zip(got.k, got.length, strict=True)) == list(enumerate(lengths))
    assert set(got.group) == {"x"}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 64
    # Ten groups cost some sequences against one group of all, few of each.
    assert got.sequence_id.nunique() <= len(packing.best_two_fit(np.array(lengths), 64)) + 3 * 10
