"""Hashed n-grams of many texts at once, and counts of them over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import bound_batches, tidy

#: Multipliers of the hashes: odd, so that they can be undone modulo 2**64.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Texts are hashed in runs of at most some so many bytes (a longer text alone).
RUN = 1 << 20
#: Numbers in one row of counts.
BLOCK = 4096

_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = _WORD
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = _SPACE
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) >= n:
        return _powers, _inverse
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, STEP, np.uint64))])
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, pow(STEP, -1, 1 << 64), np.uint64))])
    if n <= 2 * RUN:  # those of a long text aren't kept
        _powers, _inverse = powers, inverse
    return powers, inverse


def runs(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes of some texts with a zero byte after each, place of the zero bytes)."""
    data, at = [], 0
    size = 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").replace(b"\0", b" ")
        if data and size + len(b) > RUN:
            yield _run(at, data)
            data, at, size = [], k, 0
        data.append(b)
        size += len(b) + 1
    if data:
        yield _run(at, data)


def _run(at: int, data: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    return at, np.frombuffer(b"\0".join(data) + b"\0", np.uint8), np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) - 1


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of a run: longest runs of letters and digits, or of other marks; white space parts them."""
    kind = _CLASS[data]
    change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    stop = np.append(change[1:], len(data))
    real = kind[change] != _SPACE
    begin, stop = change[real], stop[real]
    powers, inverse = _tables(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    return mix((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)), np.searchsorted(ends, begin)


def word_ngrams(texts: list[str | None], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, bucket, text from the first) of all single words and pairs of neighbours."""
    for at, data, ends in runs(texts):
        one, doc = words(data, ends)
        two = mix(one[:-1] * np.uint64(STEP) + one[1:])
        within = doc[1:] == doc[:-1]
        yield at, len(ends), (np.concatenate([one, two[within]]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[1:][within]])


def add_counts(docs: DataFrame, groups_of: Callable[[pa.RecordBatch], Iterator[tuple[str, np.ndarray]]], buckets: int) -> dict[str, np.ndarray]:
    """Counts by name and bucket over all rows of docs.

    groups_of gives (name, buckets of n-grams) of a batch. Each task adds up its own rows and sends its counts in blocks
    of BLOCK numbers; blocks of one name and place are added by tasks of their own, and the driver gets one total, of a
    size that only the names and buckets set.
    """

    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in tidy(batches):
            for name, found in groups_of(batch):
                totals.setdefault(name, np.zeros(buckets, np.int64))
                totals[name] += np.bincount(found, minlength=buckets)
        for name, n in totals.items():
            for k in range(0, buckets, BLOCK):
                yield pa.RecordBatch.from_pydict({"name": [name], "block": pa.array([k // BLOCK], pa.int32()), "counts": [n[k : k + BLOCK].tobytes()]})

    def total(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in rows:
            for name, block, counts in zip(*(batch.column(c).to_pylist() for c in ("name", "block", "counts")), strict=True):
                if key != (name, block):
                    if key:
                        yield pa.RecordBatch.from_pydict({"name": [key[0]], "block": pa.array([key[1]], pa.int32()), "counts": [sums.tobytes()]})
                    key, sums = (name, block), np.zeros(len(counts) // 8, np.int64)
                sums = sums + np.frombuffer(counts, np.int64)
        if key:
            yield pa.RecordBatch.from_pydict({"name": [key[0]], "block": pa.array([key[1]], pa.int32()), "counts": [sums.tobytes()]})

    schema = "name string, block int, counts binary"
    blocks = docs.mapInArrow(count, schema).repartition("name", "block").sortWithinPartitions("name", "block").mapInArrow(total, schema)
    out: dict[str, np.ndarray] = {}
    for r in blocks.collect():  # as many numbers as the model has
        out.setdefault(r["name"], np.zeros(buckets, np.int64))[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out
