"""Best-two-fit packing of token sequences into rows of a fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, free_name, tidy, written

#: Pieces that one task packs together. A group's last sequence may stay part empty, one in some thousands.
GROUP = 20_000


def cut(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The pieces of a document: itself, or if longer than capacity, pieces of capacity ids and a shorter last one."""
    return [ids[k : k + capacity] for k in range(0, len(ids), capacity)]


class _Lengths:
    """How many unpacked pieces there are of each length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.there = [n for n in range(1, capacity + 1) if self.count[n]]
        #: One bit a length, to find pairs.
        self.bits = sum(1 << n for n in self.there)

    def take(self, n: int) -> int:
        self.count[n] -= 1
        if not self.count[n]:
            self.there.pop(bisect_right(self.there, n) - 1)
            self.bits &= ~(1 << n)
        return n

    def give(self, n: int) -> None:
        if not self.count[n]:
            insort(self.there, n)
            self.bits |= 1 << n
        self.count[n] += 1

    def largest(self, most: int) -> int:
        """The largest length of at most ``most``; 0 if there is none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.bits & ((1 << (most + 1)) - 1) else 0

    def pair(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two pieces of together at most gap and over ``above``, as large as can be."""
        best, found = above, None
        for a in reversed(self.there[: bisect_right(self.there, gap - 1)]):
            if 2 * a <= best:
                break  # the smaller one can't be larger than a
            b = self.largest(min(a, gap - a))
            if b == a and self.count[a] < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
        return found


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Lengths of the pieces of each sequence.

    A sequence takes the largest piece that fits until none does. Then its smallest piece goes back if two others fill
    the gap that it leaves more tightly; this goes on while it gains.
    """
    left, out = _Lengths(lengths, capacity), []
    while left.there:
        now, gap = [], capacity
        while gap and (n := left.largest(gap)):
            now.append(left.take(n))
            gap -= n
        while gap and len(now) > 1:
            small = min(now)
            two = left.pair(gap + small, small)
            if not two:
                break
            now.remove(small)
            left.give(small)
            now += [left.take(two[0]), left.take(two[1])]
            gap -= sum(two) - small
        out.append(now)
    return out


def pieces(docs: DataFrame, encode: Callable[[pa.Array], list[np.ndarray]], end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then end_id, cut where longer than capacity.

    A null text counts as empty: its piece holds end_id alone. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cols: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    for k, p in enumerate(cut(np.append(ids, end_id).astype("<u4"), capacity)):
                        cols["doc_id"].append(doc_id)
                        cols["piece"].append(k)
                        cols["start"].append(k * capacity)
                        cols["length"].append(len(p))
                        cols["ids_crc32"].append(zlib.crc32(p.tobytes()))
                        if with_ids:
                            cols["ids"].append(p.astype(np.int32))
                kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items() if k != "ids" or with_ids})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (with ``length``: long, 1 to capacity) and where each stands: sequence_id, offset (long; gapless from 0).

    Rows are dealt evenly to groups of some GROUP rows by their place in a written table (a task that is run again
    deals alike; no key can make a group large), and each group is packed by best-two-fit. Every row is placed once;
    rows of equal length are interchangeable. Columns of rows named sequence_id or offset are replaced. An empty input
    gives an empty result.
    """
    placed = written(rows.drop("sequence_id", "offset"), "pieces")
    group = free_name("group", placed.columns)
    groups = max(1, -(-placed.count() // GROUP))
    schema = placed.schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        firsts = np.searchsorted(lengths[order], np.arange(capacity + 2))
        used = np.zeros(capacity + 1, np.int64)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, each in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for n in each:
                row = order[firsts[n] + used[n]]
                used[n] += 1
                sequence[row], offset[row] = (int(key[0]) << 32) + k, at
                at += n
        return rows.drop(columns=group).assign(sequence_id=sequence, offset=offset)

    dealt = placed.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(group).applyInPandas(run, schema)
