"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors in several tables, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, group_bounds, local_components, map_arrow, shuffle_partitions, sorted_groups, split_hot, written
from millrace.llm.ngrams import mix
from millrace.llm.vectors import matrix, usable

#: Width of a bucket in units of the distance at the least cosine.
WIDTH = 7.0
#: A pair at just the least cosine shares no bucket with at most this probability, closer pairs with less.
MISSED = 1e-4
#: Unrelated vectors (at right angles) that a bucket holds on average, at most.
CROWD = 16
#: Vectors of a bucket that a task compares at once; larger buckets are compared part by part.
CHUNK = 4000
#: Rows of a bucket up to which buckets are compared together, and pairs of vectors at once.
SMALL, PAIRS = 48, 50_000


def meeting(distance: float) -> float:
    """Probability that two vectors share a cell of one projection; distance: in units of the width of a cell."""
    t = 1 / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """(tables, projections in each) for n vectors: projections until unrelated ones rarely meet, tables until pairs do."""
    near = math.sqrt(max(2 - 2 * cosine, 1e-6))
    apart = meeting(math.sqrt(2) / (WIDTH * near))
    projections = max(4, math.ceil(math.log(max(n, 1) / CROWD) / -math.log(apart))) if n > CROWD else 4
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - meeting(1 / WIDTH) ** projections))), projections


class Hashes:
    """Quantised random projections floor((a . v + b) / w), some of them joined to the bucket of each table."""

    def __init__(self, dim: int, cosine: float, tables: int, projections: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.projections = tables, projections
        self.width = WIDTH * math.sqrt(max(2 - 2 * cosine, 1e-6))
        self.directions = rng.standard_normal((dim, tables * projections))
        self.offsets = rng.uniform(0, self.width, tables * projections)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """int64 bucket of each row in each table."""
        cell = np.floor((unit @ self.directions + self.offsets) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.projections)
        h = np.zeros(cell.shape[:2], np.uint64)
        for k in range(self.projections):
            h = mix(h + cell[:, :, k].astype(np.uint64))
        return h.view(np.int64)


def close_pairs(v: np.ndarray, bounds: np.ndarray, cosine: float, apart: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within a group (bounds: starts and the length) whose cosine, in double precision, is at least cosine.

    In groups whose rows are marked ``apart`` only pairs of different ``part`` count. Small groups are compared all at
    once, by the distance of the rows; large ones a block of rows against the group.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    size, at = np.diff(bounds), np.arange(len(v))
    small, end = np.repeat(size <= SMALL, size), np.repeat(bounds[1:], size)

    def exact(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keep = ~apart[i] | (part[i] != part[j])
        i, j = i[keep], j[keep]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            near = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b]) >= cosine
            yield a[near], b[near]

    for d in range(1, SMALL):
        i = at[small & (at + d < end)]
        if not len(i):
            break
        yield from exact(i, i + d)
    for a, b in zip(bounds[:-1][size > SMALL].tolist(), bounds[1:][size > SMALL].tolist(), strict=True):
        unit = v[a:b] / norm[a:b, None]
        for k in range(0, b - a, 1000):
            i, j = np.nonzero(np.triu(unit[k : k + 1000] @ unit.T >= cosine - 1e-9, k + 1))
            yield from exact(a + k + i, a + j)


def compare(v: np.ndarray, weight: np.ndarray, bounds: np.ndarray, table: np.ndarray, codes_of, cosine: float, apart: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of other vectors linked to each row, smallest row of its component) in buckets that stand one after another.

    A pair counts in the first table in which it shares a bucket (table: of each row; codes_of gives the buckets of
    vectors in all tables); weight: how many vectors a row stands for.
    """
    linked = np.zeros(len(v), np.int64)
    pairs = [p for p in close_pairs(v, bounds, cosine, apart, part) if len(p[0])]
    if not pairs:
        return linked, np.arange(len(v))
    some = np.unique(np.concatenate([x for p in pairs for x in p]))
    codes = codes_of(v[some])
    for i, j in pairs:
        same = codes[np.searchsorted(some, i)] == codes[np.searchsorted(some, j)]
        new = ~(same & (np.arange(codes.shape[1]) < table[i][:, None])).any(axis=1)
        np.add.at(linked, i[new], weight[j[new]])
        np.add.at(linked, j[new], weight[i[new]])
    return linked, local_components(len(v), np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, by: str = "label", seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, ``by``).

    Vectors with equal, non-null ``by`` and equal length link if their cosine is at least ``cosine``; those that are
    null, zero or hold null or non-finite components link with nothing, nor do rows of null ``by``. Equal vectors of
    one ``by`` are compared once, with their number as weight: copies cost no pairs. n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable. Repeated vec_ids count as rows of their own but
    share a component. A row of null vec_id links and counts, but names no component unless all its copies lack an id.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = F.col(by)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), own.cast("string").alias("g"))
    # -0.0 counts as 0.0. A vector of one group has a number of its own once written: ids, null or repeated, name a
    # component at the end only.
    parts = F.when(usable("v") & F.col("g").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0)))
    rows = written(rows.select("vec_id", "g", parts.alias("v")), "vectors")
    ok = rows.filter("v is not null")
    distinct = ok.groupBy("g", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct")
    largest = distinct.groupBy("g", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    tables, projections = tables_for(largest, cosine)

    hashes: dict[int, Hashes] = {}

    def codes_of(v: np.ndarray) -> np.ndarray:
        if v.shape[1] not in hashes:
            hashes[v.shape[1]] = Hashes(v.shape[1], cosine, tables, projections, seed)
        return hashes[v.shape[1]](v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None])

    def bucketed(batch: pa.RecordBatch) -> dict:
        column = batch.column("v")
        sizes = np.asarray(column.value_lengths())
        codes = np.zeros((batch.num_rows, tables), np.int64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            codes[mine] = codes_of(matrix(column.take(pa.array(mine))))
        return {"key": batch.column("key"), "g": batch.column("g"), "size": pa.array(sizes), "codes": pa.array(list(codes), pa.list_(pa.int64()))}

    coded = map_arrow(distinct.select("key", "g", "v"), bucketed, "key long, g string, size int, codes array<long>")
    buckets = coded.select("key", "g", "size", F.posexplode("codes").alias("t", "code")).withColumn("bucket", F.xxhash64("g", "size", "t", "code"))
    # A bucket of one vector has no pair: only the others get their vectors.
    shared = written(buckets, "buckets")
    crowded = shared.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("rows_")).filter("rows_ > 1").select("t", "bucket")
    dealt = split_hot(shared.join(crowded, ["t", "bucket"]).select("key", "t", "bucket"), ["t", "bucket"], chunk, "key")
    groups = ["t", "bucket", "part_a", "part_b"]
    parts_of = dealt.join(distinct.select("key", "n", "v"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, groups):
            keys = [rows.column(k).to_numpy() for k in groups]
            n, row, mine = (rows.column(k).to_numpy() for k in ("n", "key", "mine"))
            lengths = np.asarray(rows.column("v").combine_chunks().value_lengths())
            # A bucket has vectors of one length; most tables have one length altogether.
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                t, _, part_a, part_b = (k[own] for k in keys)
                v = matrix(rows.column("v").combine_chunks().take(pa.array(own)))
                linked, root = compare(v, n[own], group_bounds([k[own] for k in keys]), t, codes_of, cosine, part_a != part_b, mine[own])
                some = np.flatnonzero((linked > 0) | (root != np.arange(len(own))))
                yield pa.RecordBatch.from_pydict({"key": row[own][some], "links": linked[some], "to": row[own][root[some]]})

    out = parts_of.select("key", "n", "v", *groups, "mine").repartition(shuffle_partitions(spark), *groups).sortWithinPartitions(*groups)
    found = written(out.mapInArrow(run, "key long, links long, to long"), "found")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    rooted = distinct.join(counts, "key", "left").join(component, distinct["key"] == component["node"], "left").select("g", "v", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", distinct["key"]).alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.drop("least").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    linked = ok.join(named, ["g", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
