"""Shared pieces of the training-data operators: shared storage, columnar row streams, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("millrace.shared.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", base)
    # With its scheme: what isn't Spark must find it too.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return (whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, never recomputes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once where they hold whole texts.
TEXTS_AT_ONCE = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to TEXTS_AT_ONCE: a batch of texts is in memory several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_AT_ONCE:
        spark.conf.set(name, str(TEXTS_AT_ONCE))


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker hands memory that it no longer uses back to the system.

    Workers are kept for later tasks, and allocators keep what they have had: without this an executor holds, beside its
    own memory, the largest batch that each of its workers has ever seen.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
            ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, with underscores added until no column (in any letter case) has that name."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """df.mapInArrow for a function from one RecordBatch to one dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by keys: tables that end where a group of equal keys ends, so that no group is split.

    A table holds many small groups or one large one; memory is one batch plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in tidy(batches):
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(n - 1, bool)
        for c in cols:
            same &= c[1:] == c[:-1]
        cuts = np.flatnonzero(~same) + 1
        first = [c[0] for c in cols]
        if held and any(held[-1].column(k)[-1].as_py() != v for k, v in zip(keys, first, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(cols: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the length at the end."""
    n = len(cols[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.append(np.flatnonzero(new), n)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    return label


def split_hot(rows: DataFrame, keys: list[str], chunk: int, by: str) -> DataFrame:
    """Adds part_a, part_b and mine to rows so that a group of (keys, part_a, part_b) has some 2 * chunk rows at most.

    A group of up to chunk rows has part_a = part_b = 0. A larger one is cut into m parts by a hash of ``by`` and each
    pair of parts becomes a group; two rows of the group meet in the group of their parts (rows of one part in the
    group part_a = part_b). ``mine`` is a row's own part. Nothing is dropped, and no key is left to one task.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > chunk)
    hot = written(sizes.select(*keys, F.ceil(F.col("n_") / chunk).cast("int").alias("m_")), "hot")
    if hot.isEmpty():
        return rows.withColumn("part_a", F.lit(0)).withColumn("part_b", F.lit(0)).withColumn("mine", F.lit(0))
    joined = rows.join(hot, keys, "left").withColumn("m_", F.coalesce("m_", F.lit(1)))
    mine = F.pmod(F.xxhash64(by), F.col("m_")).cast("int")
    return (
        joined.withColumn("mine", mine)
        .withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("m_") - 1)))
        .withColumn("part_a", F.least("mine", "other_"))
        .withColumn("part_b", F.greatest("mine", "other_"))
        .drop("m_", "other_")
    )


#: Bits of a key filter: 4 MB whatever the number of keys.
FILTER_BITS = 25


class KeyFilter:
    """Which keys (longs that are hashes already) may be in a set: a bit map of fixed size, for the executors.

    A key of the set always hits. With more keys more others hit too, so a filter can save a shuffle and never loses a
    row; the join that follows decides. The set itself stays distributed: the driver gets the map's words that aren't
    zero, 2**19 at most.
    """

    def __init__(self, keys: DataFrame, column: str):
        place = F.shiftrightunsigned(column, 64 - FILTER_BITS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        words = keys.select(F.shiftright(place, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        found = words.toArrow()
        bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        place = (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.shared.value[place >> 6] >> (place & 63) & 1).astype(bool)


def parted(df: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be in keys[column], the rest): the rest needs no join, and so no shuffle of its texts."""
    known = KeyFilter(keys, column)
    bound_batches(df.sparkSession)

    @F.pandas_udf("boolean")
    def hit(k: pd.Series) -> pd.Series:
        return pd.Series(known.hits(k.to_numpy()))

    return df.filter(hit(key)), df.filter(~hit(key))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node that an edge (a, b: long) touches, the smallest node reachable.

    Alternating large-star and small-star steps over tables in the shared folder. Minima are aggregated before the
    shuffle and neighbours are joined, never gathered in a list, so a node with very many links needs no large group.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    pairs = written(pairs, "links")
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        pairs = written(small.filter("hi > lo").distinct(), "small")
        # Done when each node has one link down at most, and none that is linked down is another's root.
        ends = pairs.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(pairs.select("lo", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter(F.col("down") + F.col("up") > 1).filter("down > 0").isEmpty():
            break
    roots = pairs.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    return roots.union(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct().join(roots.select("node"), "node", "left_anti"))
