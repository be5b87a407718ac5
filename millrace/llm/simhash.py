"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced within buckets of equal key bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, connected_components, free_name, group_bounds, local_components, parted, shuffle_partitions, sorted_groups, split_hot, tidy, written

BITS = 64
#: Fingerprints of one bucket that a task compares at once; larger buckets are compared part by part.
CHUNK = 20_000
SEED = 42
#: Shingles of a text hashed at once.
AT_ONCE = 65_536


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``words``-word shingle of a text, repeats included, as rows of 8 bytes; none for no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are joined by one space. Fewer words
    make one shingle.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(split))
    begin, end = starts[: len(split) - k + 1], ends[k - 1 :]
    digest, hashes = xxhash.xxh64_digest, []
    for at in range(0, len(begin), AT_ONCE):
        hashes.append(b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + AT_ONCE].tolist(), end[at : at + AT_ONCE].tolist(), strict=True)]))
    return np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of these hashes: a bit is 1 if it is in over half of them; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        counts += np.unpackbits(hashes[at : at + AT_ONCE], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of all ``words``-word shingles of a text, repeats included; 0 for no words or null."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp: long, the bits of the fingerprint) of every document's whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def near_pairs(fps: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of one group with at most radius differing bits.

    fps: uint64; bounds: starts of the groups and the length. Bit planes stand vertically: one 64-bit word holds one
    bit of 64 fingerprints. For a fingerprint and a word of 64 others, the differing bits of a plane are added by
    carry-save to vertical counters, so that 64 distances grow at once; what passes the radius sticks in a mask, and a
    pair of fingerprint and word is abandoned as soon as the mask covers all its candidates.
    """
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_words = -(-n // 64)
    padded = np.zeros(n_words * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(n_words, 64, 8), axis=2)  # word, lane, bit
    planes = np.packbits(bits.transpose(2, 0, 1).reshape(BITS, n_words, 64), axis=2, bitorder="little")
    planes = np.ascontiguousarray(planes).view("<u8").reshape(BITS, n_words).astype(np.uint64)
    ones = bits.reshape(-1, BITS)[:n].T.astype(bool)  # bit, row
    width = max(1, radius.bit_length())
    end_of = np.repeat(bounds[1:], np.diff(bounds))
    rows = np.arange(n)
    first, last = (rows + 1) // 64, (end_of - 1) // 64
    span = np.where(rows + 1 < end_of, last - first + 1, 0)
    found_i, found_j = [], []
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    ends = np.cumsum(span)
    at = 0
    while at < n:  # so many rows that their words are some hundred thousand
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 300_000, side="right")))
        i = np.repeat(rows[at:stop], span[at:stop])
        w = np.arange(len(i)) - np.repeat(np.cumsum(span[at:stop]) - span[at:stop], span[at:stop]) + first[i]
        low = np.clip(i + 1 - w * 64, 0, 64).astype(np.uint64)
        high = np.clip(end_of[i] - w * 64, 0, 64).astype(np.uint64)
        below = lambda k: np.where(k >= 64, full, (np.uint64(1) << np.minimum(k, np.uint64(63))) - np.uint64(1))
        over = ~(below(high) & ~below(low))  # lanes that are not candidates count as beyond the radius
        counters = [np.zeros(len(i), np.uint64) for _ in range(width)]
        for b in range(BITS):
            carry = planes[b][w] ^ np.where(ones[b][i], full, np.uint64(0))
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over = over | carry
            if b % 4 == 3 and b > 7:
                beyond = over | _above(counters, radius)
                if b % 8 == 3 or b == BITS - 1:
                    alive = beyond != full
                    if not alive.all():
                        i, w, over, counters = i[alive], w[alive], over[alive], [c[alive] for c in counters]
                    if not len(i):
                        break
        if len(i):
            near = ~(over | _above(counters, radius))
            lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            found_i.append(i[k])
            found_j.append(w[k] * 64 + lane)
        at = stop
    i = np.concatenate(found_i) if found_i else np.zeros(0, np.int64)
    j = np.concatenate(found_j) if found_j else np.zeros(0, np.int64)
    return i, j


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over radius, by a bit-sliced comparison from the highest bit."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def links(distinct: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the nodes of distinct (node, fp: long, all different) with at most radius differing bits.

    The 64 bits are cut into radius + 2 blocks; two such fingerprints agree in two of them at least, so each pair of
    blocks deals the fingerprints to buckets by these blocks' bits and no link is missed. A bucket's links become a
    forest before they leave the task: rows out grow with the fingerprints, not with pairs.
    """
    n = radius + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    block = [F.shiftrightunsigned("fp", BITS - cuts[k + 1]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(n)]
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.shiftleft(block[a], cuts[b + 1] - cuts[b]).bitwiseOR(block[b]).alias("key")) for t, (a, b) in enumerate(combinations(range(n), 2))])
    rows = distinct.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.t", "k.key")
    dealt = split_hot(rows, ["t", "key"], chunk, "fp")
    groups = ["t", "key", "part_a", "part_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, groups):
            bounds = group_bounds([rows.column(k).to_numpy() for k in groups])
            node, fp = rows.column("node").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
            i, j = near_pairs(fp, bounds, radius)
            if len(i):
                root = local_components(len(fp), i, j)
                k = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.RecordBatch.from_pydict({"a": node[k], "b": node[root[k]]})

    out = dealt.repartition(shuffle_partitions(distinct.sparkSession), *groups).sortWithinPartitions(*groups)
    return out.select("node", "fp", *groups).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 6) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs (doc_id, text): the smallest doc_id reachable over links.

    Documents link if their fingerprints differ in at most radius bits. Null, empty and blank texts have fingerprint 0
    and link like any other. Repeated rows stay repeated; a row of null doc_id links like any other but names no
    component unless all of its rows lack an id (then it is null). Other columns are ignored. An empty table gives no
    rows.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    # A node is a fingerprint and stands for itself: ids, null or repeated, name a component at the end only.
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def deduplicated(docs: DataFrame, words: int = 5, radius: int = 6) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, with all its columns.

    Of rows with the same doc_id the one of the smallest text stays. A row of null doc_id goes if its group has an id;
    others stay, equal texts once.
    """
    return first_of_groups(docs, near_duplicates(docs, words, radius))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each component of groups (doc_id, text_hash, component_id), as ``deduplicated`` says."""
    own, named = written(groups, "groups"), free_name("kept_id", docs.columns)
    id_hash = lambda c: F.xxhash64(F.coalesce(c.cast("bigint"), F.lit(-1)), c.isNull())
    # Rows that may go: those of another document's group, and those whose id is there twice. All others pass as they are.
    kept_here = F.col("doc_id").eqNullSafe(F.col("component_id"))
    doubtful = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(kept_here).alias("kept")).filter("n > 1 or not kept")
    doubtful = written(doubtful.select(id_hash(F.col("doc_id")).alias("h")), "doubtful")
    touched, rest = parted(docs, id_hash(F.col("doc_id")), doubtful, "h")
    text_hash, named_hash = F.xxhash64(F.col("text").cast("string")), free_name("kept_hash", docs.columns)
    kept = own.filter(kept_here).select(F.col("doc_id").alias(named), F.col("text_hash").alias(named_hash)).distinct()
    nth, key = free_name("nth", docs.columns), F.when(F.col("doc_id").isNull(), text_hash)
    found = touched.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col(named)) & (text_hash == F.col(named_hash)), "left_semi")
    # Row numbers are cut to one in the map tasks already: repeated rows are no large group.
    first = found.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy("text")))
    return first.filter(F.col(nth) == 1).drop(nth).unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
