"""Near-duplicates by the similarity of shingle sets: SimHash and MinHash candidates, each link checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import KeyFilter, bound_batches, connected_components, group_bounds, shuffle_partitions, sorted_groups, split_hot, tidy, written

#: Sets meet where the minima of ROWS hashes agree in one of BANDS bands: at similarity 0.8 all but 7e-5, (1 - 0.8**5)**24.
BANDS, ROWS = 24, 5
#: Sets of one candidate group that a task compares at once; larger groups are compared part by part.
CHUNK = 500
_RNG = np.random.default_rng(42)
_MULTIPLY, _ADD = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_MULTIPLY |= np.uint64(1)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct ones, sorted, of the rows that ``simhash.shingle_hashes`` gives."""
    return np.unique(hashes.view(">u8").ravel().astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes, sorted, of a text's shingles; words and shingles are those of ``simhash.fingerprint``."""
    return distinct(simhash.shingle_hashes(text, words))


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set's bands; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 256):
        mixed = own[at : at + 256, None] * _MULTIPLY + _ADD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MULTIPLY[::-1]
        least = np.minimum(least, mixed.min(axis=0))
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]) + x.tobytes()) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def verified(sets: list[np.ndarray], part: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with similarity ``least`` or more: exact, none left out.

    Sets that are connected already aren't compared again. part: pairs within part 0 or 1 alone are compared where all
    are of it, and across the parts always; a caller that deals parts has each pair in one group at least.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    start = np.concatenate([[0], np.cumsum(size)])
    label, out = np.arange(n), []
    across = len(set(part.tolist())) > 1
    for i in np.argsort(-size, kind="stable").tolist():
        open_ = label != label[i]
        if across:
            open_ &= part != part[i]
        # a set of another size by more than the least similarity can't be as similar
        open_ &= (size >= least * size[i]) & (size * least <= size[i]) & (size > 0)
        open_at = np.flatnonzero(open_)
        for at in range(0, len(open_at), 64):
            j = open_at[at : at + 64]
            values = np.concatenate([flat[start[x] : start[x + 1]] for x in j])
            place = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
            both = np.add.reduceat((sets[i][place] == values).astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]]))
            for x in j[both >= least * (size[i] + size[j] - both) - 1e-9].tolist():
                if label[x] != label[i]:
                    out.append((i, x))
                    label[label == label[x]] = label[i]
    return out


def near_duplicates(docs: DataFrame, words: int, radius: int, least: float) -> DataFrame:
    """(doc_id, text_hash, component_id) for every row of docs (doc_id, text): the smallest doc_id reachable over links.

    Documents link if the Jaccard similarity of their sets of shingles is ``least`` or more. Candidates are fingerprints
    within radius and sets that agree in a band; what they connect is a group, and in a group each pair of sets that
    isn't connected yet is compared exactly. So no link is wrong, and one is missed only if no candidate connects it.
    Null ids and repeated rows are as in ``simhash.near_duplicates``. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            texts = batch.column("text")
            fps, sets, keys = [], [], []
            for t in texts:
                hashes = simhash.shingle_hashes(t.as_py(), words)
                own = distinct(hashes)
                fps.append(simhash.fingerprint_of(hashes))
                sets.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                keys.append(bands(own))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": as_long(fps), "set_hash": as_long(sets), "bands": pa.array(keys, pa.list_(pa.int64()))})

    signs = written(rows.mapInArrow(signed, "doc_id long, text_hash long, fp long, set_hash long, bands array<long>"), "signs")
    # A node is a set (with its fingerprint, in case two sets share a hash) and has a number of its own once written.
    of_set = signs.groupBy("set_hash", "fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("row"), F.first("bands").alias("bands"))
    nodes = written(of_set.select(F.monotonically_increasing_id().alias("node"), "set_hash", "fp", "least", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"), "bands"), "nodes")
    met = nodes.select("node", F.explode("bands").alias("key"))
    hubs = written(met.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub < other").select("key", "hub"), "hubs")
    candidates = met.join(hubs, "key").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    candidates = candidates.union(simhash.links(nodes.select("node", "fp"), radius))
    groups = written(connected_components(candidates), "candidates")

    # The sets of the groups, each from its node's own row.
    place = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_hash")
    wanted = written(nodes.join(groups, "node").select("node", "component", "doc_id", "text_hash", place.alias("place")), "wanted")
    known = KeyFilter(wanted, "place")

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            there = np.flatnonzero(known.hits(batch.column("place").to_numpy()))
            for at in range(0, len(there), 100):
                k = pa.array(there[at : at + 100])
                sets = [shingles(t, words).tobytes() for t in batch.column("text").take(k).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").take(k), "hash": batch.column("text_hash").take(k), "own": pa.array(sets, pa.binary())})

    sets = rows.select("doc_id", "text_hash", "text", place.alias("place")).mapInArrow(expanded, "id long, hash long, own binary")
    sets = sets.join(wanted, sets["id"].eqNullSafe(wanted["doc_id"]) & (sets["hash"] == wanted["text_hash"])).dropDuplicates(["node"])
    dealt = split_hot(written(sets.select("node", "component", "own"), "sets"), ["component"], CHUNK, "node")
    keys = ["component", "part_a", "part_b"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            bounds = group_bounds([table.column(k).to_numpy() for k in keys])
            node, mine = table.column("node").to_numpy(), table.column("mine").to_numpy()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = [np.frombuffer(x, np.uint64) for x in table.column("own").slice(a, b - a).to_pylist()]
                found = np.array(verified(own, mine[a:b], least), np.int64).reshape(-1, 2) + a
                if len(found):
                    yield pa.RecordBatch.from_pydict({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    found = connected_components(dealt.select("node", "own", "mine", *keys).mapInArrow(compared, "a long, b long"))
    rooted = written(nodes.join(found, "node", "left").select("set_hash", "fp", "least", F.coalesce("component", "node").alias("root")), "rooted")
    named = rooted.drop("least").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    return signs.select("doc_id", "text_hash", "set_hash", "fp").join(named, ["set_hash", "fp"]).select("doc_id", "text_hash", "component_id")
