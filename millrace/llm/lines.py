"""Line dedup by content-defined runs: runs of lines that repeat across the corpus are removed but for the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import KeyFilter, bound_batches, free_name, parted, tidy, written
from millrace.llm.ngrams import mix

#: A run takes part if it has so many lines and words, or is one line of so many words.
LEAST_LINES, LEAST_WORDS, LONG_LINE = 2, 12, 40
#: Base of the rolling hash, and what undoes it modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
RANGES = "array<struct<begin:int,end:int>>"
#: Documents whose runs are held at once.
AT_ONCE = 100


def runs(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of a document's runs of lines, in order; they overlap.

    From each line with words the shortest run of LEAST_LINES lines and LEAST_WORDS words or more, forwards and
    backwards, and each line of LONG_LINE words or more. A run depends on its own lines alone. So of a passage that
    large every run inside repeats with it whatever surrounds it, and every line with words is in one: forward runs
    cover it but for an end of less than LEAST_WORDS, and that is in the backward run from its last line.
    """
    n, words = len(lines), np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    before = np.concatenate([[0], np.cumsum(words)])  # words before each line
    k = np.flatnonzero(words)
    end = np.maximum(np.searchsorted(before, before[k] + LEAST_WORDS), k + LEAST_LINES)
    begin = np.minimum(np.searchsorted(before, before[k + 1] - LEAST_WORDS, side="right") - 1, k + 1 - LEAST_LINES)
    ahead, back = end <= n, begin >= 0
    ahead = ahead & (before[np.minimum(end, n)] - before[k] >= LEAST_WORDS)
    back = back & (before[k + 1] - before[np.maximum(begin, 0)] >= LEAST_WORDS)
    long = np.flatnonzero(words >= LONG_LINE)
    each = np.unique(np.concatenate([k[ahead] * (n + 1) + end[ahead], begin[back] * (n + 1) + k[back] + 1, long * (n + 1) + long + 1]))
    return each // (n + 1), each % (n + 1)


def rolling(lines: list[bytes], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rolling hash over the hashes of the lines of each run: from sums over the whole text, whatever a run's length."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(lines), BASE, np.uint64))])
    undo = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(lines), UNDO, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own) * powers[:-1])])
    return mix((sums[end] - sums[begin]) * undo[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """A text without these ranges of lines."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    gone = {k for a, b in ranges for k in range(a, b)}
    return b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode("utf-8", "surrogatepass")


def _key(doc_id: Column, text_hash: Column) -> Column:
    """Only to leave rows out of a shuffle; joins are by doc_id and the text's hash."""
    return F.xxhash64(text_hash, F.coalesce(doc_id.cast("bigint"), F.lit(-1)), doc_id.isNull())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, drop: array<struct<begin, end>>): ranges of lines to remove from those rows (doc_id, text).

    The rolling hashes of all runs are counted first, with the smallest place of each; only runs whose hash is there
    twice are kept as bytes (a filter of fixed size leaves out most others before the shuffle). Each is then compared,
    byte by byte, with the run at the smallest place, its model, and removed if equal: a run that only shares a hash
    stays. Places are ordered by doc_id (null last), text hash and line.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def expanded(known: KeyFilter | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in tidy(batches):
                for at in range(0, whole.num_rows, AT_ONCE):
                    batch = whole.slice(at, AT_ONCE)
                    of, begins, ends, hashes, body = [], [], [], [], []
                    for i, t in enumerate(batch.column("text")):
                        lines = _lines(t.as_py())
                        begin, end = runs(lines)
                        if not len(begin):
                            continue
                        h = rolling(lines, begin, end)
                        if known:
                            there = known.hits(h)
                            begin, end, h = begin[there], end[there], h[there]
                            body += [b"\n".join(lines[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                        of.append(np.full(len(begin), i))
                        begins.append(begin)
                        ends.append(end)
                        hashes.append(h)
                    if not of:
                        continue
                    i = pa.array(np.concatenate(of))
                    cols = {"doc_id": batch.column("doc_id").take(i), "text_hash": batch.column("text_hash").take(i), "begin": pa.array(np.concatenate(begins), pa.int32()), "h": np.concatenate(hashes)}
                    if known:
                        cols |= {"end": pa.array(np.concatenate(ends), pa.int32()), "bytes": pa.array(body, pa.binary())}
                    yield pa.RecordBatch.from_pydict(cols)

        return rows.mapInArrow(run, "doc_id long, text_hash long, begin int, h long" + ", end int, bytes binary" * bool(known))

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "begin")
    # Aggregated before the shuffle: a run in a third of all documents is one row of each task.
    counted = expanded(None).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    twice = written(counted.filter("n > 1").select("h", "first"), "runs")
    is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")) & (F.col("first.begin") == F.col("begin"))
    found = expanded(KeyFilter(twice, "h")).join(twice, "h").withColumn("is_first", is_first).drop("first")
    found = written(found, "repeated")
    models = found.filter("is_first").select("h", F.col("bytes").alias("model")).dropDuplicates(["h"])
    equal = found.filter("not is_first").join(models, "h").filter(F.col("bytes") == F.col("model"))
    # At most as many ranges as a document has runs.
    return equal.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("drop"))


def deduplicated(docs: DataFrame, dropped: str | None = None) -> DataFrame:
    """docs with repeated runs of lines removed from ``text``, but for the first of each.

    Equal rows share their runs' places and so keep or lose the same. A null text stays null; a text of which all is
    removed becomes empty; texts without repeats stay as they are, byte for byte. Blank lines next to what is removed
    stay. All other columns stay as they are, and with ``dropped`` a column of that name has the removed ranges of lines
    (array<struct<begin, end>>; they may overlap). An empty table gives no rows.
    """
    taken = [*docs.columns, *([dropped] if dropped else [])]
    own_id, own_hash, drop = free_name("own_id", taken), free_name("own_hash", taken), dropped or free_name("drop", taken)
    gone = repeats(docs).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("drop").alias(drop))
    gone = written(gone.withColumn("key", _key(F.col(own_id), F.col(own_hash))), "drops")
    text = F.col("text").cast("string")
    touched, rest = parted(docs.withColumn("text", text), _key(F.col("doc_id"), F.xxhash64(text)), gone, "key")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash))
    joined = touched.join(gone.drop("key"), same, "left").drop(own_id, own_hash)
    schema = joined.schema
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            numbers = batch.column(names.index(drop)).to_pylist()
            if any(numbers):
                column = batch.column(names.index("text"))
                texts = [t if not d or t is None else without(t, [(r["begin"], r["end"]) for r in d]) for t, d in zip(column.to_pylist(), numbers, strict=True)]
                batch = batch.set_column(names.index("text"), batch.schema.field(names.index("text")), pa.array(texts, column.type))
            yield batch

    # Only documents that may lose something are shuffled.
    out = joined.mapInArrow(run, schema).unionByName(rest.withColumn(drop, F.lit(None).cast(RANGES)))
    if dropped:
        return out.withColumn(dropped, F.coalesce(dropped, F.array().cast(RANGES)))
    return out.drop(drop)
