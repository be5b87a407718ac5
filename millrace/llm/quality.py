"""Quality by importance resampling: hashed n-gram models of target and raw text, their ratio, and a Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, parted, tidy, written
from millrace.llm.ngrams import add_counts, mix, word_ngrams

#: Hash buckets of the n-gram models.
BUCKETS = 1 << 18
#: Labelled documents used: at most so many to fit the target model, and of each kind to find the cut.
FITTED, CALIBRATED = 40_000, 20_000
#: Of labelled target documents, at least so large a share stays above the cut.
KEPT_SHARE = 0.995
#: Features that every document is taken to have besides its own, at ratio one: few words say little.
PRIOR = 20
#: Length temperature: a document's log ratio counts as that of so many of its features, however long it is. Else a long
#: document would always or never be drawn; so the Gumbel noise, of scale 1, decides between documents of like weight.
LENGTH = 100.0


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """A standard Gumbel number of each id, the same wherever and whenever it is made."""
    h = mix(mix(ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def sortable(x: np.ndarray) -> np.ndarray:
    """int64 in the order of the doubles."""
    b = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target over raw probability by bucket; the target is smoothed towards raw by a hundredth of its counts."""
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    weight = max(1.0, 0.01 * target.sum())
    return np.log((target + weight * p) / (target.sum() + weight)) - np.log(p)


def scored(docs: DataFrame, labels: DataFrame, seed: int = 0, k: int | None = None) -> DataFrame:
    """(doc_id, n_features, weight, key, kept, text_hash) of every row of docs (doc_id, text).

    labels (doc_id, quality 0/1, toxic 0/1): the target are documents of quality 1 that are not toxic. The raw model
    counts the words and word pairs of all documents, the target model those of up to FITTED labelled target ones.
    ``weight`` is the log importance weight, log p_target - log p_raw of the document at the length temperature LENGTH,
    ``key`` = weight + standard Gumbel noise by doc_id, and the k documents of largest key are kept: a sample of size k
    without replacement, in which a document is drawn next with a probability proportional to exp(weight) among those
    left. With k None, k is the number of documents whose weight reaches a cut that labelled documents set which the
    target model has not seen (CALIBRATED of each kind at most): the best one between the kinds, lowered until
    KEPT_SHARE of the target reaches it. Equal keys (repeated rows) are kept or rejected together.

    Texts without any feature (null, empty, blank) have weight null and are rejected. Without usable labels all weights
    are zero, and all others are kept unless k says less. A null doc_id counts as -1 for the noise and has no label.
    Repeated labels count once; a document labelled both ways is no target. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), F.max("quality").alias("q")).filter("q is not null")
    known = known.select("doc_id", F.when(F.col("good"), 1).otherwise(0).alias("good"), "q", F.xxhash64("doc_id").alias("order"))
    take = lambda cond, n: known.filter(cond).orderBy("order", "doc_id").limit(n)
    # One in eight of the target documents is held out for the cut; toxic ones of good quality help neither side.
    fit = take("good = 1 and pmod(order, 8) > 0", FITTED).select("doc_id", F.lit(2).alias("role"))
    good = take("good = 1 and pmod(order, 8) = 0", CALIBRATED).select("doc_id", F.lit(1).alias("role"))
    bad = take("q = 0", CALIBRATED).select("doc_id", F.lit(0).alias("role"))
    roles = written(fit.union(good).union(bad), "roles")  # at most FITTED + 2 * CALIBRATED rows, hence broadcast
    flagged = rows.join(F.broadcast(roles), "doc_id", "left")

    def counted(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        role = np.array([r == 2 for r in batch.column("role").to_pylist()], bool)
        for at, n, bucket, doc in word_ngrams(batch.column("text").to_pylist(), BUCKETS):
            yield "raw", bucket
            if role[at : at + n].any():
                yield "target", bucket[role[at : at + n][doc]]

    counts = add_counts(flagged.select("text", "role"), counted, BUCKETS)
    none = np.zeros(BUCKETS, np.int64)
    usable = counts.get("target", none).sum() > 0
    ratio = spark.sparkContext.broadcast(log_ratio(counts["target"], counts["raw"]) if usable else none.astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            n = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows)
            for at, some, bucket, doc in word_ngrams(batch.column("text").to_pylist(), BUCKETS):
                n[at : at + some] = np.bincount(doc, minlength=some)
                total[at : at + some] = np.bincount(doc, weights=ratio.value[bucket], minlength=some)
            weight = LENGTH * total / (n + PRIOR)
            key = weight + gumbel(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), seed)
            empty = n == 0
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "role": batch.column("role"), "n_features": n, "weight": pa.array(weight, mask=empty), "key": pa.array(key, mask=empty), "bits": pa.array(sortable(key), mask=empty)})

    out = written(flagged.mapInArrow(score, "doc_id long, text_hash long, role int, n_features long, weight double, key double, bits long"), "weights")
    cut = None if k is not None else _cut(out.filter("role < 2 and weight is not null").dropDuplicates(["doc_id"]).select("role", "weight").toPandas()) if usable else None
    if k is None:
        k = out.filter("weight is not null" if cut is None else F.col("weight") >= cut).count()
    last = kth_largest(out.filter("bits is not null"), "bits", k)
    return out.select("doc_id", "n_features", "weight", "key", F.coalesce(F.col("bits") >= F.lit(last), F.lit(False)).alias("kept"), "text_hash")


def _cut(labelled) -> float | None:
    """The weight that best parts the labelled kinds, or a lower one that keeps KEPT_SHARE of the target."""
    good = np.sort(labelled.weight[labelled.role == 1].to_numpy())
    bad = np.sort(labelled.weight[labelled.role == 0].to_numpy())
    if not len(good) or not len(bad):
        return None
    at = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(bad, at) / len(bad) - np.searchsorted(good, at) / len(good)
    return float(min(at[np.argmax(gain)], good[int((1 - KEPT_SHARE) * len(good))]))


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a long column, found 16 bits at a time from counts of at most 65,536 values; no sort."""
    if k <= 0:
        return (1 << 63) - 1
    prefix = 0
    for shift in (48, 32, 16, 0):
        here = rows if shift == 48 else rows.filter(F.shiftright(column, shift + 16) == prefix)
        counts = here.groupBy(F.shiftright(column, shift).alias("v")).count().collect()
        for v, n in sorted(counts, reverse=True):
            if k <= n:
                prefix = v
                break
            k -= n
        else:
            return -(1 << 63)
    return prefix


def selected(docs: DataFrame, labels: DataFrame, seed: int = 0, k: int | None = None) -> DataFrame:
    """The rows of docs that ``scored`` keeps, with all their columns."""
    gone, h = free_name("gone", docs.columns), free_name("text_hash", docs.columns)
    # Rejected documents are the smaller side; a row is told from others of its doc_id by its text.
    drop = scored(docs, labels, seed, k).filter("not kept").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(h)).distinct()
    drop = written(drop, "rejected")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone)) & (text_hash == F.col(h))
    touched, rest = parted(docs, text_hash, drop, h)
    return touched.join(drop, same, "left_anti").unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
