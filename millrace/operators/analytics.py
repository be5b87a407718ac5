"""Table analytics: ANALYZE, stats, sample and profile; to the driver goes a row a column, and a bounded number of values."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField

_NUMBERS = (IntegerType, LongType, ShortType, DoubleType, FloatType)


#: Distinct values that the driver gets at most to find a rank among them.
FEW = 10_000


def _each(df: DataFrame, figures: Callable[[StructField], list[Column]]) -> list[Row]:
    """A row a column: its name, rows, nulls and distinct values, and figures of its distinct values v.

    Each column is an aggregation of its own over that column alone: equal values meet before the shuffle, and no row is
    multiplied by the columns.
    """
    parts = []
    for f in df.schema:
        counts = df.groupBy(F.col(f"`{f.name}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        parts.append(counts.agg(F.lit(f.name).alias("column"), total(F.col("n")).alias("row_count"), total(F.when(F.col("v").isNull(), F.col("n"))).alias("null_count"), F.count("v").alias("ndv"), *figures(f)))
    return reduce(DataFrame.unionByName, parts).collect() if parts else []


def kth(values: DataFrame, ranks: list[int]) -> dict[int, object]:
    """The values of these ranks (1: the smallest) of values (v: not null), exactly, whatever their number.

    Up to FEW distinct values are counted one by one. Of more, approximate quantiles give a narrow range about each
    rank, and the search goes on within it.
    """
    few = values.groupBy("v").count().orderBy("v").limit(FEW + 1).collect()
    if len(few) <= FEW:
        out, upto, left = {}, 0, sorted(set(ranks))
        for v, n in few:
            upto += n
            while left and left[0] <= upto:
                out[left.pop(0)] = v
        return out
    n, out = values.count(), {}
    for rank in sorted(set(ranks)):
        margin = 4 / FEW
        while True:
            low, high = values.agg(F.percentile_approx("v", [max(0.0, rank / n - margin), min(1.0, rank / n + margin)], FEW)).first()[0]
            below, inside = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
            if below < rank <= below + inside:
                break
            margin *= 4
        out[rank] = low if low == high else kth(values.filter(F.col("v").between(low, high)), [rank - below])[rank - below]
    return out


def analyze(df: DataFrame) -> DataFrame:
    """(column_name, row_count, null_count, ndv) of each column."""
    rows = [(r["column"], r["row_count"], r["null_count"], r["ndv"]) for r in _each(df, lambda _: [])]
    return df.sparkSession.createDataFrame(rows, "column_name string, row_count long, null_count long, ndv long")


def _bounds(f: StructField) -> list[Column]:
    ok = not isinstance(f.dataType, (DecimalType, BinaryType))
    return [(a("v").cast("string") if ok else F.max(F.lit(None).cast("string"))).alias(name) for a, name in ((F.min, "min"), (F.max, "max"))]


def stats(df: DataFrame) -> DataFrame:
    """(column, type, row_count, null_rate, distinct, min, max, p50, p90, p99) as text and numbers, a row a column.

    null_rate in percent of two places, 100 for an empty table; p50 the middle (of two their mean, two places), p90 and
    p99 by nearest rank, for numbers only; no min and max of decimals and binaries.
    """
    kinds, out = {f.name: f.dataType for f in df.schema}, []
    for r in _each(df, _bounds):
        name, n = r["column"], r["row_count"] - r["null_count"]
        rate = float(_two_places(r["null_count"] * 100 / r["row_count"])) if r["row_count"] else 100.0
        p50 = p90 = p99 = None
        if n and isinstance(kinds[name], _NUMBERS):
            middle, at = ((n + 1) // 2, n // 2 + 1), {q: max(1, -(-n * q // 100)) for q in (90, 99)}
            found = kth(df.select(F.col(f"`{name}`").alias("v")).filter("v is not null"), [*middle, *at.values()])
            p50 = float(_two_places((found[middle[0]] + found[middle[1]]) / 2))
            p90, p99 = (float(found[at[q]]) for q in (90, 99))
        out.append((name, kinds[name].simpleString(), r["row_count"], rate, r["ndv"], r["min"], r["max"], p50, p90, p99))
    return df.sparkSession.createDataFrame(out, "column string, type string, row_count long, null_rate double, distinct long, min string, max string, p50 double, p90 double, p99 double")


def _two_places(x: float) -> float:
    """Rounded half away from zero."""
    return math.copysign(float(Decimal(repr(abs(x))).quantize(Decimal("0.01"), ROUND_HALF_UP)), x) if math.isfinite(x) else x


def sample(df: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """Exactly n rows at random (all, if fewer): a top-k by a random number, which no sort of the whole table precedes."""
    if n <= 0:
        raise ValueError("sample: n must be positive")
    return df.withColumn("random_", F.rand(seed)).orderBy("random_").limit(n).drop("random_")


def profile(df: DataFrame, top: int = 5) -> DataFrame:
    """(column, type, min, max, top_k): the most frequent strings as 'v(n), v(n)', by count, then value."""
    if not 1 <= top <= 20:
        raise ValueError("profile: top must be 1 to 20")
    known = [(r["column"], df.schema[r["column"]].dataType.simpleString(), r["min"], r["max"]) for r in _each(df, _bounds)]
    base = df.sparkSession.createDataFrame(known, "column string, type string, min string, max string")
    parts = []
    for f in df.schema:
        if isinstance(f.dataType, StringType):
            c = F.col(f"`{f.name}`")
            counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).count().withColumn("column", F.lit(f.name))
            rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "v"))
            best = counts.withColumn("rank_", rank).filter(F.col("rank_") <= top)
            parts.append(best.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_", F.concat("v", F.lit("("), F.col("count").cast("string"), F.lit(")")).alias("t")))), lambda s: s["t"]), ", ").alias("top_k")))
    if not parts:
        return base.withColumn("top_k", F.lit(None).cast("string"))
    return base.join(F.broadcast(reduce(DataFrame.unionByName, parts)), "column", "left")  # a row a column
