"""The relational operators as DataFrame calls: plans are declared, Catalyst and AQE choose how they run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# -- scans -------------------------------------------------------------------------------------------------------------
def scan(df: DataFrame, condition: Column | None = None, columns: Sequence[str] | None = None, cap: int | None = None) -> DataFrame:
    """Rows of a source; condition, columns and cap are pushed into the scan."""
    if condition is not None:
        df = df.filter(condition)
    if columns is not None:
        df = df.select(*columns)
    return df if cap is None else df.limit(cap)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one key; statistics of the row groups skip most of the file where it is sorted by key."""
    return df.filter(F.col(column) == value)


def lookup_range(df: DataFrame, column: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    c = F.col(column)
    if low is not None:
        df = df.filter(c > low if low_open else c >= low)
    if high is not None:
        df = df.filter(c < high if high_open else c <= high)
    return df


# -- joins -------------------------------------------------------------------------------------------------------------
def equi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """inner, left, right or full on equal columns; null keys never match."""
    cond = None
    for a, b in on:
        c = left[a] == right[b]
        cond = c if cond is None else cond & c
    return left.join(right, cond, how)


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """inner, by sorting both sides on their keys: for two large sides, or sides bucketed and sorted by key."""
    return equi_join(left, right.hint("merge"), on)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """On any condition. Give equalities among it where there are any: then only the rest is checked pair by pair."""
    return left.join(right, condition, how)


def semi_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of left with a match: IN, or EXISTS of an equality."""
    return left.join(right.select(F.col(b).alias("__key")), F.col(a) == F.col("__key"), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of left without a match: NOT EXISTS."""
    return left.join(right.select(F.col(b).alias("__key")), F.col(a) == F.col("__key"), "left_anti")


def not_in(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """NOT IN: no row if right holds a null; all rows if right is empty; else rows of non-null key without a match.

    Two counts tell the cases apart, so that the join itself is a plain anti join on the key, which shuffles at any
    size; the null-aware one would need a broadcast of the whole right side.
    """
    keys = right.select(F.col(b).alias("__key"))
    facts = keys.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__key").isNull()).alias("__nulls"))
    rest = anti_join(left, right, a, b)
    with_facts = rest.crossJoin(F.broadcast(facts))  # one row
    keep = (F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(a).isNotNull())
    return with_facts.filter(keep).drop("__n", "__nulls")


# -- aggregation -------------------------------------------------------------------------------------------------------
#: Name of an aggregate to its column expression.
AGGREGATES = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c.cast("double")),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count_distinct": lambda c: F.count_distinct(c),
    "sum_distinct": lambda c: F.sum_distinct(c),
    "avg_distinct": lambda c: F.sum_distinct(c.cast("double")) / F.count_distinct(c),
}


def aggregate(df: DataFrame, by: Sequence[str | Column], calls: Sequence[tuple[str, str | None]], having: Column | None = None) -> DataFrame:
    """Groups with aggregates named count_star, sum_x, ...; without groups one row. Partial sums come before the shuffle."""
    out = [F.count(F.lit(1)).alias("count_star") if c is None else AGGREGATES[f](F.col(c)).alias(f"{f}_{c}") for f, c in calls]
    grouped = df.groupBy(*by).agg(*out)
    return grouped if having is None else grouped.filter(having)


def group_concat(df: DataFrame, by: Sequence[str], column: str, order: str, separator: str = ",") -> DataFrame:
    """Non-null values of each group, joined in the order of a column (a distributed table has no order of its own)."""
    expr = f"listagg(cast(`{column}` as string), '{separator}') within group (order by `{order}`)"
    return df.groupBy(*by).agg(F.expr(expr).alias(f"group_concat_{column}"))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


# -- order -------------------------------------------------------------------------------------------------------------
def ordering(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    """(column, descending): nulls come last ascending and first descending."""
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in keys]


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*ordering(keys))


def top_k(df: DataFrame, keys: Sequence[tuple[str, bool]], k: int, offset: int = 0) -> DataFrame:
    """The first k rows behind offset; each task keeps k + offset rows."""
    out = df.orderBy(*ordering(keys))
    return (out.offset(offset) if offset else out).limit(k)


# -- sets --------------------------------------------------------------------------------------------------------------
def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionAll(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
