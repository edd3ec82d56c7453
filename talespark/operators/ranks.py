"""Ranks within keys, without a window over a key's rows.

Rows are sorted once over all tasks, by key and order, in ranges. A key's rows are a run of
neighbouring tasks; a row's rank is the count of the key's rows in the tasks before its own
plus its place in the task. So one key may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talespark.sources.tables import written


def ranked(rows: DataFrame, key: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` and ``name`` (long, from 1): the row number within ``key`` by ``order``. Null
    keys are one key; rows that the order does not tell apart follow each other in any way.
    The sorted rows are written once. An empty table gives no rows."""
    by = [*key, *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    x = written(ordered.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranked")
    w = Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = x.groupBy(*key, "_task").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    runs = runs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_task").alias("_t"), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)), F.col("_task") == F.col("_t"))
    return x.join(runs, same).select(*rows.columns, (F.col("_place") + F.col("_shift")).alias(name))


def turns_served(counts: dict[int, int], n: int) -> int:
    """The smallest number of turns in which ``n`` rows, or all, are served, if each turn
    serves one row of each key that has any left. ``counts``: rows of a key to number of keys."""
    keys, served, turn = sum(counts.values()), 0, 0
    for size in sorted(counts):
        if served + keys * (size - turn) >= n:
            return turn + max(0, -(-(n - served) // keys))
        served, turn = served + keys * (size - turn), size
        keys -= counts[size]
    return turn


def turns_left(counts: dict[int, int], n: int) -> int:
    """The largest number of first turns that leave ``n`` rows or more to later turns; 0 if
    there are no more than ``n``."""
    keys, left, before = 0, 0, None
    for size in sorted(counts, reverse=True):
        if before is not None and left + keys * (before - size) >= n:
            return before - -(-(n - left) // keys)
        left, before = left + keys * ((before or size) - size), size
        keys += counts[size]
    return max(0, before - -(-(n - left) // keys)) if before else 0


def key_sizes(rows: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """(key, n) and how many keys have n rows. Different sizes are fewer than the square
    root of twice the rows, so they are brought to the driver."""
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("n")), "key-sizes")
    return sizes, {r["n"]: r["keys"] for r in sizes.groupBy("n").agg(F.count("*").alias("keys")).collect()}
