"""Sums, numbers and latest values along time, for keys that may hold most rows.

A window function sorts all rows of a key in one task. Here time is cut into buckets: within a bucket a window works as usual, and
what came before is carried in from the buckets' totals, of which there are few. Null times are put in the first bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, CARRY = "__bucket", "__carry"


def bucketed(df: DataFrame, time: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, F.coalesce(F.expr(f"`{time}` div {width}"), F.lit(-(2**62))))


def carried(rows: DataFrame, keys: list[str], totals: DataFrame, out: str, merge) -> DataFrame:
    """rows with each bucket's carry merged into the column out."""
    on = rows[BUCKET] == totals["__b"]
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(totals[f"__k{i}"])
    joined = rows.join(totals, on, "left")
    return joined.withColumn(out, merge(F.col(out), F.col(CARRY))).drop(BUCKET, "__b", CARRY, *(f"__k{i}" for i in range(len(keys))))


def _named(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]


def running_sum(df: DataFrame, keys: list[str], time: str, order: list, value: Column, out: str, width: int, inclusive: bool = True) -> DataFrame:
    """The sum of value over the key's rows up to each row (or before it), in the given order, which starts with time."""
    rows = bucketed(df, time, width).withColumn(out, value)
    totals = rows.groupBy(*keys, BUCKET).agg(F.sum(out).alias("__t"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*_named(keys), F.col(BUCKET).alias("__b"), F.sum("__t").over(before).alias(CARRY))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn(out, F.sum(out).over(inside))
    return carried(rows, keys, totals, out, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_number(df: DataFrame, keys: list[str], time: str, order: list, out: str, width: int) -> DataFrame:
    """1, 2, ... for the key's rows in order."""
    return running_sum(df, keys, time, order, F.lit(1).cast("long"), out, width)


def latest(df: DataFrame, keys: list[str], time: str, order: list[str], value: Column, out: str, width: int) -> DataFrame:
    """The last non-null value at or before each row."""
    rows = bucketed(df, time, width).withColumn(out, value)
    at = F.struct(*order)
    totals = rows.where(F.col(out).isNotNull()).groupBy(*keys, BUCKET).agg(F.max_by(out, at).alias("__t"))
    every = rows.select(*keys, BUCKET).distinct()
    joined = every.select(*_named(keys), F.col(BUCKET).alias("__b")).join(totals.select(*(F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)), F.col(BUCKET).alias("__c"), "__t"), _same(len(keys)), "left")
    before = Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = joined.select(*(f"__k{i}" for i in range(len(keys))), "__b", F.last("__t", ignorenulls=True).over(before).alias(CARRY))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.last(out, ignorenulls=True).over(inside))
    return carried(rows, keys, carry, out, lambda a, b: F.coalesce(a, b))


def _same(n: int) -> Column:
    on = F.col("__b") == F.col("__c")
    for i in range(n):
        on = on & F.col(f"__k{i}").eqNullSafe(F.col(f"__j{i}"))
    return on
