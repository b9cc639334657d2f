"""Order-dependent computations that do not need a whole key, or table, in one task.

A plain window sorts every row of its key in one task. Here the order column cuts each key
into buckets: windows run per (key, bucket), and what a bucket needs from the earlier ones
(a row count, a sum, a last value) comes from one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.col(order) / F.lit(width)))


def _carry(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    per = df.groupBy(*keys, "__bucket").agg(*[c.alias(n) for n, c in aggs.items()])
    return per.withColumnRenamed("__bucket", "__cb")


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carry.select(*[F.col(k).alias(f"__ck_{k}") for k in keys], *[c for c in carry.columns if c not in keys])
    cond = F.col("__bucket") == F.col("__cb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__ck_{k}"))
    return df.join(renamed, cond, "left").drop("__cb", *[f"__ck_{k}" for k in keys])


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], *, width: int, inclusive: bool = True
) -> DataFrame:
    """Running sums per key in ascending ``order`` (a number unique within the key)."""
    b = _bucketed(df, order, width)
    for name, col in sums.items():
        b = b.withColumn(f"__v_{name}", F.coalesce(col, F.lit(0)))
    carry = _carry(b, keys, {f"__c_{n}": F.sum(f"__v_{n}") for n in sums})
    earlier = Window.partitionBy(*keys).orderBy("__cb").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *keys, "__cb", *[F.coalesce(F.sum(f"__c_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    end = 0 if inclusive else -1
    frame = inside.rowsBetween(Window.unboundedPreceding, end)
    out = _join_carry(b, carry, keys)
    for n in sums:
        out = out.withColumn(n, F.col(f"__c_{n}") + F.coalesce(F.sum(f"__v_{n}").over(frame), F.lit(0)))
    return out.drop("__bucket", *[f"__v_{n}" for n in sums], *[f"__c_{n}" for n in sums])


def previous_values(
    df: DataFrame, keys: list[str], order: str, values: dict[str, str], *, width: int
) -> DataFrame:
    """The value of the previous row of the key; null on the first row."""
    b = _bucketed(df, order, width)
    carry = _carry(b, keys, {f"__c_{n}": F.max_by(F.struct(F.col(v).alias("v")), F.col(order)) for n, v in values.items()})
    by_bucket = Window.partitionBy(*keys).orderBy("__cb")
    carry = carry.select(
        *keys, "__cb", *[F.lag(f"__c_{n}").over(by_bucket).alias(f"__c_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    out = _join_carry(b, carry, keys)
    for n, v in values.items():
        first = F.row_number().over(inside) == 1
        out = out.withColumn(n, F.when(first, F.col(f"__c_{n}")["v"]).otherwise(F.lag(v).over(inside)))
    return out.drop("__bucket", *[f"__c_{n}" for n in values])


def row_numbers(df: DataFrame, order: str, name: str, *, width: int) -> DataFrame:
    """1-based position of every row of the table in ascending ``order`` (unique numbers)."""
    return running_sums(df, [], order, {name: F.lit(1).cast("long")}, width=width)
