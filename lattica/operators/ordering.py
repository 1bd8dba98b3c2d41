"""Global ranks and running sums without a window over all rows.

A window without a fine partition sorts all its rows in one task. Here the order is cut into ranges first; the ranges'
totals, a bounded number, give each range its offset, and the window runs within a range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges by the first hexadecimal digits of a hash.
HASH_DIGITS = 3
RANGES = 64


def hash_order(*parts: Column | str) -> Column:
    """A reproducible random order: the MD5 of the parts."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return on


def _offset(df: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum over all earlier ranges (`__range`) of the same keys."""
    totals = df.groupBy(*keys, "__range").agg(*[c.alias(f"__{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__range_"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums]
    )
    joined = df.join(offsets, _same(df, offsets, keys) & (df["__range"] == offsets["__range_"]))
    return joined.drop("__range_", *[f"__{k}" for k in keys])


def hash_rank(df: DataFrame, keys: Sequence[str], order: Column, ties: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """df with `name`: 1, 2, ... per key by the hash `order` (hexadecimal), then by the columns `ties`.

    Hashes fall evenly into the ranges, so a key that holds most rows is ranked by as many tasks as there are ranges.
    NULL keys form a key of their own. Rows equal in hash and ties are numbered in any order.
    """
    keys = list(keys)
    hashed = df.withColumn("__hash", order).withColumn("__range", F.substring("__hash", 1, HASH_DIGITS))
    within = Window.partitionBy(*keys, "__range").orderBy("__hash", *ties)
    ranked = _offset(hashed, keys, {"n": F.count(F.lit(1))}).withColumn(name, (F.row_number().over(within) + F.col("__before_n")).cast("bigint"))
    return ranked.drop("__hash", "__range", "__before_n")


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """df with `before_<value>`: the sum of each value over the rows of the same keys with a smaller `order`.

    `order` must be numeric and differ between the rows of a key; NULLs come first. Ranges are cut at quantiles.
    """
    keys, values = list(keys), list(values)
    cuts = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], F.lit(1000))).first()[0] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    cut = df.withColumn("__range", F.coalesce(F.size(F.filter(edges, lambda e: e < F.col(order))), F.lit(0)))
    within = Window.partitionBy(*keys, "__range").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    summed = _offset(cut, keys, {v: F.sum(v) for v in values})
    for v in values:
        summed = summed.withColumn(f"before_{v}", F.col(f"__before_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)))
    return summed.drop("__range", *[f"__before_{v}" for v in values])
