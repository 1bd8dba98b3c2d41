"""Merging datasets: the second wins, unless values must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_override(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both; rows of the second in place of the first's. A key repeated in one of them keeps its rows.

    NULL keys match each other.
    """
    held = second.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & first[k].eqNullSafe(held[f"__{k}"])
    return first.join(held, on, "left_anti").unionByName(second)


def conflicts(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The keys that both have with different values."""
    a = first.select(*keys, F.struct(*values).alias("__a"))
    b = second.select(*keys, F.struct(*values).alias("__b"))
    return a.join(b, keys).filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys)


def merge_checked(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """merge_override of tables that must agree on the keys that both have; raises an error where they don't."""
    different = conflicts(first, second, keys, values).limit(5).collect()
    if different:
        raise ValueError(f"different values for {[tuple(r) for r in different]}")
    return merge_override(first, second, keys)
