"""Work on keys of very uneven size: heavy-key detection, two-stage salted aggregation, salted joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT = "__salt"
PARTS = "__parts"

#: A key is heavy from this many rows on, or from 1/MAX_HEAVY of all rows on, whichever is more. So there are never
#: more than MAX_HEAVY heavy keys, which bounds the list that is collected and broadcast.
ROWS_PER_PART = 20_000
MAX_HEAVY = 8_192


class HeavyKeys:
    """The heavy keys of a table with the number of parts that each is split into.

    counts: key columns and `count`. The list is at most max_heavy rows, whatever the data.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], rows_per_part: int = ROWS_PER_PART, max_heavy: int = MAX_HEAVY, max_parts: int = 4_096):
        self.keys = list(keys)
        total = df.count()
        self.limit = max(rows_per_part, -(-total // max_heavy))
        self.rows = []
        if total >= self.limit:
            counted = df.groupBy(*self.keys).count().filter(F.col("count") >= self.limit)
            parts = F.least(F.ceil(F.col("count") / F.lit(float(self.limit))) + 1, F.lit(max_parts)).cast("int")
            self.rows = counted.select(*self.keys, parts.alias(PARTS)).collect()
        self.schema = df.select(*self.keys).schema.add(PARTS, T.IntegerType())
        self.spark = df.sparkSession

    def joined(self, other: HeavyKeys) -> HeavyKeys:
        """These heavy keys and those of another table with the same keys; the larger number of parts counts."""
        parts = {tuple(r[k] for k in self.keys): r[PARTS] for r in self.rows}
        for r in other.rows:
            key = tuple(r[k] for k in other.keys)
            parts[key] = max(r[PARTS], parts.get(key, 0))
        self.rows = [(*k, n) for k, n in parts.items()]
        return self

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.schema)

    def parts(self, df: DataFrame) -> DataFrame:
        """df with PARTS: 1 for ordinary keys. NULL keys match like any value."""
        if not self.rows:
            return df.withColumn(PARTS, F.lit(1))
        renamed = self.frame().toDF(*[f"__h{i}" for i in range(len(self.keys))], PARTS)
        on = None
        for i, k in enumerate(self.keys):
            c = df[k].eqNullSafe(renamed[f"__h{i}"])
            on = c if on is None else on & c
        return df.join(F.broadcast(renamed), on, "left").drop(*[f"__h{i}" for i in range(len(self.keys))]).withColumn(PARTS, F.coalesce(PARTS, F.lit(1)))

    def spread(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        """df with SALT: a part number from the hash of the columns `by` for heavy keys, else 0."""
        if not self.rows:
            return df.withColumn(SALT, F.lit(0))
        return self.parts(df).withColumn(SALT, F.when(F.col(PARTS) > 1, F.pmod(F.xxhash64(*by), F.col(PARTS)).cast("int")).otherwise(0)).drop(PARTS)

    def replicate(self, df: DataFrame) -> DataFrame:
        """df with SALT: one row for each part of its key, to be joined with the result of `spread`."""
        if not self.rows:
            return df.withColumn(SALT, F.lit(0))
        return self.parts(df).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.col(PARTS) - 1))).drop(PARTS)


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    partial: Mapping[str, Column],
    merge: Mapping[str, Column],
    row_id: str,
    rows_per_part: int = ROWS_PER_PART,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Per-key results with the work evenly spread, whatever share of the rows a key owns.

    Stage 1 appends a salt to the heavy keys and computes `partial` per (key, salt); stage 2 computes `merge` from
    the partials per key. The salt is a hash of `row_id` and not a random number: a task that is run again after an
    executor was lost then gives the same rows to the same part, and rows delivered twice meet in one part, where all
    but one are dropped.

    `values` are the columns that the aggregates read. Rows equal in keys, row_id and values count once; so rows
    without a row_id count once if they are equal otherwise. Rows with a NULL in any key have no key and are left out.
    An empty table gives an empty result. Other columns aren't read, whatever their names; keys and values must not
    be named __salt or __parts.
    """
    rows = df.select(*dict.fromkeys([*keys, row_id, *values]))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    heavy = heavy or HeavyKeys(rows, keys, rows_per_part)
    salted = heavy.spread(rows, [row_id]).repartition(*keys, SALT)
    first = salted.dropDuplicates().groupBy(*keys, SALT).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
