"""Task tables: splits in one table, labels and classes from stored references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.ordering import hash_order, hash_rank, running_sums


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """One table with the column split, from a table per split. Columns that a split lacks are NULL."""
    out = None
    for split, rows in parts.items():
        marked = rows.withColumn("split", F.lit(split))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out


def retrieval_rows(refs: DataFrame, pairs: str = "node_pairs", label: str = "labels", split: str = "split") -> DataFrame:
    """refs with row and class_id from the pair (row, class).

    Outside of train only pairs whose label is 1 are kept; train keeps all its pairs, whatever their label. Rows
    without a whole pair are left out.
    """
    whole = refs.filter(F.size(pairs) >= 2).withColumns({"row": F.get(pairs, F.lit(0)), "class_id": F.get(pairs, F.lit(1))})
    return whole.filter((F.col(split) == "train") | (F.col(label) == 1))


def split_sizes(rows: DataFrame, row_id: str, label: str, ts: str) -> DataFrame:
    """Per task and split: rows, and how many of them have an id, a label and a time."""
    good = F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))
    return rows.groupBy("task", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(row_id).alias("n_ids"), F.count_if(good).alias("n_labels"), F.count(ts).alias("n_times")
    )


def masked(rows: DataFrame, columns: list[str], is_seed: str) -> DataFrame:
    """rows with the columns hidden where is_seed is true; a NULL is_seed doesn't hide."""
    hide = F.coalesce(F.col(is_seed), F.lit(False))
    return rows.withColumns({c: F.when(~hide, F.col(c)) for c in columns})


def unified(parts: list[tuple[str, DataFrame, str]], root: str) -> tuple[DataFrame, DataFrame]:
    """All entities in one index space, the root entity first: (entity, row_id, position) and (entity, n, offset).

    parts: entity, rows, id column. Within an entity positions follow the id, which must be unique.
    """
    ordered = sorted(parts, key=lambda p: p[0] != root)
    all_rows = None
    for i, (entity, rows, key) in enumerate(ordered):
        part = rows.select(F.lit(entity).alias("entity"), F.lit(i).alias("__place"), F.col(key).cast("bigint").alias("row_id"))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    sizes = all_rows.groupBy("entity", "__place").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_sums(sizes, [], "__place", ["n"]).select("entity", "n", F.col("before_n").cast("bigint").alias("offset"))
    one = running_sums(all_rows.withColumn("__one", F.lit(1).cast("bigint")), ["entity"], "row_id", ["__one"])
    placed = one.join(F.broadcast(offsets), "entity").select("entity", "row_id", (F.col("before___one") + F.col("offset")).cast("bigint").alias("position"))
    return placed, offsets


def dictionary(rows: DataFrame, value: str) -> DataFrame:
    """value and code: the distinct values numbered from 0, in the order of their hash. NULL has no code."""
    distinct = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()
    return hash_rank(distinct, [], hash_order("value"), ["value"]).select("value", (F.col("rn") - 1).cast("bigint").alias("code"))
