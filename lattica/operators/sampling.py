"""Row sampling and batches, by hashes: the same rows in every run and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.ordering import hash_order, hash_rank


def hash_number(*parts: Column | str) -> Column:
    """A number below 2**32 from the MD5 of the parts."""
    return F.conv(F.substring(hash_order(*parts), 1, 8), 16, 10).cast("bigint")


def batches(rows: DataFrame, task: str, row: str, size: int, seed: str | None = None) -> DataFrame:
    """task, batch_id, slot, row: batches of one task each. Shuffled by a hash if a seed is given, else in row order.

    A last batch that isn't full has fewer slots; no padding rows are made.
    """
    order = hash_order(F.lit(seed), task, row) if seed is not None else F.lpad(F.hex(row), 16, "0")
    ranked = hash_rank(rows, [task], order, [row]) if seed is not None else _row_rank(rows, task, row)
    place = F.col("rn") - 1
    return ranked.select(task, F.floor(place / size).cast("bigint").alias("batch_id"), (place % size).cast("int").alias("slot"), row)


def _row_rank(rows: DataFrame, task: str, row: str) -> DataFrame:
    from lattica.operators.ordering import running_sums

    one = rows.withColumn("__one", F.lit(1).cast("bigint"))
    return running_sums(one, [task], row, ["__one"]).withColumn("rn", F.col("before___one") + 1).drop("__one", "before___one")


def sample_ratio(rows: DataFrame, task: str, row: str, ratio: float, seed: str) -> DataFrame:
    """Exactly floor(n * ratio) rows of each task."""
    n = rows.groupBy(F.col(task).alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = hash_rank(rows, [task], hash_order(F.lit(seed), task, row), [row])
    return ranked.join(n, F.col(task).eqNullSafe(F.col("__task"))).filter(F.col("rn") <= F.floor(F.col("__n") * ratio)).drop("rn", "__n", "__task")


def sample_number(rows: DataFrame, task: str, row: str, number: int, seed: str) -> DataFrame:
    """min(n, number) rows of each task."""
    return hash_rank(rows, [task], hash_order(F.lit(seed), task, row), [row]).filter(F.col("rn") <= number).drop("rn")


def sample_with_replacement(rows: DataFrame, task: str, row: str, ratios: dict[str, float], default: float, seed: str) -> DataFrame:
    """floor(n * ratio of the task) draws with replacement: task, draw, row.

    The rows are numbered, the draws made as numbers, and both joined; a number drawn several times comes out as often.
    """
    ratio = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in ratios.items() for x in (k, float(v))]), F.col(task)), F.lit(default)) if ratios else F.lit(default)
    numbered = hash_rank(rows, [task], hash_order(task, row), [row]).select(task, row, F.col("rn").alias("number"))
    sizes = rows.groupBy(task).agg(F.count(F.lit(1)).alias("n")).withColumn("draws", F.floor(F.col("n") * ratio))
    #: Draws are made in blocks, so that a large task's sequence isn't exploded by one task from one row.
    block = 10_000
    blocks = sizes.filter(F.col("draws") > 0).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("draws") - 1) / block)))).repartition(task, "b")
    first = F.col("b") * block
    draws = blocks.withColumn("draw", F.explode(F.sequence(first, F.least(first + block, F.col("draws")) - 1)))
    drawn = draws.select(task, "draw", (hash_number(F.lit(seed), task, "draw") % F.col("n") + 1).alias("number"))
    return drawn.join(numbered, [task, "number"]).select(task, "draw", row)


def is_classification(labels: DataFrame, label: str) -> Column:
    """An aggregate: are all labels whole numbers? NULL labels are ignored; NULL if there are none."""
    return F.bool_and(F.col(label) == F.floor(label))


def stratified_context(rows: DataFrame, row: str, label: str, limit: int, seed: str) -> DataFrame:
    """A context of at most `limit` rows for a classifier: as many of each class as fit evenly, the rest at random.

    All rows if there are no more than limit. Labels that aren't all whole numbers give a plain random sample. First
    max(1, floor(limit / classes)) rows of each class by the hash of the row, then others by the same hash.
    """
    n, classes, whole = rows.agg(F.count(F.lit(1)), F.count_distinct(label), is_classification(rows, label)).first()
    if n <= limit:
        return rows
    order = hash_order(F.lit(seed), row)
    if not whole:
        return hash_rank(rows, [], order, [row]).filter(F.col("rn") <= limit).drop("rn")
    each = max(1, limit // max(classes, 1))
    w = Window.partitionBy(label).orderBy("__order", row)
    first = rows.withColumn("__order", order).withColumn("__first", F.row_number().over(w)).filter(F.col("__first") <= each)
    taken = first.select(row)
    room = limit - taken.count()
    rest = hash_rank(rows.join(taken, row, "left_anti"), [], order, [row]).filter(F.col("rn") <= max(room, 0)).drop("rn")
    chosen = first.drop("__order", "__first").unionByName(rest)
    return chosen if room >= 0 else hash_rank(chosen, [], order, [row]).filter(F.col("rn") <= limit).drop("rn")


def history_draws(seeds: DataFrame, row: str, fanout: int, seed: str) -> DataFrame:
    """Few-shot examples: seed, draw, example. fanout draws with replacement among the rows before the seed's row.

    Rows are numbered from 0 in the order of their time; the row 0 has no history and no examples. NULL rows neither.
    """
    draws = seeds.filter(F.col(row) > 0).select(F.col(row).alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("draw"))
    return draws.select("seed", "draw", (hash_number(F.lit(seed), "seed", "draw") % F.col("seed")).alias("example"))


def rerank(candidates: DataFrame, group: Sequence[str], score: Column, ties: Sequence[str], keep: int) -> DataFrame:
    """The `keep` best candidates of each group by score, with their rank."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last("score"), *ties)
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
