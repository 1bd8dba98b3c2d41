"""Experiment logs to leaderboards; training curves; trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import AVERAGE, METRIC, log_marker


def log_lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, line_no, line: one row per line of each text, numbered from 0."""
    return files.filter(F.col(text).isNotNull()).select(file, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def parse_logs(lines: DataFrame, file: str) -> DataFrame:
    """file, line_no, marker, task, metric, value of the metric lines; averages have the task __avg__ and metric avg.

    A line belongs to the last marker above it in its file; lines before the first marker are left out. A metric whose
    name has other characters than letters, digits and underscores isn't recognised.
    """
    above = Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("own", log_marker(F.col("line"))).withColumn("marker", F.last("own", ignorenulls=True).over(above))
    m, a = F.regexp_like("line", F.lit(METRIC)), F.regexp_like("line", F.lit(AVERAGE))
    part = lambda i: F.regexp_extract("line", METRIC, i)
    rows = marked.filter(F.col("own").isNull() & F.col("marker").isNotNull() & (m | a))
    return rows.select(
        file,
        "line_no",
        "marker",
        F.when(m, part(1)).otherwise("__avg__").alias("task"),
        F.when(m, part(2)).otherwise("avg").alias("metric"),
        F.when(m, part(3)).otherwise(F.regexp_extract("line", AVERAGE, 1)).cast("double").alias("value"),
    )


def latest(parsed: DataFrame, file: str) -> DataFrame:
    """One value per marker and task: the last one of the last file."""
    order = F.struct(F.col(file), F.col("line_no"))
    return parsed.groupBy("marker", "task").agg(F.max_by("metric", order).alias("metric"), F.max_by("value", order).alias("value"))


def marker_number(marker: str):
    """The N of a marker, 0 without one; markers are ordered by it, then by their text."""
    return F.coalesce(F.regexp_extract(marker, r"N=(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def best_of(results: DataFrame) -> DataFrame:
    """Each task's best value and the first marker that reached it."""
    order = Window.partitionBy("task").orderBy(F.desc("value"), marker_number("marker"), "marker")
    return results.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("task", F.col("value").alias("best"), F.col("marker").alias("at"))


def pivot(results: DataFrame, markers: list[str]) -> DataFrame:
    """Tasks by the markers named, in their order."""
    return results.filter(F.col("marker").isin(markers)).groupBy("task").pivot("marker", markers).agg(F.first("value"))


def early_stop(curves: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """run, best, best_epoch, stop_epoch: the first epoch that lies more than `patience` after the best one so far.

    The best is the first of equal values. stop_epoch is NULL for a run that isn't stopped; later epochs don't count.
    """
    so_far = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = curves.filter(F.col(value).isNotNull()).withColumn("top", F.max(value).over(so_far))
    rows = rows.withColumn("since", F.last(F.when(F.col("top") > F.coalesce(F.lag("top").over(Window.partitionBy(run).orderBy(epoch)), F.lit(float("-inf"))), F.col(epoch)), ignorenulls=True).over(so_far))
    stop = F.min(F.when(F.col(epoch) - F.col("since") > patience, F.col(epoch)))
    ends = rows.groupBy(run).agg(stop.alias("stop_epoch"))
    ran = rows.join(ends, run).filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return ran.groupBy(run).agg(F.max("top").alias("best"), F.max("since").alias("best_epoch"), F.first("stop_epoch").alias("stop_epoch"))


def median_pruned(trials: DataFrame, trial: str, step: str, value: str, warmup: int) -> DataFrame:
    """trials with `pruned`: is the value below the median of the earlier trials' values at the same step?

    Not before `warmup` earlier trials have come so far. A study has few trials, so a step is one window.
    """
    before = Window.partitionBy(step).orderBy(trial).rowsBetween(Window.unboundedPreceding, -1)
    median, n = F.percentile(value, 0.5).over(before), F.count(value).over(before)
    return trials.withColumn("pruned", (n >= warmup) & (F.col(value) < median))


def keep_best(scores: DataFrame, keys: list[str], value: str, checkpoint: str) -> DataFrame:
    """The checkpoint to keep per key; ties go to the first by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), checkpoint)
    return scores.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
