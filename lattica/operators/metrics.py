"""Metrics of predictions per task; all are better when higher.

Rows with a NULL or NaN label, or without a prediction, are left out. A metric that isn't defined, as the AUROC of a
single class, is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.operators.ordering import running_sums

METRICS = ("rmse", "mae", "hr@1", "retrieval_auroc", "retrieval_logloss")


def valid(label: Column) -> Column:
    """Not NULL, not NaN."""
    return label.isNotNull() & ~F.isnan(label.cast("double"))


def rmse(rows: DataFrame, keys: list[str], predicted: str, label: str) -> DataFrame:
    return rows.filter(valid(F.col(label))).groupBy(*keys).agg((-F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(label), F.lit(2.0))))).alias("score"))


def mae(rows: DataFrame, keys: list[str], predicted: str, label: str) -> DataFrame:
    return rows.filter(valid(F.col(label))).groupBy(*keys).agg((-F.avg(F.abs(F.col(predicted) - F.col(label)))).alias("score"))


def hit_rate(rows: DataFrame, keys: list[str], logits: str, label: str) -> DataFrame:
    hit = (V.argmax(F.col(logits)) == F.col(label)).cast("double")
    return rows.filter(valid(F.col(label)) & (F.col(label) >= 0)).groupBy(*keys).agg(F.avg(hit).alias("score"))


def logloss(rows: DataFrame, keys: list[str], logits: str, label: str) -> DataFrame:
    """Minus the cross-entropy of logits. Probabilities must be turned into logarithms first."""
    return rows.filter(valid(F.col(label)) & (F.col(label) >= 0)).groupBy(*keys).agg((-F.avg(V.cross_entropy(F.col(logits), F.col(label)))).alias("score"))


def auroc_binary(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the curve by the rank sum, ties counted half.

    Rows are first counted per distinct score, so ties of any number cost nothing, and the running sum over the
    distinct scores is made in ranges.
    """
    flag = positive.cast("int")
    counts = rows.filter(flag.isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("__score"))
    per = counts.agg(F.sum(flag).cast("bigint").alias("__pos"), F.sum(1 - flag).cast("bigint").alias("__neg"))
    summed = running_sums(per, keys, "__score", ["__neg"])
    wins = F.sum(F.col("__pos") * (F.col("before___neg") + F.col("__neg") / 2.0))
    pairs = (F.sum("__pos") * F.sum("__neg")).cast("double")
    return summed.groupBy(*keys).agg(wins.alias("__w"), pairs.alias("__p")).select(*keys, (F.col("__w") / F.nullif(F.col("__p"), F.lit(0.0))).alias("score"))


def auroc_multiclass(rows: DataFrame, keys: list[str], logits: str, label: str) -> DataFrame:
    """Mean over the classes of one class against the rest, by softmax probabilities; undefined classes are left out."""
    p = rows.filter(valid(F.col(label))).select(*keys, label, F.posexplode(V.softmax(F.col(logits))).alias("__class", "__p"))
    one = auroc_binary(p, [*keys, "__class"], "__p", F.col("__class") == F.col(label))
    return one.groupBy(*keys).agg(F.avg("score").alias("score"))


def evaluate(rows: DataFrame, keys: list[str], metric: str, predicted: str, label: str) -> DataFrame:
    """One of METRICS by its name; an unknown name is an error."""
    known = {"rmse": rmse, "mae": mae, "hr@1": hit_rate, "retrieval_auroc": auroc_multiclass, "retrieval_logloss": logloss}
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    return known[metric](rows, keys, predicted, label)


def target_statistics(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """center and spread (population deviation + 1e-6) of the labels; NULL with fewer than two."""
    good = F.when(valid(F.col(label)), F.col(label))
    enough = F.count(good) >= 2
    return rows.groupBy(*keys).agg(F.count(good).alias("n"), F.when(enough, F.avg(good)).alias("center"), F.when(enough, F.stddev_pop(good) + 1e-6).alias("spread"))


def task_average(scores: DataFrame, score: str = "score") -> DataFrame:
    """The plain mean over tasks, whatever their metrics; so it mixes scales."""
    return scores.agg(F.avg(score).alias("average"))
