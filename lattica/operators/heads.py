"""Heads: class scoring, nearest neighbours in a context, linear probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.session import broadcast_if_small

#: In-context classifiers that take no more classes than this are not fine-tuned beyond it.
FINE_TUNED_CLASSES = 10
MAX_CONTEXT = 100_000


def class_scores(seeds: DataFrame, classes: DataFrame, seed_vec: str = "x", class_vec: str = "c") -> DataFrame:
    """seed columns with `logits`: the products with all class vectors, in the order of class_id.

    The classes, of which there are few, become one row of an array, so a seed isn't multiplied by its classes.
    """
    all_classes = classes.agg(F.array_sort(F.collect_list(F.struct("class_id", class_vec))).alias("__all"))
    logits = F.transform("__all", lambda k: V.dot(F.col(seed_vec), k[class_vec]))
    return seeds.withColumn("__all", all_classes.scalar()).withColumn("logits", logits).drop("__all")


def mode(classes: int, fine_tuned: bool) -> str:
    """Fine-tuning falls back to zero-shot beyond FINE_TUNED_CLASSES classes."""
    return "fine-tuned" if fine_tuned and classes <= FINE_TUNED_CLASSES else "zero-shot"


class NearestNeighbors:
    """An in-context head: fit(context) keeps a bounded context, predict(rows) averages the k nearest of it."""

    def __init__(self, k: int = 5, classes: int = 0):
        self.k, self.classes = k, classes

    def fit(self, context: DataFrame, vec: str, label: str, row: str) -> NearestNeighbors:
        """The context must have at most MAX_CONTEXT rows; take a stratified_context before."""
        held = context.select(F.col(row).cast("bigint").alias("row"), F.col(vec).cast("array<double>").alias("vec"), F.col(label).cast("double").alias("label")).limit(MAX_CONTEXT + 1).toArrow()
        if held.num_rows > MAX_CONTEXT:
            raise ValueError(f"the context has more than {MAX_CONTEXT} rows")
        held = held.sort_by("row").combine_chunks()
        x = np.array(held["vec"].to_pylist(), np.float64)
        model = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), held["label"].to_numpy())
        self.shared = context.sparkSession.sparkContext.broadcast(model)
        return self

    def predict(self, rows: DataFrame, row: str, vec: str) -> DataFrame:
        """row and `prediction` (mean label), or `probabilities` of each class if there are classes.

        The nearest by cosine, ties by the smaller context row; a context smaller than k is used whole.
        """
        shared, k, classes = self.shared, self.k, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = shared.value
            for batch in batches:
                q = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
                near = np.argsort(-np.round(q @ x.T, 12), axis=1, kind="stable")[:, :k]
                if classes:
                    p = (y[near][:, :, None] == np.arange(classes)).mean(axis=1)
                    result = pa.array(list(p), pa.list_(pa.float64()))
                else:
                    result = pa.array(y[near].mean(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), result], names=["row", "out"])

        kind = "array<double>" if classes else "double"
        out = rows.select(F.col(row).cast("bigint").alias("row"), F.col(vec).cast("array<double>")).mapInArrow(run, f"row bigint, out {kind}")
        return out.select(F.col("row").alias(row), F.col("out").alias("probabilities" if classes else "prediction"))


def ridge_probe(train: DataFrame, vec: str, label: str, dim: int, strength: float = 1.0) -> np.ndarray:
    """Weights of a linear probe, the last one its offset: normal equations summed up where the rows lie.

    Each partition gives one matrix of (dim + 2) squared numbers, and these are added up in the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 2, dim + 2))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), np.float64)
                z = np.hstack([x, np.ones((len(x), 1)), batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total += z.T @ z
        n = dim + 2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.reshape(-1))], names=["i", "v"])

    good = train.filter(F.col(vec).isNotNull() & F.col(label).isNotNull() & (F.size(vec) == dim))
    parts = good.select(F.col(vec).cast("array<double>"), F.col(label).cast("double")).mapInArrow(run, "i bigint, v double")
    z = np.zeros((dim + 2) ** 2)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        z[r["i"]] = r["v"]
    z = z.reshape(dim + 2, dim + 2)
    penalty = strength * np.eye(dim + 1)
    penalty[-1, -1] = 0
    return np.linalg.solve(z[:-1, :-1] + penalty + 1e-9 * np.eye(dim + 1), z[:-1, -1])


def probe_scores(rows: DataFrame, vec: str, weights: np.ndarray, name: str = "prediction") -> DataFrame:
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    return rows.withColumn(name, V.dot(F.col(vec).cast("array<double>"), w) + F.lit(float(weights[-1])))


def lookup(rows: DataFrame, code: str, dictionary: DataFrame, key: str = "code") -> DataFrame:
    """rows with the entry of a dictionary: each distinct code is looked up once, small dictionaries are broadcast."""
    entries = broadcast_if_small(dictionary)
    return rows.join(entries, rows[code] == dictionary[key], "left")
