"""Weights of layers as tables: saving, loading, and keeping only the best."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.leaderboard import keep_best
from lattica.operators.message import Layer

SCHEMA = "checkpoint string, layer int, name string, row int, weights array<double>"


def _matrices(layer: Layer) -> list[tuple[str, np.ndarray]]:
    return [(f.name, v) for f in fields(layer) if isinstance(v := getattr(layer, f.name), np.ndarray)] + [("alpha", np.array([[layer.alpha]]))]


def save_layers(spark: SparkSession, path: str, checkpoint: str, layers: list[Layer]) -> None:
    """Appends a checkpoint; one of the same name must not be there yet, or load_layers gets both."""
    rows = [(checkpoint, i, name, r, v.tolist()) for i, layer in enumerate(layers) for name, m in _matrices(layer) for r, v in enumerate(m)]
    spark.createDataFrame(rows, SCHEMA).write.mode("append").partitionBy("checkpoint").parquet(path)


def load_layers(spark: SparkSession, path: str, checkpoint: str) -> list[Layer]:
    rows = spark.read.schema(SCHEMA).parquet(path).filter(F.col("checkpoint") == checkpoint).orderBy("layer", "name", "row").collect()
    if not rows:
        raise KeyError(f"no checkpoint {checkpoint}")
    matrices: dict[tuple[int, str], list] = {}
    for r in rows:
        matrices.setdefault((r["layer"], r["name"]), []).append(r["weights"])
    layers = []
    for i in range(1 + max(k for k, _ in matrices)):
        own = {n: np.array(m) for (k, n), m in matrices.items() if k == i}
        layers.append(Layer(**own | {"alpha": float(own["alpha"][0, 0])}))
    return layers


def best_only(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows of the checkpoint with the highest score; scores has checkpoint and value."""
    return weights.join(F.broadcast(keep_best(scores, [], "value", "checkpoint").select("checkpoint")), "checkpoint", "left_semi")
