"""Message passing over typed edges: relation-wise mean, then maximum over relations; layer updates; pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import vectors as V
from lattica.operators.skew import SALT, HeavyKeys
from lattica.session import broadcast_if_small


def mean_vectors(df: DataFrame, keys: list[str], vec: str, dim: int, name: str = "vec") -> DataFrame:
    """Mean vector per key, number by number. Partial sums are made before the shuffle, and no row is exploded.

    NULL vectors are left out, and so are missing numbers of short vectors.
    """
    means = df.groupBy(*keys).agg(*[F.avg(F.get(vec, F.lit(i))).alias(f"__{i}") for i in range(dim)])
    return means.select(*keys, F.array(*[f"__{i}" for i in range(dim)]).alias(name))


def max_vectors(df: DataFrame, keys: list[str], vec: str, dim: int, name: str = "vec") -> DataFrame:
    tops = df.groupBy(*keys).agg(*[F.max(F.get(vec, F.lit(i))).alias(f"__{i}") for i in range(dim)])
    return tops.select(*keys, F.array(*[f"__{i}" for i in range(dim)]).alias(name))


def relational_messages(nodes: DataFrame, edges: DataFrame, relation_vectors: DataFrame, dim: int, reverse: bool = False, rows_per_part: int = 20_000) -> DataFrame:
    """id and message of every node: the maximum over relations of (mean of the neighbours' vectors x relation vector).

    nodes: id, x. edges: relation, src, dst. relation_vectors: relation, rel. The mean is taken first and multiplied
    once per (node, relation), not per edge. The maximum is signed; a node without edges gets zeros. reverse swaps the
    ends. Nodes that very many edges lead to are salted in the join.
    """
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    ends = edges.select("relation", F.col(src).alias("id"), F.col(dst).alias("other"))
    heavy = HeavyKeys(ends, ["other"], rows_per_part)
    left = heavy.spread(ends, ["id", "relation"])
    right = heavy.replicate(nodes.select(F.col("id").alias("other"), "x"))
    means = mean_vectors(left.join(right, ["other", SALT]), ["id", "relation"], "x", dim, "mean")
    scaled = means.join(broadcast_if_small(relation_vectors), "relation").select("id", V.multiply(F.col("mean"), F.col("rel")).alias("message"))
    best = max_vectors(scaled, ["id"], "message", dim, "message")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return nodes.select("id").join(best, "id", "left").select("id", F.coalesce("message", zeros).alias("message"))


@dataclass
class Layer:
    """Weights of one layer, dim x dim unless said otherwise. Gates of zero make message passing inert."""

    before: np.ndarray
    forward: np.ndarray  # feed-forward
    relation: np.ndarray
    gate: np.ndarray
    reverse_relation: np.ndarray
    reverse_gate: np.ndarray
    alpha: float = 1e-6
    biases: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def seeded(cls, dim: int, seed: int, zero_gates: bool = True) -> Layer:
        rng = np.random.default_rng(seed)
        w = lambda: rng.normal(0, 1 / np.sqrt(dim), (dim, dim))
        gate = lambda: np.zeros((dim, dim)) if zero_gates else w()
        return cls(w(), w(), w(), gate(), w(), gate())


def linear(weights: np.ndarray, bias: np.ndarray | None = None):
    """A column function: weights times vector plus bias, on Arrow batches. The weights travel with the task."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        out = np.stack(v.to_numpy()) @ weights.T
        return pd.Series(list(out if bias is None else out + bias))

    return apply


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def normalized(v: pd.Series) -> pd.Series:
    """vectors.layer_norm in numpy, for what goes on into `linear`: both are then done in one pass of a batch."""
    if not len(v):
        return pd.Series([], dtype=object)
    x = np.stack(v.to_numpy())
    return pd.Series(list((x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)))


def layer_update(nodes: DataFrame, edges: DataFrame, relation_vectors: DataFrame, layer: Layer, dim: int, sequential: bool = False, scaled_messages: bool = False) -> DataFrame:
    """id and x after one layer.

    Parallel form: x + FF(n) + g(n) * M(n) + g'(n) * M'(n), where n is the layer norm of x and M, M' are the messages
    along and against the edges. Sequential form: first x + SiLU(g(n) * M(n) + g'(n) * M'(n)), then
    x + alpha * FF(norm of that). scaled_messages applies alpha to the first step as well.
    """
    normed = nodes.select("id", "x", normalized("x").alias("n"))
    pre = linear(layer.before)(F.col("n"))
    if not sequential:
        pre = F.transform(pre, V.silu)
    sent = normed.select("id", pre.alias("x"))
    total = normed
    for name, reverse, rel, gate in (("a", False, layer.relation, layer.gate), ("b", True, layer.reverse_relation, layer.reverse_gate)):
        turned = relation_vectors.select("relation", linear(rel)(F.col("rel")).alias("rel"))
        messages = relational_messages(sent, edges, turned, dim, reverse).withColumnRenamed("message", name)
        total = total.join(messages, "id").withColumn(name, V.multiply(linear(gate)(F.col("n")), F.col(name)))
    both = V.add(F.col("a"), F.col("b"))
    if not sequential:
        feed = linear(layer.forward)(F.col("n"))
        return total.select("id", V.add(V.add(F.col("x"), feed), both).alias("x"))
    passed = F.transform(both, V.silu)
    moved = total.select("id", V.add(F.col("x"), V.scale(passed, F.lit(layer.alpha)) if scaled_messages else passed).alias("x"))
    feed = linear(layer.forward)(normalized("x"))
    return moved.select("id", V.add(F.col("x"), V.scale(feed, F.lit(layer.alpha))).alias("x"))


def message_passing(nodes: DataFrame, edges: DataFrame, relation_vectors: DataFrame, layers: list[Layer], dim: int, sequential: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """Each layer's number and its normalised output, one after the other."""
    x = nodes
    for i, layer in enumerate(layers):
        x = layer_update(x, edges, relation_vectors, layer, dim, sequential)
        yield i, x.select("id", V.layer_norm(F.col("x")).alias("x"))


def attention_pool(vectors: Column, keys: Column, query: Column, mask: Column, dim: int) -> Column:
    """Sum of the vectors, weighted by the softmax of query . key / sqrt(dim) over the places where mask is true."""
    scores = F.transform(keys, lambda k: V.dot(query, k) / F.lit(float(np.sqrt(dim))))
    return V.weighted_sum(vectors, V.masked_softmax_weights(scores, mask), dim)


def mix_layers(vectors: Column, logits: list[float], dim: int) -> Column:
    """Softmax-weighted sum of the vectors of the last layers."""
    e = np.exp(np.array(logits) - max(logits))
    return V.weighted_sum(vectors, F.array(*[F.lit(float(w)) for w in e / e.sum()]), dim)


@dataclass
class ModelLayer:
    """A layer with what stands around it: pooling of the columns and the update of the task vectors."""

    block: Layer
    pool: np.ndarray  # dim x dim, turns the pooled columns, or from the second layer on the query into a gate
    task: np.ndarray  # dim x dim, what the nodes add to their task vectors

    @classmethod
    def seeded(cls, dim: int, seed: int, zero_gates: bool = True) -> ModelLayer:
        rng = np.random.default_rng(seed + 1_000)
        w = lambda: rng.normal(0, 1 / np.sqrt(dim), (dim, dim))
        return cls(Layer.seeded(dim, seed, zero_gates), w(), w())


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def column_pool(names: dict[str, np.ndarray], weights: np.ndarray, queried: bool):
    """A column function of (entity, columns, query): one vector per row from the vectors of its columns.

    names has the vectors of the column names of each entity, one row per column; these are the keys. Without a query
    they are the queries too, and the mean over them is turned by the weights; with one, the pooled vector is
    multiplied by the turned query. A column that is hidden is given as NULL and has no part; a row with none is zero.
    """

    def pooled(entity: str, columns, query) -> np.ndarray:
        keys = names[entity]
        dim = keys.shape[1]
        seen = np.array([c is not None for c in columns], bool)
        if not seen.any():
            return np.zeros(dim)
        values = np.stack([np.asarray(c, np.float64) for c in columns if c is not None])
        asked = (query[None] if queried else keys) @ keys[seen].T / np.sqrt(dim)
        out = (_softmax(asked) @ values).mean(axis=0)
        return out * (weights @ query) if queried else weights @ out

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(entity: pd.Series, columns: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([pooled(e, c, np.asarray(q, np.float64)) for e, c, q in zip(entity, columns, query)], dtype=object)

    return apply


def run_model(nodes: DataFrame, names: dict[str, np.ndarray], edges: DataFrame, relation_vectors: DataFrame, layers: list[ModelLayer], dim: int, sequential: bool = False) -> DataFrame:
    """id, x: the normalised output of the model over typed nodes.

    nodes: id, entity, columns (ARRAY<ARRAY<DOUBLE>>, one vector per column or NULL where it is hidden) and task, the
    vector of the task or NULL; then the mean of the entity's column names stands in for it. Each layer pools the
    columns, adds what it gets, passes messages and, but for the last one, adds to the task vectors.
    """
    spark = nodes.sparkSession
    means = spark.createDataFrame([(e, v.mean(axis=0).tolist()) for e, v in names.items()], "entity string, __mean array<double>")
    state = nodes.join(F.broadcast(means), "entity").select("id", "entity", "columns", F.coalesce("task", "__mean").alias("task"))
    for i, layer in enumerate(layers):
        pool = column_pool(names, layer.pool, i > 0)("entity", "columns", normalized("task") if i else F.col("task"))
        if i:
            rows = state.withColumn("__pooled", pool).withColumn("x", V.add(F.col("x"), F.col("__pooled"))).drop("__pooled")
        else:
            rows = state.withColumn("x", pool)
        moved = layer_update(rows.select("id", "x"), edges, relation_vectors, layer.block, dim, sequential)
        state = rows.drop("x").join(moved, "id")
        if i < len(layers) - 1:
            state = state.withColumn("__more", linear(layer.task)(normalized("x"))).withColumn("task", V.add(F.col("task"), F.col("__more"))).drop("__more")
    return state.select("id", normalized("x").alias("x"))
