"""Column expressions on vectors (ARRAY<DOUBLE>), logits and losses. All stay inside the JVM.

A NULL vector or number gives NULL. Vectors of different lengths have no product: dot and what builds on it give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda it would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def cosine(a: Column, b: Column) -> Column:
    """NULL if either vector is zero."""
    return bind(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance, without learned scale."""
    #: Not one bind inside another: a Python function can't take an argument whose lambdas are nested that deep.
    variance = bind(mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))
    both = F.struct(mean(v).alias("m"), F.sqrt(variance + eps).alias("s"))
    return F.when(v.isNotNull(), bind(both, lambda p: F.transform(v, lambda x: (x - p["m"]) / p["s"])))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(v: Column, k: Column | float) -> Column:
    return F.transform(v, lambda x: x * k)


def matrix_times(matrix: list[list[float]], v: Column) -> Column:
    """A small fixed matrix, given row by row, times a vector."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return F.transform(rows, lambda r: dot(r, v))


def category_encoding(code: Column, dim: int) -> Column:
    """cos(code * f) for dim frequencies f from 0.01 to 10, evenly spaced in the logarithm."""
    steps = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.transform(steps, lambda i: F.cos(code.cast("double") * F.pow(F.lit(10.0), F.lit(-2.0) + 3.0 * i / F.lit(float(max(dim - 1, 1))))))


def numeric_encoding(x: Column, dim: int) -> Column:
    """The default encoder of numbers: sines and cosines of asinh(x) at dim frequencies, layer-normalised.

    The weights of the trained encoder aren't public, so any Column -> Column function can be passed in its place.
    """
    y = F.asinh(x.cast("double"))
    wave = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sin(y * F.pow(F.lit(2.0), F.floor(i / 2) - 2) + F.when(i % 2 == 1, math.pi / 2).otherwise(0.0)))
    return layer_norm(wave)


def numeric_decoding(v: Column, weights: Column) -> Column:
    return dot(layer_norm(v), weights)


def log_sum_exp(v: Column) -> Column:
    return bind(F.array_max(v), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def softmax(v: Column) -> Column:
    return bind(log_sum_exp(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))


def argmax(v: Column) -> Column:
    """0-based; the lowest index of those that tie."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the label; NULL for a label outside of the classes."""
    return log_sum_exp(logits) - F.get(logits, label.cast("int"))


def focal_loss(logits: Column, label: Column, gamma: float = 2.0, alpha: list[float] | None = None) -> Column:
    ce = cross_entropy(logits, label)
    loss = F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
    return loss * F.get(F.array(*[F.lit(float(a)) for a in alpha]), label.cast("int")) if alpha else loss


def huber_loss(predicted: Column, label: Column, delta: float = 1.0) -> Column:
    miss = F.abs(predicted - label)
    return F.when(miss <= delta, 0.5 * miss * miss).otherwise(delta * (miss - 0.5 * delta))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def erf(x: Column) -> Column:
    """Error function by the rational approximation 7.1.26 of Abramowitz and Stegun; off by at most 1.5e-7."""
    #: Fixed values of that formula.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    series = F.lit(0.0)
    for c in reversed(a):
        series = (series + c) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2.0)))


def gated(gate: Column, v: Column) -> Column:
    """SiLU of the gate times the vector, number by number."""
    return F.zip_with(gate, v, lambda g, x: silu(g) * x)


def onehot_logits(index: Column, classes: int, height: float = 10.0) -> Column:
    """height at the index and -height elsewhere; all -height for an index outside of the classes or NULL."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i.eqNullSafe(index), F.lit(height)).otherwise(F.lit(-height)))


def onehot_mask(index: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: i == index)


def zscore(x: Column, center: Column, spread: Column) -> Column:
    """x as it is where there are no statistics."""
    return F.coalesce((x - center) / spread, x)


def unzscore(z: Column, center: Column, spread: Column) -> Column:
    return F.coalesce(z * spread + center, z)


def masked_softmax_weights(scores: Column, mask: Column) -> Column:
    """Softmax over the places where mask is true; 0 elsewhere; all 0 if none is."""
    low = F.lit(float("-inf"))
    kept = F.zip_with(scores, mask, lambda s, m: F.when(m, s).otherwise(low))
    zeros = F.transform(scores, lambda s: F.lit(0.0))
    raised = lambda top: F.transform(kept, lambda s: F.when(s > low, F.exp(s - top)).otherwise(0.0))
    shares = lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t))
    return bind(F.array_max(kept), lambda top: F.when(top > low, bind(raised(top), shares)).otherwise(zeros))


def weighted_sum(vectors: Column, weights: Column, dim: int) -> Column:
    """Sum of the vectors of an array of vectors, each times its weight."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(F.zip_with(vectors, weights, lambda v, w: scale(v, w)), zero, add)
