"""Vector and text functions against numpy, the standard library and stated cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(x):
    return F.array(*[F.lit(float(v)) for v in x])


X = np.array([0.5, -1.25, 3.0, 0.0])
Y = np.array([2.0, 1.0, -0.5, 4.0])


def test_vectors_equal_numpy(spark):
    assert value(spark, V.dot(arr(X), arr(Y))) == pytest.approx(X @ Y)
    assert value(spark, V.cosine(arr(X), arr(Y))) == pytest.approx(X @ Y / np.linalg.norm(X) / np.linalg.norm(Y))
    assert value(spark, V.l2_normalize(arr(X))) == pytest.approx(list(X / np.linalg.norm(X)))
    assert value(spark, V.layer_norm(arr(X))) == pytest.approx(list((X - X.mean()) / np.sqrt(X.var() + 1e-5)))
    e = np.exp(X - X.max())
    assert value(spark, V.softmax(arr(X))) == pytest.approx(list(e / e.sum()))
    assert value(spark, V.cross_entropy(arr(X), F.lit(1))) == pytest.approx(-math.log(e[1] / e.sum()))
    p = e[1] / e.sum()
    assert value(spark, V.focal_loss(arr(X), F.lit(1), 2.0, [1, 0.25, 1, 1])) == pytest.approx(0.25 * (1 - p) ** 2 * -math.log(p))
    assert value(spark, V.matrix_times([[1, 0, 0, 1], [0, 2, 0, 0]], arr(X))) == pytest.approx([0.5, -2.5])
    assert value(spark, V.weighted_sum(F.array(arr(X), arr(Y)), arr([0.25, 0.75]), 4)) == pytest.approx(list(0.25 * X + 0.75 * Y))


def test_edges_of_vectors(spark):
    assert value(spark, V.dot(arr(X), arr([1]))) is None
    assert value(spark, V.cosine(arr([0, 0]), arr([1, 1]))) is None
    assert value(spark, V.l2_normalize(arr([0, 0]))) == [0, 0]
    assert value(spark, V.argmax(arr([1, 3, 3]))) == 1
    assert value(spark, V.masked_softmax_weights(arr([1, 2]), F.array(F.lit(False), F.lit(False)))) == [0, 0]
    assert value(spark, V.cross_entropy(arr(X), F.lit(9))) is None
    assert value(spark, V.layer_norm(F.lit(None).cast("array<double>"))) is None


def test_scalars(spark):
    for x in (-3.0, -0.2, 0.0, 0.7, 4.0):
        assert value(spark, V.gelu(F.lit(x))) == pytest.approx(0.5 * x * (1 + math.erf(x / math.sqrt(2))), abs=1e-6)
        assert value(spark, V.silu(F.lit(x))) == pytest.approx(x / (1 + math.exp(-x)))
        assert value(spark, V.huber_loss(F.lit(x), F.lit(0.0))) == pytest.approx(0.5 * x * x if abs(x) <= 1 else abs(x) - 0.5)
    codes = np.cos(7 * np.logspace(-2, 1, 5))
    assert value(spark, V.category_encoding(F.lit(7), 5)) == pytest.approx(list(codes))
    assert len(value(spark, V.numeric_encoding(F.lit(3.5), 8))) == 8
    assert value(spark, V.zscore(F.lit(5.0), F.lit(3.0), F.lit(2.0))) == 1
    assert value(spark, V.zscore(F.lit(5.0), F.lit(None).cast("double"), F.lit(2.0))) == 5


@pytest.mark.parametrize("index, want", [(0, [10, -10, -10]), (2, [-10, -10, 10]), (99, [-10] * 3), (-1, [-10] * 3), (None, [-10] * 3)])
def test_onehot_logits(spark, index, want):
    assert value(spark, V.onehot_logits(F.lit(index).cast("int"), 3)) == want


@pytest.mark.parametrize("s, number", [("4.5", 4.5), ("Answer: 7.2", 7.2), ("", 0), ("not a number", 0), (None, 0), ("  3 ", 3)])
def test_last_number(spark, s, number):
    assert value(spark, T.last_number(F.lit(s).cast("string"))) == number


@pytest.mark.parametrize("s, number", [("3", 3), ("Answer: 11", 11), ("", 0), ("abc", 0), (None, 0), ("2.5", 0)])
def test_last_integer(spark, s, number):
    assert value(spark, T.last_integer(F.lit(s).cast("string"))) == number


@pytest.mark.parametrize(
    "name, want",
    [
        ("shop-User___age", "age"),
        ("shop-User___Griffin_text_first_name", "first name (text)"),
        ("TIMESTAMP(date_created)", "date created (timestamp)"),
        ("x-A___TIMESTAMP(a_b)", "a b (timestamp)"),
        ("plain_name", "plain name"),
    ],
)
def test_clean_column_name(spark, name, want):
    assert value(spark, T.clean_column_name(F.lit(name))) == want


@pytest.mark.parametrize("name, want", [("rel-shop-Article", "Article"), ("shop-User", "User"), ("a-B-c", "B-c"), ("all_lower-case", "all lower case"), ("shop-User_group", "User group")])
def test_clean_entity_name(spark, name, want):
    assert value(spark, T.clean_entity_name(F.lit(name))) == want


def test_relation_parts(spark):
    parts = {k: value(spark, c) for k, c in T.relation_parts(F.lit("tail of shop-Sale:shop-Sale-user_id:shop-User")).items()}
    assert parts == {"direction": "incoming", "source": "shop-Sale", "fk": "Sale-user_id", "target": "shop-User"}
    assert value(spark, T.relation_parts(F.lit("head of odd"))["source"]) == "odd"


def test_questions_hold_the_phrase_that_is_expected(spark):
    for kind, classes in (("regression", 1), ("retrieval", 5)):
        phrase = value(spark, T.expected_phrase(F.lit(kind), F.lit(classes)))
        assert phrase in value(spark, T.fallback_question(F.lit("a-b_c"), F.lit(kind))).lower()
    assert value(spark, T.expected_phrase(F.lit("retrieval"), F.lit(2))) == "yes or no"
