"""Nested samples and mixtures."""

import random

import pytest
from compare import compare

from lattica.llm import queries
from lattica.llm.mixture import Source, mix, token_budgets
from lattica.llm.nested_sample import nested_sample

SCHEMA = "task string, nodeidx bigint, batch_no int"


def seeds(rows):
    return {(r["task"], r["nodeidx"]) for r in rows}


def test_nested_and_reproducible(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(3000), 1 + i // 1000) for i in range(6000)]
    taken = []
    for b in range(1, 7):
        upto = [r for r in rows if r[2] <= b]
        df = spark.createDataFrame(upto, SCHEMA)
        got = nested_sample(df, ["task", "nodeidx"], "batch_no", 0.2).collect()
        again = nested_sample(df.repartition(5).union(df.limit(100)), ["task", "nodeidx"], "batch_no", 0.2).collect()
        assert sorted(got) == sorted(again) and len(seeds(got)) == len(got)
        all_seeds = {(t, n) for t, n, _ in upto}
        assert seeds(got) <= all_seeds and 0.2 <= len(got) / len(all_seeds) < 0.23
        taken.append((seeds(got), {(r["task"], r["nodeidx"]): r["since_batch"] for r in got}))
    for (before, since), (after, later) in zip(taken, taken[1:]):
        assert before < after and all(later[k] == v for k, v in since.items())


def test_sample_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None, 1), (None, 1, 1), ("a", 1, None), ("a", 1, None)], SCHEMA)
    got = nested_sample(df, ["task", "nodeidx"], "batch_no", 1.0).collect()
    assert [(r["task"], r["nodeidx"], r["since_batch"]) for r in got] == [("a", 1, None)]
    assert nested_sample(df.limit(0), ["task", "nodeidx"], "batch_no", 0.5).count() == 0


def test_sample_equals_sql(spark, small):
    compare(spark, small, queries.p2_sample, queries.SQL["p2_sample"])


def test_budgets():
    s = {"big": Source(0.5, 1, 10, 1000), "small": Source(0.4, 2, 1, 50), "none": Source(0.1, 3)}
    token_budgets(s, 800)
    assert (s["big"].wanted, s["small"].wanted, s["none"].wanted) == (700, 100, 0)
    token_budgets(s, 10**6)
    assert (s["big"].wanted, s["small"].wanted) == (1000, 100)
    token_budgets(s, 0)
    assert not any(x.wanted for x in s.values())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, "Big-Source " if i % 2 else "big_source", rng.randrange(1, 900)) for i in range(3000)]
    rows += [(10_000 + i, "tiny", rng.randrange(50, 60)) for i in range(20)] + [(20_000 + i, "mid", rng.randrange(1, 400)) for i in range(800)]
    rows += [(30_000, None, 10), (30_001, "unnamed", 10), (30_002, "mid", 0), (30_003, "mid", None)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_mixture(spark, corpus):
    weights = spark.createDataFrame([("big_source", 0.4, 1), ("tiny", 0.2, 3), ("MID", 0.4, 6), ("absent", 0.1, 2), ("unfit", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix(corpus, weights, "doc_id")
    rows = chosen.collect()
    caps = {"big_source": 1, "tiny": 3, "mid": 6}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert not {r["doc_id"] for r in rows} & {30_000, 30_001, 30_002, 30_003}
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"big_source", "tiny", "mid", "absent", "unfit"}
    for s in ("big_source", "mid"):
        assert by[s]["reached_tokens"] == sum(r["n_tokens"] * r["copies"] for r in rows if r["source"] == s)
        assert by[s]["reached_tokens"] == pytest.approx(by[s]["wanted_tokens"], abs=900)
    assert by["tiny"]["reached_tokens"] == 3 * by["tiny"]["n_tokens"] and by["absent"]["reached_tokens"] == 0
    assert by["big_source"]["wanted_tokens"] == pytest.approx(by["mid"]["wanted_tokens"])
    assert sum(r["reached_share"] for r in by.values()) == pytest.approx(1, abs=0.01)
    again = mix(corpus.repartition(7), weights, "doc_id")[0]
    assert {(r["doc_id"], r["copies"]) for r in again.collect()} == {(r["doc_id"], r["copies"]) for r in rows}


def test_rates_are_a_tilt_of_the_size(spark, corpus):
    import math

    weights = spark.createDataFrame([("big_source", 1.0, 2)], "source string, target_share double, max_repeats int")
    rows = mix(corpus, weights, "doc_id", total_tokens=400_000)[0].collect()
    tilts = [math.log(r["rate"]) / r["n_tokens"] for r in rows if r["rate"] < 2]
    assert tilts and max(tilts) - min(tilts) < 1e-9 and tilts[0] < 0


def test_mixture_of_nothing(spark, corpus):
    weights = spark.createDataFrame([("big_source", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mix(corpus.limit(0), weights, "doc_id")
    assert chosen.count() == 0 and report.first()["reached_tokens"] == 0
    assert mix(corpus, weights.limit(0), "doc_id")[0].count() == 0
