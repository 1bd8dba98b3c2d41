"""Temporal neighbours, expansion, ranks, sampling: stated cases and properties."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lattica.operators import edges as E
from lattica.operators import expand as X
from lattica.operators import meetings as M
from lattica.operators import sampling as S
from lattica.operators.ordering import hash_order, hash_rank, running_sums
from lattica.plans import graph_queries

T0 = datetime(2024, 1, 1)
EDGES = "entity string, row_id bigint, relation string, direction string, dst_entity string, dst_id bigint, dst_ts timestamp_ntz"


def seeds(spark, rows):
    return X.roots(spark.createDataFrame(rows, "k bigint, c timestamp_ntz"), "a", "k", "c")


def edge(src, dst, ts=None, entity="a", to="b", relation="r", direction="head of"):
    return (entity, src, relation, direction, to, dst, ts)


def test_cutoff_is_strict_and_static_rows_are_seen(spark):
    rows = [edge(1, 1, T0 - timedelta(1)), edge(1, 2, T0), edge(1, 3, T0 + timedelta(1)), edge(1, 4), edge(2, 5)]
    start = seeds(spark, [(1, T0), (2, None)])
    found, links = X.expand(start, spark.createDataFrame(rows, EDGES), 1, 10)
    assert sorted(r["row_id"] for r in found.filter("depth = 1").collect()) == [1, 4]
    assert links.count() == 2
    timeless, _ = X.expand(start, spark.createDataFrame(rows, EDGES), 1, 10, timed=False)
    assert timeless.filter("depth = 1").count() == 5


@pytest.mark.parametrize("degree", [0, 1, 3, 8])
def test_fanout(spark, degree):
    rows = [edge(1, i) for i in range(degree)] + [edge(9, 0)]
    found, _ = X.expand(seeds(spark, [(1, T0)]), spark.createDataFrame(rows, EDGES), 1, 3)
    got = [r["row_id"] for r in found.filter("depth = 1").collect()]
    assert len(got) == len(set(got)) == min(degree, 3)


def test_walks_come_back_and_children_keep_the_cutoff(spark):
    rows = [edge(1, 7, T0 - timedelta(5)), edge(7, 1, None, "b", "a", "r", "tail of"), edge(7, 2, None, "b", "a", "r", "tail of"), edge(1, 8, T0 + timedelta(5))]
    found, _ = X.expand(seeds(spark, [(1, T0)]), spark.createDataFrame(rows, EDGES), 2, 10)
    assert sorted((r["depth"], r["entity"], r["row_id"]) for r in found.collect()) == [(0, "a", 1), (1, "b", 7), (2, "a", 1), (2, "a", 2)]
    assert {r["cutoff"] for r in found.collect()} == {T0}
    assert [r["depth"] for r in X.revisits(found).collect()] == [2]


def test_hub_gives_the_same_with_and_without_salt(spark):
    rows = spark.createDataFrame([edge(1, i) for i in range(400)] + [edge(2, 3)], EDGES)
    start = seeds(spark, [(1, T0), (2, T0)])
    ids = lambda n: sorted(r["inst_id"] for r in X.expand(start, rows, 1, 5, rows_per_part=n)[0].collect())
    assert ids(20) == ids(10_000) and len(ids(20)) == 2 + 5 + 1


def test_no_edges(spark):
    found, _ = X.expand(seeds(spark, [(1, T0)]), spark.createDataFrame([], EDGES), 2, 3)
    assert found.count() == 1


def test_slots(spark):
    neighbors = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20)], "seed int, dst int")
    slots = X.neighbor_slots(neighbors, spark.createDataFrame([(1,), (2,), (3,)], "seed int"), "seed", ["dst"], 2, ["dst"])
    got = sorted((r["seed"], r["slot"], r["dst"]) for r in slots.collect())
    assert got == [(1, 0, 10), (1, 1, 11), (2, 0, 20), (2, 1, None), (3, 0, None), (3, 1, None)]


def test_edges_of_null_keys_and_missing_parents(spark):
    child = spark.createDataFrame([(1, 5, T0), (2, None, T0), (3, 6, None)], "id int, fk int, ts timestamp_ntz")
    parent = spark.createDataFrame([(5, T0)], "pid int, pts timestamp_ntz")
    got = sorted((r["direction"], r["src_id"], r["dst_id"], r["dst_ts"]) for r in E.fk_edges(child, "id", "fk", "r", "ts", parent, "pid", "pts").collect())
    assert got[:2] == [("head of", 1, 5, T0), ("head of", 3, 6, None)] and got[2][:3] == ("tail of", 5, 1)


def test_ranks_and_sums_equal_python(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, i * i % 11) for i in range(500)], "k int, i int, v int")
    ranked = hash_rank(df, ["k"], hash_order("i"), ["i"]).collect()
    for k in {r["k"] for r in ranked}:
        assert sorted(r["rn"] for r in ranked if r["k"] == k) == list(range(1, 1 + sum(r["k"] == k for r in ranked)))
    summed = running_sums(df, ["k"], "i", ["v"]).collect()
    assert len(summed) == 500
    for r in summed:
        assert r["before_v"] == sum(x["v"] for x in summed if x["k"] == r["k"] and x["i"] < r["i"])
    assert running_sums(df.limit(0), ["k"], "i", ["v"]).count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(300)], "t string, r bigint").cache()


def test_samples(spark, rows):
    everything = {tuple(r) for r in rows.collect()}
    for sample, size in ((S.sample_ratio(rows, "t", "r", 0.25, "s"), 75), (S.sample_number(rows, "t", "r", 60, "s"), 120), (S.sample_number(rows, "t", "r", 10**6, "s"), 300)):
        got = [tuple(r) for r in sample.collect()]
        assert len(got) == len(set(got)) == size and set(got) <= everything
    pick = lambda df, seed: {tuple(r) for r in S.sample_number(df, "t", "r", 20, seed).collect()}
    assert pick(rows, "s") == pick(rows.repartition(7), "s") != pick(rows, "other")
    assert S.sample_ratio(rows.limit(0), "t", "r", 0.5, "s").count() == 0


def test_draws_with_replacement(spark, rows):
    got = S.sample_with_replacement(rows, "t", "r", {"a": 2.0}, 0.1, "s").collect()
    assert sum(r["t"] == "a" for r in got) == 400 and sum(r["t"] == "b" for r in got) == 10
    assert len({r["r"] for r in got if r["t"] == "a"}) < 200


def test_batches(spark, rows):
    got = S.batches(rows, "t", "r", 64, "s").collect()
    assert len({(r["t"], r["batch_id"], r["slot"]) for r in got}) == 300
    assert max(r["slot"] for r in got) == 63 and {r["batch_id"] for r in got if r["t"] == "b"} == {0, 1}


def test_history(spark):
    got = S.history_draws(spark.createDataFrame([(0,), (1,), (5,), (None,)], "r bigint"), "r", 4, "s").collect()
    assert {r["seed"] for r in got} == {1, 5} and len(got) == 8
    assert {r["example"] for r in got if r["seed"] == 1} == {0} and all(r["example"] < r["seed"] for r in got)


def test_stratified_context(spark):
    df = spark.createDataFrame([(i, 0.0 if i == 0 else 1.0 if i < 4 else 2.0) for i in range(104)], "r bigint, y double")
    got = S.stratified_context(df, "r", "y", 10, "s").collect()
    assert len({r["r"] for r in got}) == len(got) == 10 and {r["y"] for r in got} == {0.0, 1.0, 2.0}
    assert sum(r["y"] == 1.0 for r in got) == 3
    assert S.stratified_context(df, "r", "y", 200, "s").count() == 104
    assert S.stratified_context(df.withColumn("y", F.col("y") + 0.5), "r", "y", 10, "s").count() == 10
    many = df.withColumn("y", F.col("r").cast("double"))
    assert S.stratified_context(many, "r", "y", 10, "s").count() == 10


def test_graph_khop2_takes_all_splits_and_tasks_without_time(spark, tmp_path):
    late = T0 + timedelta(1)
    tables = {
        "metatask": ([("t", "a", True), ("u", "a", False)], "task string, seed_entity string, has_timestamp boolean"),
        "task_rows": ([(1, "t", "train", 1, T0), (2, "t", "valid", 1, late), (3, "t", "test", 1, None), (4, "u", "test", 1, None), (5, "u", "train", 1, None)], "task_row_id bigint, task string, split string, nodeidx bigint, timestamp timestamp_ntz"),
        "edges": ([("a", 1, "a:r:b", "head of", 7, None), ("a", 1, "a:r:b", "head of", 8, T0), ("b", 7, "a:r:b", "tail of", 2, late)], "entity string, number bigint, relation string, direction string, dst_id bigint, dst___timestamp timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["entity"], r["depth"]): (r["n_instances"], r["n_seeds"]) for r in graph_queries.graph_khop2(spark, str(tmp_path)).collect()}
    assert got == {("a", 0): (5, 5), ("b", 1): (1 + 2 + 2 + 2, 4), ("a", 2): (2, 2)}


@pytest.mark.parametrize("parts", [None, (7, 7)])
def test_seeds_and_others_equal_all_pairs(spark, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(M, "MET_ROWS", parts)
        monkeypatch.setattr(M, "MEETING_ROWS", parts)
    rows = [(i * 7 % 40, T0 + timedelta(i * i % 23)) for i in range(90)] + [(50, T0 + timedelta(99)), (51, None), (None, T0), (0, T0), (0, T0)]
    chosen = {*range(0, 40, 3), 50, 51, 77}
    got = M.seeds_and_others(spark.createDataFrame(rows, "k bigint, t timestamp_ntz"), spark.createDataFrame([(k,) for k in (*chosen, 3, None)], "k bigint"), "k", "t")
    met = {(a, b) for a, s in rows for b, t in rows if a in chosen and b is not None and s is not None and s == t and a != b}
    want = {(a, sum(x == a and y in chosen for x, y in met), sum(x == a and y not in chosen for x, y in met)) for a, _ in met}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 14 and got.columns == ["k", "n_seeds", "n_others"]


def test_seed_neighbors_are_not_listed(spark, tmp_path):
    """3,000 customers on two days, a fifth of them seeds, have 1.8 million pairs, which aren't shuffled."""
    segment = F.when(F.col("id") % 5 == 0, "BUILDING").otherwise("OTHER")
    spark.range(3000).select(F.col("id").alias("c_custkey"), segment.alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    day = F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") / 3000).cast("int"))
    spark.range(6000).select((F.col("id") % 3000).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    shuffled = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    found = graph_queries.seed_neighbor_split(spark, str(tmp_path)).collect()
    assert {tuple(r)[1:] for r in found} == {(599, 2400)} and len(found) == 600
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < shuffled() - before < 500_000
