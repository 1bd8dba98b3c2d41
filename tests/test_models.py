"""Messages and layers against numpy; heads; metrics; leaderboards; merges; tasks; sources; catalog; streams."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import catalog as C
from lattica.operators import heads as H
from lattica.operators import leaderboard as L
from lattica.operators import merge as G
from lattica.operators import message as M
from lattica.operators import metrics as X
from lattica.operators import tasks as K
from lattica.plans import model_queries
from lattica.sources import arrays, datasets
from lattica.sources import checkpoints as S
from lattica.streaming import windows as W

DIM = 3


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, DIM))
    x[3] = -abs(x[3])
    edges = [("p", 0, 1), ("p", 0, 2), ("q", 0, 3), ("p", 4, 3), ("q", 2, 0)]
    rel = {"p": np.array([1.0, -1.0, 0.5]), "q": np.array([2.0, 1.0, 1.0])}
    frames = (
        spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>"),
        spark.createDataFrame(edges, "relation string, src bigint, dst bigint"),
        spark.createDataFrame([(k, v.tolist()) for k, v in rel.items()], "relation string, rel array<double>"),
    )
    return frames, x, edges, rel


def messages(x, edges, rel, reverse=False):
    out = np.zeros_like(x)
    for i in range(len(x)):
        per = []
        for k, v in rel.items():
            near = [(s if reverse else d) for r, s, d in edges if r == k and (d if reverse else s) == i]
            if near:
                per.append(x[near].mean(axis=0) * v)
        if per:
            out[i] = np.max(per, axis=0)
    return out


@pytest.mark.parametrize("reverse", [False, True])
def test_messages(graph, reverse):
    (nodes, edges, rel), x, e, r = graph
    got = {k["id"]: k["message"] for k in M.relational_messages(nodes, edges, rel, DIM, reverse, rows_per_part=1).collect()}
    want = messages(x, e, r, reverse)
    assert len(got) == 6
    for i in range(6):
        assert got[i] == pytest.approx(list(want[i]))


def norm(x):
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)


def silu(x):
    return x / (1 + np.exp(-x))


@pytest.mark.parametrize("sequential", [False, True])
def test_layers(graph, sequential):
    (nodes, edges, rel), x, e, r = graph
    layer = M.Layer.seeded(DIM, 4, zero_gates=False)
    n = norm(x)
    sent = n @ layer.before.T
    sent = sent if sequential else silu(sent)
    both = sum(
        (n @ gate.T) * messages(sent, e, {k: w @ v for k, v in r.items()}, reverse)
        for reverse, w, gate in ((False, layer.relation, layer.gate), (True, layer.reverse_relation, layer.reverse_gate))
    )
    if sequential:
        moved = x + silu(both)
        want = moved + layer.alpha * norm(moved) @ layer.forward.T
    else:
        want = x + n @ layer.forward.T + both
    got = {k["id"]: k["x"] for k in M.layer_update(nodes, edges, rel, layer, DIM, sequential).collect()}
    for i in range(6):
        assert got[i] == pytest.approx(list(want[i]))


def test_gates_of_zero_pass_nothing(graph):
    (nodes, edges, rel), x, _, _ = graph
    got = {k["id"]: k["x"] for k in M.layer_update(nodes, edges, rel, M.Layer.seeded(DIM, 4), DIM, True).collect()}
    for i in range(6):
        assert got[i] == pytest.approx(list(x[i]), abs=1e-3)


def test_no_edges_give_zeros(graph):
    (nodes, edges, rel), _, _, _ = graph
    assert {tuple(k["message"]) for k in M.relational_messages(nodes, edges.limit(0), rel, DIM).collect()} == {(0.0,) * DIM}


@pytest.mark.parametrize("sequential", [False, True])
def test_model(spark, graph, sequential):
    (_, edges, rel), _, e, r = graph
    rng = np.random.default_rng(9)
    names = {"u": rng.normal(size=(2, DIM)), "v": rng.normal(size=(4, DIM))}
    entity = ["u", "v", "v", "u", "u", "v"]
    columns = [rng.normal(size=names[k].shape) for k in entity]
    hidden = {(0, 1), (3, 0), (3, 1), (5, 2)}
    task = [rng.normal(size=DIM) if i % 2 else None for i in range(6)]
    layers = [M.ModelLayer.seeded(DIM, k, zero_gates=False) for k in (1, 2, 3)]
    rows = [(i, entity[i], [None if (i, j) in hidden else v.tolist() for j, v in enumerate(columns[i])], None if task[i] is None else task[i].tolist()) for i in range(6)]
    nodes = spark.createDataFrame(rows, "id bigint, entity string, columns array<array<double>>, task array<double>")
    got = {k["id"]: k["x"] for k in M.run_model(nodes, names, edges, rel, layers, DIM, sequential).collect()}

    soft = lambda s: np.exp(s) / np.exp(s).sum(axis=-1, keepdims=True)
    t = np.stack([names[entity[i]].mean(axis=0) if task[i] is None else task[i] for i in range(6)])
    x = np.zeros((6, DIM))
    for k, layer in enumerate(layers):
        n = norm(t)
        for i in range(6):
            seen = [j for j in range(len(columns[i])) if (i, j) not in hidden]
            if seen:
                keys, values = names[entity[i]], columns[i][seen]
                if k:
                    x[i] += soft(n[i] @ keys[seen].T / np.sqrt(DIM)) @ values * (layer.pool @ n[i])
                else:
                    x[i] = layer.pool @ (soft(keys @ keys[seen].T / np.sqrt(DIM)) @ values).mean(axis=0)
        b, n = layer.block, norm(x)
        sent = n @ b.before.T
        sent = sent if sequential else silu(sent)
        both = sum((n @ g.T) * messages(sent, e, {a: w @ v for a, v in r.items()}, back) for back, w, g in ((False, b.relation, b.gate), (True, b.reverse_relation, b.reverse_gate)))
        x = x + silu(both) if sequential else x + n @ b.forward.T + both
        if sequential:
            x = x + b.alpha * norm(x) @ b.forward.T
        if k < 2:
            t = t + norm(x) @ layer.task.T
    for i in range(6):
        assert got[i] == pytest.approx(list(norm(x)[i]), abs=1e-6)


def test_checkpoints(spark, tmp_path):
    for k in (1, 2):
        S.save_layers(spark, f"{tmp_path}/w", f"c{k}", [M.Layer.seeded(DIM, k), M.Layer.seeded(DIM, k + 5)])
    first, second = S.load_layers(spark, f"{tmp_path}/w", "c2")
    assert (first.before == M.Layer.seeded(DIM, 2).before).all() and (second.forward == M.Layer.seeded(DIM, 7).forward).all() and first.alpha == 1e-6
    scores = spark.createDataFrame([("c1", 0.5), ("c2", 0.5)], "checkpoint string, value double")
    assert {r["checkpoint"] for r in S.best_only(spark.read.parquet(f"{tmp_path}/w"), scores).collect()} == {"c1"}
    with pytest.raises(KeyError):
        S.load_layers(spark, f"{tmp_path}/w", "c3")


def test_probe_and_neighbors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = x @ [1, -2, 0.5, 3] + 4
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(200)], "id bigint, x array<double>, y double")
    w = H.ridge_probe(df, "x", "y", 4, 1e-6)
    assert w == pytest.approx([1, -2, 0.5, 3, 4], abs=1e-4)
    assert H.probe_scores(df, "x", w).filter(F.abs(F.col("prediction") - F.col("y")) > 1e-3).count() == 0
    classes = H.NearestNeighbors(1, 2).fit(df.withColumn("c", (F.col("y") > 4).cast("int")), "x", "c", "id").predict(df, "id", "x")
    assert all(r["probabilities"][int(y[r["id"]] > 4)] == 1 for r in classes.collect())
    assert H.mode(12, True) == "zero-shot" and H.mode(10, True) == "fine-tuned"


def scores(spark, rows):
    return spark.createDataFrame(rows, "t string, s double, y double")


def auc(df):
    return X.auroc_binary(df, ["t"], "s", F.col("y") == 1).first()["score"]


def test_auroc(spark):
    assert auc(scores(spark, [("a", 1.0, 1.0), ("a", 1.0, 0.0), ("a", 1.0, 0.0)])) == 0.5
    assert auc(scores(spark, [("a", 2.0, 1.0), ("a", 1.0, 0.0)])) == 1
    assert auc(scores(spark, [("a", 2.0, 1.0), ("a", 1.0, 1.0)])) is None
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 40, 500) / 7, rng.integers(0, 2, 500)
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert auc(scores(spark, [("a", float(a), float(b)) for a, b in zip(s, y)])) == pytest.approx(np.mean(pairs))


def test_metrics_leave_out_bad_labels(spark):
    df = scores(spark, [("a", 1.0, 3.0), ("a", 2.0, float("nan")), ("a", 2.0, None), ("a", 5.0, 4.0)])
    assert X.evaluate(df, ["t"], "rmse", "s", "y").first()["score"] == pytest.approx(-math.sqrt(2.5))
    assert X.evaluate(df, ["t"], "mae", "s", "y").first()["score"] == -1.5
    stats = X.target_statistics(df, ["t"], "y").first()
    assert (stats["n"], stats["center"]) == (2, 3.5) and stats["spread"] == pytest.approx(0.5 + 1e-6)
    assert X.target_statistics(df.limit(1), ["t"], "y").first()["center"] is None
    with pytest.raises(ValueError):
        X.evaluate(df, ["t"], "accuracy", "s", "y")


LOG = """lost: before
test_metric/early/mae: 1
=== N=8 LR=1 (zero-shot) ===
test_metric/a-b/mae: -0.5
test_metric/a-b/mae: -0.25
test_metric/c: 1e-3
test_metric/d/hr@1: 0.5
Average test metric: 0.125
=== N=16 ===
test_metric/a-b/mae: -0.25"""


def test_logs(spark):
    files = spark.createDataFrame([(1, LOG), (2, None), (3, "")], "f int, text string")
    got = {(r["marker"], r["task"]): (r["metric"], r["value"]) for r in L.latest(L.parse_logs(L.log_lines(files, "f", "text"), "f"), "f").collect()}
    assert got == {("N=8 LR=1", "a-b"): ("mae", -0.25), ("N=8 LR=1", "c"): ("", 0.001), ("N=8 LR=1", "__avg__"): ("avg", 0.125), ("N=16", "a-b"): ("mae", -0.25)}
    results = spark.createDataFrame([(*k, *v) for k, v in got.items()], "marker string, task string, metric string, value double")
    assert {r["task"]: r["at"] for r in L.best_of(results).collect()}["a-b"] == "N=8 LR=1"
    wide = {r["task"]: (r["N=16"], r["N=8 LR=1"]) for r in L.pivot(results, ["N=16", "N=8 LR=1"]).collect()}
    assert wide["a-b"] == (-0.25, -0.25) and wide["c"] == (None, 0.001)


def test_early_stop(spark):
    curve = lambda run, values: [(run, i, v) for i, v in enumerate(values)]
    rows = curve("stops", [1.0, 3.0, 2.0, 3.0, 1.0, 9.0]) + curve("runs", [1.0, 2.0, 3.0]) + curve("gap", [1.0, None, 0.0])
    got = {r["run"]: (r["best"], r["best_epoch"], r["stop_epoch"]) for r in L.early_stop(spark.createDataFrame(rows, "run string, epoch int, v double"), "run", "epoch", "v", 2).collect()}
    assert got == {"stops": (3.0, 1, 4), "runs": (3.0, 2, None), "gap": (1.0, 0, None)}


def test_merge(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "b"), (None, "b")], "k int, v string")
    assert sorted((tuple(r) for r in G.merge_override(a, b, ["k"]).collect()), key=str) == [(1, "a"), (2, "b"), (3, "b"), (None, "b")]
    with pytest.raises(ValueError):
        G.merge_checked(a, b, ["k"], ["v"])
    assert G.merge_checked(a.filter("k = 1"), b, ["k"], ["v"]).count() == 4


def test_tasks(spark):
    refs = spark.createDataFrame([("train", [1, 2], 0.0), ("valid", [1, 2], 0.0), ("test", [3, 4], 1.0), ("test", [5], 1.0), ("test", None, 1.0)], "split string, node_pairs array<bigint>, labels double")
    assert sorted((r["split"], r["row"], r["class_id"]) for r in K.retrieval_rows(refs).collect()) == [("test", 3, 4), ("train", 1, 2)]
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "c int, seed boolean")
    assert [r["c"] for r in K.masked(df, ["c"], "seed").orderBy(F.col("c")).collect()] == [None, 2, 3]
    words = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "w string")
    assert sorted(r["code"] for r in K.dictionary(words, "w").collect()) == [0, 1]


CONFIG = {
    "graph": {
        "nodes": [{"type": "s-User", "num": 3}, {"type": "s-Sale", "num": 4}, {"type": "s-Sale_kind", "num": 2}],
        "edges": [{"type": t, "path": "e.npy"} for t in ("s-Sale:s-Sale-user:s-User", "s-User:s-User-friend:s-User", "s-User:s-User-self_loop:s-User", "s-User:reverse_user:s-Sale")],
        "feature_data": [{"type": t, "name": "__timestamp__", "path": "t.npy"} for t in ("s-User", "s-Sale", "s-Sale_kind")],
    },
    "feature_data": [
        {"type": "s-Sale", "name": "kind", "path": "a.npy", "extra_fields": {"dtype": "category", "num_categories": 2}},
        {"type": "s-Sale", "name": "Griffin_text_kind", "path": "b.npy", "extra_fields": {"dtype": "float"}},
        {"type": "s-Sale", "name": "price", "path": "c.npy", "extra_fields": {"dtype": "float"}},
        {"type": "s-Sale_kind", "name": "Griffin_text_kind", "path": "d.npy", "extra_fields": {"is_target_column": True}},
    ],
    "tasks": [
        {"extra_fields": {"name": "s-kind", "task_type": "retrieval", "target_type": "s-Sale", "seed_type": "x:s-Sale_kind", "evaluation_metric": "hr@1"}},
        {"extra_fields": {"name": "s-price", "task_type": "regression", "target_type": "s-Sale", "seed_type": "x:s-Sale", "evaluation_metric": "mae"}},
        {"extra_fields": {"name": "s-odd", "task_type": "regression", "target_type": "s-Sale", "seed_type": "x:s-User", "evaluation_metric": "mae"}},
    ],
}


def test_catalog(spark, tmp_path):
    path = tmp_path / "metadata.json"
    path.write_text(json.dumps(CONFIG))
    c = C.read_catalog(spark, datasets.read_document(str(path)))
    assert {(r["entity"], r["is_target"]) for r in c.entities.collect()} == {("s-User", False), ("s-Sale", False), ("s-Sale_kind", True)}
    assert {r["name"] for r in c.columns.collect()} == {"s-Sale___Griffin_text_kind", "s-Sale___price", "s-Sale_kind___Griffin_text_kind"}
    assert sorted((r["direction"], r["entity"]) for r in c.relations.collect()) == [("head of", "s-Sale"), ("head of", "s-User"), ("tail of", "s-User")]
    assert {r["task"]: (r["seed_entity"], r["masked"]) for r in c.tasks.collect()} == {"s-kind": ("s-Sale", ["s-Sale___Griffin_text_kind"]), "s-price": ("s-Sale", ["s-Sale___price"])}
    for broken in ("nodes", "feature_data"):
        bad = json.loads(json.dumps(CONFIG))
        bad["graph"][broken] = bad["graph"][broken][:1] + bad["graph"][broken][:1]
        with pytest.raises(C.MetadataError):
            C.read_catalog(spark, bad)


def test_words_for_tasks():
    tasks = [("a", "retrieval"), ("b", "regression"), ("c", "regression")]
    assert C.resolve_tasks(["REGTASK", "ALLTASK"], tasks) == ["b", "c", "a"]
    assert C.resolve_tasks(["EXCEPT__g"], tasks, {"g": ["a", "b"]}) == ["c"]
    with pytest.raises(C.MetadataError):
        C.resolve_tasks(["nope"], tasks)


def test_times(spark):
    zeros = spark.createDataFrame([(0,), (0,)], "t bigint")
    assert {r["t"] for r in C.normalize_times(zeros, "t", True).collect()} == {None}
    mixed = spark.createDataFrame([(0,), (5,), (C.STATIC_TIME,)], "t bigint")
    assert {r["t"] for r in C.normalize_times(mixed, "t", False).collect()} == {0, 5, None}
    with pytest.raises(C.MetadataError):
        C.normalize_times(mixed, "t", True)


def test_arrays(spark, tmp_path):
    arrays.register(spark)
    for name, a in (("v", np.arange(250, dtype=np.int32)), ("m", np.arange(60, dtype=np.float32).reshape(20, 3)), ("e", np.zeros(0))):
        np.save(tmp_path / f"{name}.npy", a)
        got = spark.read.format("npy").option("rows", 100).load(f"{tmp_path}/{name}.npy").orderBy("row_id").collect()
        assert [r["row_id"] for r in got] == list(range(len(a)))
        assert [r["value"] for r in got] == a.tolist()


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("train", "t", 1), ("test", "t", 2)], "split string, task string, r int")
    other = spark.createDataFrame([("test", "t", 3), ("test", "u", 4)], "split string, task string, r int")
    datasets.write_table(rows, f"{tmp_path}/a", "tasks")
    datasets.write_table(other, f"{tmp_path}/b", "tasks")
    datasets.merge_datasets(spark, f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c", {"tasks": ["split", "task"]})
    assert sorted((r["split"], r["task"], r["r"]) for r in datasets.read_table(spark, f"{tmp_path}/c", "tasks").collect()) == [("test", "t", 3), ("test", "u", 4), ("train", "t", 1)]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        datasets.write_table(rows, f"{tmp_path}/a", "tasks")
    datasets.append_trial(spark, f"{tmp_path}/trials", 1, {"lr": 0.1}, None)
    datasets.append_trial(spark, f"{tmp_path}/trials", 2, {"lr": 0.2}, 0.5)
    assert [r["trial"] for r in datasets.top_trials(spark.read.parquet(f"{tmp_path}/trials")).collect()] == [2, 1]
    (tmp_path / "x.log").write_text(LOG)
    assert datasets.log_files(spark, f"{tmp_path}/x.log").first()["text"] == LOG
    assert datasets.named_array([{"name": "a"}], "b", True) is None
    with pytest.raises(KeyError):
        datasets.named_array([{"name": "a"}], "b")


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i, i % 2, t + timedelta(minutes=10 * i)) for i in range(12)]
    events = spark.createDataFrame(rows + rows[:3], "id bigint, k bigint, ts timestamp_ntz")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = W.read_events(spark, f"{tmp_path}/in")
    W.run_to_table(W.running_degrees(stream, "k", "id"), f"{tmp_path}/out", f"{tmp_path}/state", "update")
    got = W.last_per_key(spark.read.parquet(f"{tmp_path}/out"), "k")
    assert sorted((r["k"], r["n"], r["last"]) for r in got.collect()) == [(0, 8, 10), (1, 7, 11)]
    once = W.first_deliveries(W.read_events(spark, f"{tmp_path}/in"), "ts", "id", "1 day")
    W.run_to_table(once, f"{tmp_path}/once", f"{tmp_path}/state2")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 12


def test_seed_embeddings_are_of_all_vectors(spark, small):
    ids = [r["id"] for r in model_queries.seed_embeddings(spark, small).select("id").collect()]
    assert sorted(ids) == sorted(r["vec_id"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
