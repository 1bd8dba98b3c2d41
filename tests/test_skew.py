"""Salted aggregation, orphan references and as-of joins on small cases and against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lattica.operators import asof, references
from lattica.operators.skew import HeavyKeys, salted_aggregate

T0 = datetime(2024, 1, 1)


def clashing(df, *names):
    """df with columns that are named as those the operator makes for itself."""
    return df.withColumns({n: F.rand() for n in names})


def degree(df, **more):
    return salted_aggregate(df, ["k"], ["v"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, row_id="id", **more)


def test_heavy_key_is_split_and_merged(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)]
    rows += rows[:200]  # delivered twice
    df = spark.createDataFrame(rows, "id bigint, k string, v bigint")
    heavy = HeavyKeys(df, ["k"], 100)
    assert [r["k"] for r in heavy.rows] == ["hot"] and heavy.rows[0]["__parts"] > 5
    got = {r["k"]: (r["n"], r["s"]) for r in degree(clashing(df, "n", "s", "__salt", "__parts", "count"), rows_per_part=100).collect()}
    want = {}
    for _, k, v in set(rows):
        n, s = want.get(k, (0, 0))
        want[k] = (n + 1, s + v)
    assert got == want


def test_parts_of_a_heavy_key_are_even(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(2000)], "id bigint, k string")
    sizes = [r["count"] for r in HeavyKeys(df, ["k"], 200).spread(df, ["id"]).groupBy("__salt").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 2 * min(sizes)


def test_aggregate_of_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a", None), (2, "a", 5)], "id bigint, k string, v bigint")
    assert [tuple(r) for r in degree(df).collect()] == [("a", 2, 5)]
    assert degree(df.limit(0)).collect() == []


def test_salted_join_finds_all(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else "cold" if i % 3 else None) for i in range(500)], "id int, k string")
    heavy = HeavyKeys(left, ["k"], 50)
    right = heavy.replicate(spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v int"))
    assert heavy.spread(left, ["id"]).join(right, ["k", "__salt"]).count() == sum(1 for i in range(500) if i % 2 or i % 3)


REFS = "ref_id bigint, entity string, id bigint, at timestamp_ntz"
PARENTS = "entity string, id bigint, born timestamp_ntz, died timestamp_ntz"


def test_orphans(spark):
    day = lambda n: T0 + timedelta(days=n)
    parents = spark.createDataFrame([("a", 1, None, None), ("a", 2, day(10), day(20)), ("a", 2, day(10), day(20)), ("b", 1, day(0), None)], PARENTS)
    refs = [
        (1, "a", 1, None), (2, "a", 1, day(5)), (3, "a", 2, day(9)), (4, "a", 2, day(10)), (5, "a", 2, day(19)), (6, "a", 2, day(20)),
        (7, "a", 2, None), (8, "b", 2, None), (9, "c", 1, day(1)), (10, None, 1, day(1)), (11, "a", None, day(1)), (9, "c", 1, day(1)),
    ]
    names = ("__salt", "__parts", "born", "w", "p")
    found = references.orphan_references(clashing(spark.createDataFrame(refs, REFS), *names), clashing(parents, "__salt", "at", "ref_id"))
    assert sorted(r["ref_id"] for r in found.collect()) == [3, 6, 8, 9, 9, 10]
    counts = {(r["entity"], r["period"]): (r["orphan_refs"], r["missing_ids"]) for r in references.orphan_counts(found).collect()}
    assert counts == {("a", "2024-01"): (2, 1), ("b", None): (1, 1), ("c", "2024-01"): (1, 1), (None, "2024-01"): (1, 1)}


def test_orphans_of_a_hot_key(spark):
    refs = [(i, "a", 1 if i % 2 else i, T0 + timedelta(hours=i % 7)) for i in range(1, 800)]
    parents = spark.createDataFrame([("a", 1, T0 + timedelta(hours=3), None)], PARENTS)
    found = references.orphan_references(spark.createDataFrame(refs, REFS), parents, rows_per_part=50)
    assert sorted(r["ref_id"] for r in found.collect()) == sorted(r[0] for r in refs if r[2] != 1 or r[3] < T0 + timedelta(hours=3))


def test_orphans_without_parents_or_refs(spark):
    refs = spark.createDataFrame([(1, "a", 1, None)], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert references.orphan_references(refs, none).count() == 1
    assert references.orphan_references(refs.limit(0), none).count() == 0


EVENTS = "task_row_id bigint, k bigint, at timestamp_ntz"
CHANGES = "kind string, k bigint, since timestamp_ntz, r1 timestamp_ntz, r2 timestamp_ntz, id bigint"


def brute(events, changes):
    low = datetime.min
    out = set()
    for e, k, at in events:
        for kind in {c[0] for c in changes}:
            seen = [c for c in changes if c[0] == kind and c[1] == k and k is not None and at is not None and (c[2] is None or c[2] < at)]
            if seen:
                out.add((e, kind, max(seen, key=lambda c: (c[3] or low, c[4] or low, c[5]))[5]))
    return out


def test_as_of_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(asof, "CHANGES_PER_BUCKET", 40)
    monkeypatch.setattr(asof, "EVENTS_PER_BUCKET", 60)
    rng = random.Random(5)
    when = lambda: None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(400) * 100)
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    changes = []
    for i in range(600):
        ts, known = when(), T0 + timedelta(seconds=rng.randrange(400) * 100)
        changes.append(("versions", key(), known if ts is None else max(ts, known), ts, known, i) if i % 2 else ("edges", key(), ts, ts, None, i))
    events = [(i, key(), when()) for i in range(400)]
    names = ("bucket", "best", "until", "__parts", "from", "to")
    left = clashing(spark.createDataFrame(events + events[:50], EVENTS), *names, "since", "kind", "id")
    right = clashing(spark.createDataFrame(changes + changes[:50], CHANGES), *names, "at", "task_row_id")
    got = asof.as_of(left, right, ["k"], "task_row_id")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(events, changes)


def test_as_of_at_the_very_time_and_empty(spark):
    changes = spark.createDataFrame([("c", 1, T0, T0, None, 7)], CHANGES)
    events = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + timedelta(seconds=1))], EVENTS)
    assert [tuple(r) for r in asof.as_of(events, changes, ["k"], "task_row_id").collect()] == [(2, "c", 7)]
    assert asof.as_of(events.limit(0), changes, ["k"], "task_row_id").count() == 0
    assert asof.as_of(events, changes.limit(0), ["k"], "task_row_id").count() == 0
