"""Attributes as known at event time: validity intervals in time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.skew import PARTS, HeavyKeys

#: Buckets of an ordinary key over the whole span of time; a key with many changes or events gets more, about one per
#: CHANGES_PER_BUCKET or EVENTS_PER_BUCKET.
BASE_BUCKETS = 4
CHANGES_PER_BUCKET = 2_000
EVENTS_PER_BUCKET = 20_000
MAX_HEAVY = 65_536


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, without regard to the session's time zone."""
    return F.unix_date(F.to_date(ts)) * F.lit(86_400).cast("bigint") + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def as_of(events: DataFrame, changes: DataFrame, keys: Sequence[str], event_id: str, at: str = "at") -> DataFrame:
    """For each event and kind of change, the change that stood just before the event's time.

    events: event_id, the keys and `at`. changes: `kind`, the keys, `since` (NULL = always), the rank columns `r1`,
    `r2` (NULLs lowest) and `id`. Among the changes with since < at, the one with the highest (r1, r2, id) stands; so
    a change that became known late may leave an earlier known one standing. Result: event_id, kind, id; no row where
    none stands. Events with a NULL time or key have no row. Repeated events or changes have no effect, so the result
    has one row per event and kind.

    1. Time is cut into buckets, more of them for keys with many changes or events. Within (kind, key, bucket) the successive
       change times give half-open validity intervals (since, next since].
    2. What stands at the end of a bucket is valid in the following buckets up to the next one with changes: it is
       exploded into these. This needs only one row per (key, bucket), so no task sees all changes of one key.
    3. Events and intervals meet by an equi-join on key and bucket, with containment as the residual condition.
    """
    keys = list(keys)
    events = events.select(event_id, *keys, at).filter(F.col(at).isNotNull())
    changes = changes.select("kind", *keys, "since", "r1", "r2", "id")
    for k in keys:
        events = events.filter(F.col(k).isNotNull())
        changes = changes.filter(F.col(k).isNotNull())
    lows = changes.agg(F.min(seconds(F.col("since"))), F.max(seconds(F.col("since")))).first()
    ends = events.agg(F.min(seconds(F.col(at))), F.max(seconds(F.col(at)))).first()
    start = min([x for x in (lows[0], ends[0]) if x is not None], default=0) - 1
    span = max([x for x in (lows[1], ends[1]) if x is not None], default=0) - start + 1

    heavy = HeavyKeys(changes.select(*keys), keys, CHANGES_PER_BUCKET, MAX_HEAVY, max_parts=1 << 20)
    heavy = heavy.joined(HeavyKeys(events.select(*keys), keys, EVENTS_PER_BUCKET, MAX_HEAVY, max_parts=1 << 20))

    def bucketed(df: DataFrame, ts: Column) -> DataFrame:
        with_parts = heavy.parts(df).withColumn(PARTS, F.when(F.col(PARTS) > 1, F.col(PARTS)).otherwise(BASE_BUCKETS).cast("bigint"))
        second = F.coalesce(seconds(ts) - F.lit(start).cast("bigint"), F.lit(0).cast("bigint"))
        return with_parts.withColumn("bucket", F.floor(second * F.col(PARTS) / F.lit(span)).cast("int"))

    low = F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'")
    inner = bucketed(changes, F.col("since")).withColumn("since", F.coalesce("since", low))
    cell = [*keys, "bucket"]
    w = Window.partitionBy(*cell, "kind").orderBy("since", "r1", "r2", "id")
    so_far = F.max(F.struct("r1", "r2", "id")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = (
        inner.repartition(*cell)
        .select(*cell, PARTS, "kind", "since", so_far.alias("best"), F.lead("since").over(w).alias("until"))
        .filter(F.col("until").isNull() | (F.col("until") > F.col("since")))
    )
    within = steps.select(*cell, "kind", F.col("since"), "until", "best")

    ending = steps.filter(F.col("until").isNull())
    per_key = Window.partitionBy(*keys, "kind").orderBy("bucket")
    carried = (
        ending.select(
            *keys,
            "kind",
            F.col("bucket").alias("from"),
            F.coalesce(F.lead("bucket").over(per_key), (F.col(PARTS) - 1).cast("int")).alias("to"),
            F.max("best").over(per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("best"),
        )
        .filter(F.col("to") > F.col("from"))
        .select(*keys, F.explode(F.sequence(F.col("from") + 1, F.col("to"))).alias("bucket"), "kind", low.alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"), "best")
    )
    intervals = within.unionByName(carried)

    left = bucketed(events.select(event_id, *keys, F.col(at).alias("at")), F.col("at")).drop(PARTS).repartition(*cell).dropDuplicates().alias("e")
    right = intervals.alias("i")
    on = None
    for c in cell:
        same = F.col(f"e.{c}") == F.col(f"i.{c}")
        on = same if on is None else on & same
    on = on & (F.col("i.since") < F.col("e.at")) & (F.col("i.until").isNull() | (F.col("e.at") <= F.col("i.until")))
    met = left.join(right, on).select(*[f"e.{c}" for c in cell], f"e.{event_id}", "i.kind", "i.best")
    best = met.groupBy(*cell, event_id, "kind").agg(F.max("best").alias("best"))
    return best.select(event_id, "kind", F.col("best.id").alias("id"))
