"""Temporal neighbour joins and k-hop expansion with bounded fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.skew import SALT, HeavyKeys
from lattica.session import materialize

#: From this depth on the frontier is written between hops, so that the plan doesn't grow with each.
CUT_FROM = 3


def visible(cutoff: Column, ts: Column) -> Column:
    """Is a neighbour with time ts (NULL = static) seen at the cutoff? Strictly before it; nothing is at a NULL cutoff."""
    return cutoff.isNotNull() & (ts.isNull() | (ts < cutoff))


def temporal_neighbors(seeds: DataFrame, edges: DataFrame, seed_id: str, cutoff: str | None, src: str = "src_id", ts: str = "dst_ts") -> DataFrame:
    """seeds joined with their edges as seen at each seed's cutoff; all edges if cutoff is None, for tasks without time.

    Only edges before the latest cutoff are read: that bound is a literal, so it reaches the scan.
    """
    if cutoff:
        latest = seeds.agg(F.max(cutoff)).first()[0]
        edges = edges.filter(F.col(ts).isNull() | (F.col(ts) < F.lit(latest).cast("timestamp_ntz"))) if latest else edges.limit(0)
    joined = seeds.join(edges, seeds[seed_id] == edges[src])
    return joined.filter(visible(F.col(cutoff), F.col(ts))) if cutoff else joined


def fanout_sample(rows: DataFrame, group: list[str], order: Column, ties: list[str], fanout: int, name: str = "rn") -> DataFrame:
    """At most fanout rows of each group, by a hash order: without replacement, the same in every run.

    A row_number below a bound is cut to the bound before the shuffle too, so a group of any size costs each task
    no more than fanout rows.
    """
    w = Window.partitionBy(*group).orderBy(order, *ties)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= fanout)


def roots(seeds: DataFrame, entity: str, row_id: str, cutoff: str | None) -> DataFrame:
    """The first instances of an expansion: one per seed."""
    at = F.col(cutoff) if cutoff else F.lit(None).cast("timestamp_ntz")
    return seeds.select(
        F.col(row_id).cast("bigint").alias("seed_id"),
        F.md5(F.concat_ws("|", F.lit(entity), F.col(row_id).cast("string"))).alias("inst_id"),
        F.lit(entity).alias("entity"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.lit(0).alias("depth"),
        at.alias("cutoff"),
    )


def expand(start: DataFrame, edges: DataFrame, hops: int, fanout: int, timed: bool = True, rows_per_part: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """All instances within `hops` of the start, and the edges between instances.

    start: seed_id, inst_id, entity, row_id, depth, cutoff. edges: entity, row_id, relation, direction, dst_entity,
    dst_id, dst_ts. Each visit of a row is an instance of its own, so the result is a tree per seed, and a walk may
    come back to where it was. Children take over the seed's cutoff. Per instance and directed relation at most
    `fanout` of the neighbours seen at the cutoff are taken; with timed=False times play no role. The id of an
    instance is a hash of its path, hence the same in every run. Rows that own very many edges are salted in the join.
    Repeated edges are visited once each. Relations without neighbours and empty frontiers add nothing.
    """
    edges = edges.filter(F.col("row_id").isNotNull() & F.col("dst_id").isNotNull())
    if timed:
        latest = start.agg(F.max("cutoff")).first()[0]
        edges = edges.filter(F.col("dst_ts").isNull() | (F.col("dst_ts") < F.lit(latest).cast("timestamp_ntz"))) if latest else edges.limit(0)
    heavy = HeavyKeys(edges, ["entity", "row_id"], rows_per_part)
    spread = heavy.spread(edges, ["relation", "direction", "dst_id"])
    frontier, instances, links = start, start, None
    for depth in range(1, hops + 1):
        f, e = heavy.replicate(frontier).alias("f"), spread.alias("e")
        met = f.join(e, (F.col("f.entity") == F.col("e.entity")) & (F.col("f.row_id") == F.col("e.row_id")) & (F.col(f"f.{SALT}") == F.col(f"e.{SALT}")))
        if timed:
            met = met.filter(visible(F.col("f.cutoff"), F.col("e.dst_ts")))
        rows = met.select(
            F.col("f.seed_id"), F.col("f.inst_id").alias("parent"), F.col("f.cutoff"), F.col("e.relation"), F.col("e.direction"), F.col("e.dst_entity"), F.col("e.dst_id")
        )
        order = F.md5(F.concat_ws("|", F.col("parent"), F.col("direction"), F.col("relation"), F.col("dst_id").cast("string")))
        kept = fanout_sample(rows, ["parent", "relation", "direction"], order, ["dst_id"], fanout)
        child = F.md5(F.concat_ws("|", F.col("parent"), F.col("direction"), F.col("relation"), F.col("dst_id").cast("string"), F.col("rn").cast("string")))
        found = kept.withColumn("inst_id", child)
        if depth >= CUT_FROM:
            found = materialize(found, f"hop-{depth}")
        frontier = found.select("seed_id", "inst_id", F.col("dst_entity").alias("entity"), F.col("dst_id").alias("row_id"), F.lit(depth).alias("depth"), "cutoff")
        step = found.select("seed_id", "relation", "direction", F.col("parent").alias("parent_inst"), F.col("inst_id").alias("child_inst"))
        instances = instances.unionByName(frontier)
        links = step if links is None else links.unionByName(step)
    return instances, links


def revisits(instances: DataFrame) -> DataFrame:
    """Instances at depth 2 and beyond that are their seed's own row again."""
    seeds = instances.filter(F.col("depth") == 0).select("seed_id", F.col("entity").alias("e"), F.col("row_id").alias("r"))
    back = (F.col("entity") == F.col("e")) & (F.col("row_id") == F.col("r"))
    return instances.filter(F.col("depth") > 0).join(seeds, "seed_id").filter(back).drop("e", "r")


def neighbor_slots(neighbors: DataFrame, seeds: DataFrame, seed_id: str, order: list[str], slots: int, values: list[str]) -> DataFrame:
    """Exactly `slots` rows per seed: its first neighbours in the given order, then rows with NULL values."""
    w = Window.partitionBy(seed_id).orderBy(*order)
    first = neighbors.withColumn("slot", (F.row_number().over(w) - 1).cast("int")).filter(F.col("slot") < slots).select(seed_id, "slot", *values)
    grid = seeds.select(seed_id).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return grid.join(first, [seed_id, "slot"], "left")
