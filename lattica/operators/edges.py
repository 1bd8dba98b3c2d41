"""Foreign-key edges, degrees and pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import FORWARD, REVERSE
from lattica.operators.ordering import running_sums


def fk_edges(child: DataFrame, child_id: str, fk: str, relation: str, child_ts: str | None = None, parent: DataFrame | None = None, parent_id: str | None = None, parent_ts: str | None = None) -> DataFrame:
    """Both directions of a foreign key: relation, direction, src_id, dst_id, dst_ts (NULL = static).

    The forward edge leads from the row that holds the key to the row that it names, with that row's time, which is
    looked up in `parent` if given; the reverse edge leads back, with the time of the row that holds the key. Rows with
    a NULL key have no edge. A key that names no row of `parent` still has its edges, with a NULL time.
    """
    none = F.lit(None).cast("timestamp_ntz")
    rows = child.select(F.col(child_id).cast("bigint").alias("head"), F.col(fk).cast("bigint").alias("tail"), (F.col(child_ts) if child_ts else none).alias("head_ts"))
    rows = rows.filter(F.col("head").isNotNull() & F.col("tail").isNotNull())
    if parent is not None and parent_ts:
        times = parent.select(F.col(parent_id).cast("bigint").alias("tail"), F.col(parent_ts).alias("tail_ts"))
        rows = rows.join(times, "tail", "left")
    else:
        rows = rows.withColumn("tail_ts", none)
    both = F.array(
        F.struct(F.lit(FORWARD.strip()).alias("direction"), F.col("head").alias("src_id"), F.col("tail").alias("dst_id"), F.col("tail_ts").alias("dst_ts")),
        F.struct(F.lit(REVERSE.strip()).alias("direction"), F.col("tail").alias("src_id"), F.col("head").alias("dst_id"), F.col("head_ts").alias("dst_ts")),
    )
    return rows.select(F.lit(relation).alias("relation"), F.explode(both).alias("e")).select("relation", "e.*")


def degrees(nodes: DataFrame, node_id: str, edges: DataFrame, src: str = "src_id") -> DataFrame:
    """Edges per node, 0 for nodes without any."""
    counts = edges.groupBy(F.col(src).alias(node_id)).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(node_id).join(counts, node_id, "left").select(node_id, F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def pointers(degree: DataFrame, node_id: str) -> DataFrame:
    """Where the edges of each node begin if all edges are laid out in the order of the nodes."""
    return running_sums(degree, [], node_id, ["degree"]).select(node_id, "degree", F.col("before_degree").cast("bigint").alias("pointer"))


def edge_layout(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges placed by source and sorted within each partition, as they are to be written."""
    placed = edges.repartition(partitions, "relation", "src_id") if partitions else edges.repartition("relation", "src_id")
    return placed.sortWithinPartitions("relation", "direction", "src_id", "dst_id")
