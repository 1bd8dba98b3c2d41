"""The queries of the general problems 1, 5 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.asof import as_of
from lattica.operators.references import orphan_counts, orphan_references
from lattica.operators.skew import salted_aggregate
from lattica.session import broadcast_if_small, table

#: A key is heavy with so many hundredths of all edges.
HEAVY_PERCENT = 2


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Degree, static neighbours, mean neighbour id and first and last neighbour time per key (entity, number)."""
    rows = edges.select("edge_id", "entity", "number", "dst_id", F.col("dst___timestamp").alias("dst_ts"))
    return salted_aggregate(
        rows,
        ["entity", "number"],
        ["dst_id", "dst_ts"],
        {
            "degree": F.count(F.lit(1)),
            "static_degree": F.count_if(F.col("dst_ts").isNull()),
            "dst_sum": F.sum("dst_id"),
            "dst_n": F.count("dst_id"),
            "first_ts": F.min("dst_ts"),
            "last_ts": F.max("dst_ts"),
        },
        {
            "degree": F.sum("degree"),
            "static_degree": F.sum("static_degree"),
            "mean_dst_id": F.sum("dst_sum") / F.sum("dst_n"),
            "first_ts": F.min("first_ts"),
            "last_ts": F.max("last_ts"),
        },
        row_id="edge_id",
    )


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return edge_statistics(table(spark, d, "edges"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    degrees = salted_aggregate(table(spark, d, "edges"), ["entity", "number"], [], {"degree": F.count(F.lit(1))}, {"degree": F.sum("degree")}, row_id="edge_id")
    total = degrees.agg(F.sum("degree")).scalar()
    return degrees.filter(F.col("degree") * 100 >= total * HEAVY_PERCENT).select("entity", "number")


def references(spark: SparkSession, d: str) -> DataFrame:
    """metadata as one row per reference: ref_id, entity, id, at. NULL and -1 refer to nothing."""
    m = table(spark, d, "metadata")
    pair = lambda i: F.get("node_pairs", F.lit(i))
    one = lambda e, i: F.struct(F.col(e).alias("entity"), i.cast("bigint").alias("id"))
    every = F.array(one("seed_entity", F.col("seed_nodes")), one("seed_entity", pair(0)), one("target_entity", pair(1)))
    return (
        m.select("ref_id", F.col("timestamp").alias("at"), F.explode(every).alias("r"))
        .select("ref_id", "r.entity", "r.id", "at")
        .filter(F.col("id").isNotNull() & (F.col("id") != -1))
    )


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that exist: of an entity in metanode, with an id in its index space, and stored in a table of rows."""
    grown = table(spark, d, "entity_rows").select("entity", F.col("row_id").alias("id"), F.col("timestamp").alias("born"), F.col("deleted_ts").alias("died"))
    fixed = table(spark, d, "class_rows").select("entity", F.col("row_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("born"), F.col("deleted_ts").alias("died"))
    spaces = broadcast_if_small(table(spark, d, "metanode").select("entity", "num").distinct())
    return grown.unionByName(fixed).join(spaces, "entity").filter((F.col("id") >= 0) & (F.col("id") < F.col("num"))).drop("num")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(spark, d), parent_rows(spark, d)).select("ref_id", "entity").distinct()


def p5_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(orphan_references(references(spark, d), parent_rows(spark, d)))


def seed_events(spark: SparkSession, d: str) -> DataFrame:
    """task_row_id, entity and row of the seed, and the cutoff `at`."""
    tasks = broadcast_if_small(table(spark, d, "metatask").select("task", F.col("seed_entity").alias("entity")).distinct())
    rows = table(spark, d, "task_rows").select("task_row_id", "task", F.col("nodeidx").alias("number"), F.col("timestamp").alias("at"))
    return rows.join(tasks, "task").select("task_row_id", "entity", "number", "at")


def seed_changes(spark: SparkSession, d: str) -> DataFrame:
    """State changes and new neighbours of the seed entities. A version counts from when it both holds and is known."""
    v = table(spark, d, "entity_versions").filter(F.col("known_ts").isNotNull())
    versions = v.select(
        F.lit("entity_versions").alias("kind"), "entity", F.col("row_id").alias("number"), F.greatest("known_ts", "timestamp").alias("since"),
        F.col("timestamp").alias("r1"), F.col("known_ts").alias("r2"), F.col("version_id").alias("id"),
    )
    e = table(spark, d, "edges")
    t = F.col("dst___timestamp")
    none = F.lit(None).cast("timestamp_ntz")
    edges = e.select(F.lit("edges").alias("kind"), "entity", "number", t.alias("since"), t.alias("r1"), none.alias("r2"), F.col("edge_id").alias("id"))
    seeds = broadcast_if_small(table(spark, d, "metatask").select(F.col("seed_entity").alias("entity")).distinct())
    return versions.unionByName(edges).join(seeds, "entity", "left_semi")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = as_of(seed_events(spark, d), seed_changes(spark, d), ["entity", "number"], "task_row_id")
    return found.select("task_row_id", F.col("kind").alias("source_table"), F.col("id").alias("key_id"))


QUERIES = {
    "p1_found": p1_found,
    "p1_key_stats": p1_key_stats,
    "p5_found": p5_found,
    "p5_orphan_counts": p5_orphan_counts,
    "p6_found": p6_found,
}

_ORPHANS = """
    WITH refs AS (
        SELECT ref_id, seed_entity AS entity, seed_nodes AS id, "timestamp" AS ts FROM metadata
        UNION ALL SELECT ref_id, seed_entity, node_pairs[1], "timestamp" FROM metadata
        UNION ALL SELECT ref_id, target_entity, node_pairs[2], "timestamp" FROM metadata),
    parents AS (
        SELECT p.* FROM (
            SELECT entity, row_id, "timestamp" AS born, deleted_ts AS died FROM entity_rows
            UNION ALL SELECT entity, row_id, NULL, deleted_ts FROM class_rows) p
        JOIN metanode n ON n.entity = p.entity AND p.row_id >= 0 AND p.row_id < n.num),
    orphans AS (
        SELECT DISTINCT ref_id, entity, id, ts FROM refs r WHERE id IS NOT NULL AND id <> -1 AND NOT EXISTS (
            SELECT 1 FROM parents p WHERE p.entity = r.entity AND p.row_id = r.id AND (r.ts IS NULL
                OR ((p.born IS NULL OR p.born <= r.ts) AND (p.died IS NULL OR p.died > r.ts)))))
"""

SQL = {
    "p1_found": """
        WITH e AS (SELECT DISTINCT * FROM edges WHERE number IS NOT NULL)
        SELECT entity, number FROM e GROUP BY entity, number HAVING count(*) >= 0.02 * (SELECT count(*) FROM e)""",
    "p1_key_stats": """
        SELECT entity, number, count(*)::BIGINT AS degree, (count(*) FILTER (WHERE dst___timestamp IS NULL))::BIGINT AS static_degree,
            sum(dst_id)::DOUBLE / count(dst_id) AS mean_dst_id, min(dst___timestamp) AS first_ts, max(dst___timestamp) AS last_ts
        FROM (SELECT DISTINCT * FROM edges) WHERE entity IS NOT NULL AND number IS NOT NULL GROUP BY entity, number""",
    "p5_found": _ORPHANS + "SELECT DISTINCT ref_id, entity FROM orphans",
    "p5_orphan_counts": _ORPHANS + """
        SELECT entity, strftime(ts, '%Y-%m') AS period, count(*)::BIGINT AS orphan_refs, count(DISTINCT id)::BIGINT AS missing_ids
        FROM orphans GROUP BY 1, 2""",
    "p6_found": """
        WITH ev AS (
            SELECT DISTINCT t.task_row_id, m.seed_entity AS entity, t.nodeidx AS number, t."timestamp" AS c
            FROM task_rows t JOIN metatask m ON m.task = t.task WHERE t."timestamp" IS NOT NULL),
        v AS (
            SELECT task_row_id, 'entity_versions' AS source_table, version_id AS key_id, row_number() OVER (
                PARTITION BY task_row_id ORDER BY v."timestamp" DESC NULLS LAST, v.known_ts DESC, v.version_id DESC) AS rn
            FROM ev JOIN entity_versions v ON v.entity = ev.entity AND v.row_id = ev.number
                AND v.known_ts < ev.c AND (v."timestamp" IS NULL OR v."timestamp" < ev.c)),
        n AS (
            SELECT task_row_id, 'edges' AS source_table, edge_id AS key_id, row_number() OVER (
                PARTITION BY task_row_id ORDER BY e.dst___timestamp DESC NULLS LAST, e.edge_id DESC) AS rn
            FROM ev JOIN edges e ON e.entity = ev.entity AND e.number = ev.number
                AND (e.dst___timestamp IS NULL OR e.dst___timestamp < ev.c))
        SELECT task_row_id, source_table, key_id FROM v WHERE rn = 1
        UNION ALL SELECT task_row_id, source_table, key_id FROM n WHERE rn = 1""",
}
