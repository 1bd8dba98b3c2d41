"""Queries on edges, temporal neighbours, expansion, sampling and tasks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions.vectors import onehot_mask
from lattica.operators import edges as E
from lattica.operators import expand as X
from lattica.operators import sampling as S
from lattica.operators.asof import seconds
from lattica.operators.meetings import seeds_and_others
from lattica.operators.ordering import hash_order, running_sums
from lattica.session import broadcast_if_small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

CUTOFF = "1998-01-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def at(ts: str = CUTOFF):
    return F.expr(f"TIMESTAMP_NTZ'{ts}'")


def round6(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


# Temporal neighbours


def orders_of_customers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("src_id"), F.col("o_orderkey").alias("dst_id"), F.col("o_orderdate").alias("dst_ts"), "o_totalprice")


@query(
    f"""WITH n AS (
        SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (
            PARTITION BY c_custkey ORDER BY md5(concat_ws('|', 'orders', c_custkey::VARCHAR, o_orderkey::VARCHAR)), o_orderkey) AS rn
        FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '{CUTOFF}')
    SELECT c.c_custkey AS seed_id, c.c_mktsegment AS segment, count(n.o_orderkey)::BIGINT AS n_neighbors,
        floor(avg(n.o_totalprice) * 1e6 + 0.5) / 1e6 AS mean_price, max(n.o_totalprice) AS max_price
    FROM customer c LEFT JOIN n ON n.c_custkey = c.c_custkey AND n.rn <= 10 GROUP BY 1, 2"""
)
def flagship_temporal_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Customers at a cutoff, each with at most 10 of the earlier orders, and the mean of their prices."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("seed_id"), F.col("c_mktsegment").alias("segment"))
    seeds = customers.withColumn("cutoff", at())
    seen = X.temporal_neighbors(seeds, orders_of_customers(spark, d), "seed_id", "cutoff")
    kept = X.fanout_sample(seen, ["seed_id"], hash_order(F.lit("orders"), "seed_id", "dst_id"), ["dst_id"], 10)
    means = kept.groupBy("seed_id").agg(F.count("dst_id").alias("n_neighbors"), round6(F.avg("o_totalprice")).alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    return customers.join(means, "seed_id", "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)).cast("bigint"))


@query(
    """WITH ev AS (
        SELECT DISTINCT t.task_row_id, m.seed_entity AS entity, t.nodeidx AS number, t."timestamp" AS cutoff
        FROM task_rows t JOIN metatask m ON m.task = t.task WHERE t.split = 'test' AND m.has_timestamp)
    SELECT ev.task_row_id, e.relation, e.direction, count(DISTINCT e.edge_id)::BIGINT AS n_seen
    FROM ev JOIN edges e ON e.entity = ev.entity AND e.number = ev.number
    WHERE ev.cutoff IS NOT NULL AND (e.dst___timestamp IS NULL OR e.dst___timestamp < ev.cutoff) GROUP BY 1, 2, 3"""
)
def seed_cutoff_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that each test row sees before its own cutoff, by directed relation."""
    tasks = broadcast_if_small(table(spark, d, "metatask").filter("has_timestamp").select("task", F.col("seed_entity").alias("entity")))
    rows = table(spark, d, "task_rows").filter(F.col("split") == "test").join(tasks, "task")
    seeds = rows.select("task_row_id", "entity", "nodeidx", F.col("timestamp").alias("cutoff")).distinct()
    adjacency = table(spark, d, "edges").select(F.col("entity").alias("of"), F.col("number").alias("src_id"), "edge_id", "relation", "direction", F.col("dst___timestamp").alias("dst_ts")).distinct()
    seen = X.temporal_neighbors(seeds, adjacency, "nodeidx", "cutoff").filter(F.col("entity") == F.col("of"))
    return seen.groupBy("task_row_id", "relation", "direction").agg(F.count(F.lit(1)).alias("n_seen"))


# Foreign-key edges


def fixture_edges(spark: SparkSession, d: str) -> DataFrame:
    """The two relations customer <- orders <- lineitem as edges in both directions."""
    o, line = table(spark, d, "orders"), line_rows(spark, d)
    placed = E.fk_edges(o, "o_orderkey", "o_custkey", "orders:orders-custkey:customer", "o_orderdate", table(spark, d, "customer"), "c_custkey")
    lines = E.fk_edges(line, "line_id", "l_orderkey", "lineitem:lineitem-orderkey:orders", "l_shipdate", o, "o_orderkey", "o_orderdate")
    return placed.unionByName(lines)


def line_rows(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a row id made of its columns, since (order, line number) isn't unique."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return table(spark, d, "lineitem").withColumn("line_id", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"))


_LINE_ID = "concat('0x', substr(md5(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR)), 1, 15))::BIGINT"
_EDGES = f"""
    lines AS (SELECT *, {_LINE_ID} AS line_id FROM lineitem),
    e AS (
        SELECT 'orders:orders-custkey:customer' AS relation, 'head of' AS direction, 'orders' AS entity, 'customer' AS dst_entity,
            o_orderkey AS src_id, o_custkey AS dst_id, NULL::TIMESTAMP AS dst_ts FROM orders
        UNION ALL SELECT 'orders:orders-custkey:customer', 'tail of', 'customer', 'orders', o_custkey, o_orderkey, o_orderdate FROM orders
        UNION ALL SELECT 'lineitem:lineitem-orderkey:orders', 'head of', 'lineitem', 'orders', line_id, l_orderkey, o_orderdate
            FROM lines LEFT JOIN orders ON o_orderkey = l_orderkey
        UNION ALL SELECT 'lineitem:lineitem-orderkey:orders', 'tail of', 'orders', 'lineitem', l_orderkey, line_id, l_shipdate FROM lines)
"""


@query(
    f"""WITH {_EDGES}
    SELECT relation, direction, count(*)::BIGINT AS n_edges, count(DISTINCT src_id)::BIGINT AS n_sources, count(DISTINCT dst_id)::BIGINT AS n_targets,
        count(dst_ts)::BIGINT AS n_timed, min(dst_ts) AS first_ts, max(dst_ts) AS last_ts FROM e GROUP BY 1, 2"""
)
def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    return fixture_edges(spark, d).groupBy("relation", "direction").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_distinct("src_id").alias("n_sources"),
        F.count_distinct("dst_id").alias("n_targets"),
        F.count("dst_ts").alias("n_timed"),
        F.min("dst_ts").alias("first_ts"),
        F.max("dst_ts").alias("last_ts"),
    )


_DEGREE = "SELECT c_custkey, count(o_orderkey)::BIGINT AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def customer_degrees(spark: SparkSession, d: str) -> DataFrame:
    return E.degrees(table(spark, d, "customer"), "c_custkey", orders_of_customers(spark, d))


@query(_DEGREE)
def fk_degree(spark: SparkSession, d: str) -> DataFrame:
    return customer_degrees(spark, d)


@query(f"SELECT *, (sum(degree) OVER (ORDER BY c_custkey) - degree)::BIGINT AS pointer FROM ({_DEGREE})")
def csr_pointer(spark: SparkSession, d: str) -> DataFrame:
    return E.pointers(customer_degrees(spark, d), "c_custkey")


@query(
    """SELECT * FROM (
        SELECT 'orders-customer' AS relation, count(*)::BIGINT AS n_refs, (count(*) FILTER (WHERE c_custkey IS NULL))::BIGINT AS n_orphans
            FROM orders LEFT JOIN customer ON c_custkey = o_custkey
        UNION ALL SELECT 'lineitem-orders', count(*), count(*) FILTER (WHERE o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
        UNION ALL SELECT 'lineitem-part', count(*), count(*) FILTER (WHERE p_partkey IS NULL) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT 'events-customer', count(*), count(*) FILTER (WHERE c_custkey IS NULL) FROM events LEFT JOIN customer ON c_custkey = user_id)"""
)
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    """References and those that lead nowhere, per relation."""
    out = None
    for name, child, fk, parent, key in (
        ("orders-customer", "orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem-orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem-part", "lineitem", "l_partkey", "part", "p_partkey"),
        ("events-customer", "events", "user_id", "customer", "c_custkey"),
    ):
        refs = table(spark, d, child).groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        lost = refs.join(table(spark, d, parent).select(F.col(key).alias("k")).withColumn("held", F.lit(True)), "k", "left")
        part = lost.agg(F.sum("n").alias("n_refs"), F.coalesce(F.sum(F.when(F.col("held").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
        part = part.select(F.lit(name).alias("relation"), "n_refs", "n_orphans")
        out = part if out is None else out.unionByName(part)
    return out


# Expansion


def tpch_edges(spark: SparkSession, d: str) -> DataFrame:
    names = F.split("relation", ":")
    ends = F.when(F.col("direction") == "head of", F.struct(names[0].alias("entity"), names[2].alias("dst_entity"))).otherwise(F.struct(names[2].alias("entity"), names[0].alias("dst_entity")))
    return fixture_edges(spark, d).withColumn("ends", ends).select("ends.entity", F.col("src_id").alias("row_id"), "relation", "direction", "ends.dst_entity", "dst_id", "dst_ts")


def khop(spark: SparkSession, d: str, hops: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    seeds = table(spark, d, "customer").withColumn("cutoff", at("1996-06-01 00:00:00"))
    return X.expand(X.roots(seeds, "customer", "c_custkey", "cutoff"), tpch_edges(spark, d), hops, fanout)


def _khop_sql(hops: int, fanout: int) -> str:
    cutoff = "TIMESTAMP '1996-06-01 00:00:00'"
    parts = ["i0 AS (SELECT c_custkey AS seed_id, md5(concat_ws('|', 'customer', c_custkey::VARCHAR)) AS inst_id, 'customer' AS entity, c_custkey AS row_id, 0 AS depth FROM customer)"]
    for h in range(1, hops + 1):
        path = "p.inst_id, e.direction, e.relation, e.dst_id::VARCHAR"
        parts.append(f"""r{h} AS (
            SELECT p.seed_id, p.inst_id AS parent, e.relation, e.direction, e.dst_entity, e.dst_id, row_number() OVER (
                PARTITION BY p.inst_id, e.relation, e.direction ORDER BY md5(concat_ws('|', {path})), e.dst_id) AS rn
            FROM i{h - 1} p JOIN e ON e.entity = p.entity AND e.src_id = p.row_id AND (e.dst_ts IS NULL OR e.dst_ts < {cutoff})),
        l{h} AS (SELECT *, md5(concat_ws('|', parent, direction, relation, dst_id::VARCHAR, rn::VARCHAR)) AS inst_id FROM r{h} WHERE rn <= {fanout}),
        i{h} AS (SELECT seed_id, inst_id, dst_entity AS entity, dst_id AS row_id, {h} AS depth FROM l{h})""")
    nodes = " UNION ALL ".join(f"SELECT * FROM i{h}" for h in range(hops + 1))
    links = " UNION ALL ".join(f"SELECT seed_id, relation, direction, parent AS parent_inst, inst_id AS child_inst FROM l{h}" for h in range(1, hops + 1))
    return f"WITH {_EDGES}, {', '.join(parts)}, inst AS ({nodes}), links AS ({links}) "


@query(_khop_sql(2, 3) + "SELECT seed_id, inst_id, entity, row_id, depth::INT AS depth FROM inst")
def khop2_instances(spark: SparkSession, d: str) -> DataFrame:
    return khop(spark, d, 2, 3)[0].drop("cutoff")


@query(_khop_sql(2, 3) + "SELECT * FROM links")
def khop2_edges(spark: SparkSession, d: str) -> DataFrame:
    return khop(spark, d, 2, 3)[1]


@query(_khop_sql(3, 2) + "SELECT entity, depth::INT AS depth, count(*)::BIGINT AS n_instances, count(DISTINCT row_id)::BIGINT AS n_rows FROM inst GROUP BY 1, 2")
def khop3_counts(spark: SparkSession, d: str) -> DataFrame:
    found = khop(spark, d, 3, 2)[0]
    return found.groupBy("entity", "depth").agg(F.count(F.lit(1)).alias("n_instances"), F.count_distinct("row_id").alias("n_rows"))


@query(_khop_sql(2, 3) + "SELECT seed_id, inst_id, depth::INT AS depth FROM inst WHERE depth > 0 AND entity = 'customer' AND row_id = seed_id")
def revisit_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.revisits(khop(spark, d, 2, 3)[0]).select("seed_id", "inst_id", "depth")


@query()
def graph_khop2(spark: SparkSession, d: str) -> DataFrame:
    """Two hops over the whole `edges` table from the task rows of all splits, 10 neighbours per relation.

    Rows see what is before their own cutoff; those of tasks without time see all.
    """
    tasks = broadcast_if_small(table(spark, d, "metatask").select("task", F.col("seed_entity").alias("entity"), "has_timestamp"))
    rows = table(spark, d, "task_rows").join(tasks, "task").filter(F.col("nodeidx").isNotNull())
    path = F.md5(F.concat_ws("|", F.col("task_row_id").cast("string"), "entity", F.col("nodeidx").cast("string")))
    start = rows.select(F.col("task_row_id").alias("seed_id"), path.alias("inst_id"), "entity", F.col("nodeidx").alias("row_id"), F.lit(0).alias("depth"), F.col("timestamp").alias("cutoff"), "has_timestamp").distinct()
    parts = F.split("relation", ":")
    e = table(spark, d, "edges").distinct()
    dst = F.when(F.col("direction") == "head of", parts[2]).otherwise(parts[0])
    adjacency = e.select("entity", F.col("number").alias("row_id"), "relation", "direction", dst.alias("dst_entity"), "dst_id", F.col("dst___timestamp").alias("dst_ts"))
    timed, _ = X.expand(start.filter("has_timestamp").drop("has_timestamp"), adjacency, 2, 10)
    timeless, _ = X.expand(start.filter("NOT has_timestamp").drop("has_timestamp"), adjacency, 2, 10, timed=False)
    found = timed.unionByName(timeless)
    return found.groupBy("entity", "depth").agg(F.count(F.lit(1)).alias("n_instances"), F.count_distinct("seed_id").alias("n_seeds"))


_ORDERED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws('|', 'f', o_custkey::VARCHAR, o_orderkey::VARCHAR)), o_orderkey) AS rn FROM orders"


@query(f"SELECT o_custkey AS src_id, o_orderkey AS dst_id, rn::INT AS rn FROM ({_ORDERED}) WHERE rn <= 5")
def fanout_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_of_customers(spark, d).select("src_id", "dst_id")
    return X.fanout_sample(rows, ["src_id"], hash_order(F.lit("f"), "src_id", "dst_id"), ["dst_id"], 5)


@query("SELECT o_custkey AS src_id, count(*)::BIGINT AS n_all, least(count(*), 100)::BIGINT AS n_kept FROM orders GROUP BY 1")
def fanout_under_limit(spark: SparkSession, d: str) -> DataFrame:
    """A fan-out above every degree keeps all edges."""
    rows = orders_of_customers(spark, d).select("src_id", "dst_id")
    kept = X.fanout_sample(rows, ["src_id"], hash_order(F.lit("f"), "src_id", "dst_id"), ["dst_id"], 100)
    n = rows.groupBy("src_id").agg(F.count(F.lit(1)).alias("n_all"))
    return kept.groupBy("src_id").agg(F.count(F.lit(1)).alias("n_kept")).join(n, "src_id")


@query(
    """WITH s AS (SELECT c_custkey, unnest(range(4))::INT AS slot FROM customer),
    n AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS slot FROM orders)
    SELECT s.c_custkey AS src_id, s.slot, n.o_orderkey AS dst_id, coalesce(n.o_totalprice, 0.0) AS price
    FROM s LEFT JOIN n ON n.o_custkey = s.c_custkey AND n.slot = s.slot"""
)
def neighbor_slots(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "customer").select(F.col("c_custkey").alias("src_id"))
    rows = orders_of_customers(spark, d).withColumnRenamed("o_totalprice", "price")
    slots = X.neighbor_slots(rows, seeds, "src_id", ["dst_ts", "dst_id"], 4, ["dst_id", "price"])
    return slots.withColumn("price", F.coalesce("price", F.lit(0.0)))


@query(
    """WITH s AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    n AS (SELECT DISTINCT a.o_custkey AS src_id, b.o_custkey AS dst_id FROM (SELECT o_custkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM s)) a
        JOIN orders b ON b.o_orderdate = a.o_orderdate AND b.o_custkey <> a.o_custkey)
    SELECT src_id, (count(*) FILTER (WHERE dst_id IN (SELECT c_custkey FROM s)))::BIGINT AS n_seeds,
        (count(*) FILTER (WHERE dst_id NOT IN (SELECT c_custkey FROM s)))::BIGINT AS n_others FROM n GROUP BY 1"""
)
def seed_neighbor_split(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours (customers that ordered at the same time) which are seeds themselves, and the others."""
    seeds = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("src_id"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src_id"), F.col("o_orderdate").alias("day"))
    return seeds_and_others(o, seeds, "src_id", "day")


# Few-shot history

_NUMBER = "concat('0x', substr(md5(concat_ws('|', {})), 1, 8))::BIGINT"
_HISTORY = f"""
    rows AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS r FROM events),
    draws AS (SELECT r AS seed, unnest(range(5))::INT AS draw FROM rows WHERE r > 0),
    drawn AS (SELECT seed, draw, ({_NUMBER.format("'h', seed::VARCHAR, draw::VARCHAR")} % seed)::BIGINT AS example FROM draws)
"""


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """events numbered from 0 in the order of their time."""
    e = table(spark, d, "events").select("event_id", "value", "ts", seconds(F.col("ts")).alias("at_s"))
    first = running_sums(e.groupBy("at_s").agg(F.count(F.lit(1)).alias("n")), [], "at_s", ["n"]).select("at_s", F.col("before_n").alias("first"))
    w = Window.partitionBy("at_s").orderBy("ts", "event_id")
    return e.join(first, "at_s").select("event_id", "value", (F.row_number().over(w) - 1 + F.col("first")).cast("bigint").alias("r"))


@query(f"WITH {_HISTORY} SELECT d.seed, d.draw, d.example, r.event_id FROM drawn d JOIN rows r ON r.r = d.example")
def fewshot_history(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d)
    drawn = S.history_draws(rows, "r", 5, "h")
    return drawn.join(rows.select(F.col("r").alias("example"), "event_id"), "example").select("seed", "draw", "example", "event_id")


@query(
    f"""WITH {_HISTORY},
    scored AS (SELECT d.seed, d.draw, d.example, -abs(a.value - b.value) AS score FROM drawn d JOIN rows a ON a.r = d.seed JOIN rows b ON b.r = d.example)
    SELECT seed, example, draw, floor(score * 1e6 + 0.5) / 1e6 AS score, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, example, draw) AS rank FROM scored) WHERE rank <= 2"""
)
def fewshot_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d)
    drawn = S.history_draws(rows, "r", 5, "h")
    a, b = rows.select(F.col("r").alias("seed"), F.col("value").alias("va")), rows.select(F.col("r").alias("example"), F.col("value").alias("vb"))
    best = S.rerank(drawn.join(a, "seed").join(b, "example"), ["seed"], -F.abs(F.col("va") - F.col("vb")), ["example", "draw"], 2)
    return best.select("seed", "example", "draw", round6(F.col("score")).alias("score"), "rank")


@query(
    f"""WITH {_HISTORY}
    SELECT 'row' AS kind, r.r AS parent, NULL::BIGINT AS child, NULL AS relation FROM rows r
    UNION ALL SELECT 'link', seed, example, '{T.FEWSHOT_RELATION}' FROM (SELECT DISTINCT seed, example FROM drawn)"""
)
def fewshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """The seeds' graph united with that of their examples: rows, and a link from each seed to each of its examples."""
    rows = event_rows(spark, d)
    links = S.history_draws(rows, "r", 5, "h").select("seed", "example").distinct()
    none = F.lit(None)
    nodes = rows.select(F.lit("row").alias("kind"), F.col("r").alias("parent"), none.cast("bigint").alias("child"), none.cast("string").alias("relation"))
    return nodes.unionByName(links.select(F.lit("link").alias("kind"), F.col("seed").alias("parent"), F.col("example").alias("child"), F.lit(T.FEWSHOT_RELATION).alias("relation")))


# Row sampling and batches

_TASKS = "(SELECT DISTINCT task, task_row_id FROM task_rows WHERE split = 'train')"


def train_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_rows").filter(F.col("split") == "train").select("task", "task_row_id").distinct()


@query(
    f"""SELECT task, floor((rn - 1) / 64)::BIGINT AS batch_id, ((rn - 1) % 64)::INT AS slot, task_row_id FROM (
        SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', 'b', task, task_row_id::VARCHAR)), task_row_id) AS rn FROM {_TASKS})"""
)
def batch_index(spark: SparkSession, d: str) -> DataFrame:
    return S.batches(train_rows(spark, d), "task", "task_row_id", 64, "b")


@query(f"SELECT task, floor((rn - 1) / 64)::BIGINT AS batch_id, ((rn - 1) % 64)::INT AS slot, task_row_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY task_row_id) AS rn FROM {_TASKS})")
def batch_index_in_order(spark: SparkSession, d: str) -> DataFrame:
    return S.batches(train_rows(spark, d), "task", "task_row_id", 64)


@query(
    f"""SELECT task, task_row_id FROM (SELECT *, count(*) OVER (PARTITION BY task) AS n,
        row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', 'r', task, task_row_id::VARCHAR)), task_row_id) AS rn FROM {_TASKS}) WHERE rn <= floor(n * 0.3)"""
)
def downsample_ratio(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_ratio(train_rows(spark, d), "task", "task_row_id", 0.3, "r")


@query(
    f"""SELECT task, task_row_id FROM (SELECT *,
        row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', 'a', task, task_row_id::VARCHAR)), task_row_id) AS rn FROM {_TASKS}) WHERE rn <= 128"""
)
def downsample_abs(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_number(train_rows(spark, d), "task", "task_row_id", 128, "a")


@query(
    f"""WITH n AS (SELECT task, count(*) AS n, floor(count(*) * CASE task WHEN 'harbor-Call-berth' THEN 1.5 ELSE 0.5 END)::BIGINT AS draws FROM {_TASKS} GROUP BY task),
    rows AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', task, task_row_id::VARCHAR)), task_row_id) AS number FROM {_TASKS}),
    drawn AS (SELECT task, n, unnest(range(draws)) AS draw FROM n)
    SELECT d.task, d.draw::BIGINT AS draw, r.task_row_id FROM drawn d
    JOIN rows r ON r.task = d.task AND r.number = {_NUMBER.format("'w', d.task, d.draw::VARCHAR")} % d.n + 1"""
)
def sample_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_with_replacement(train_rows(spark, d), "task", "task_row_id", {"harbor-Call-berth": 1.5}, 0.5, "w")


@query(
    """WITH rows AS (SELECT DISTINCT task_row_id, label FROM task_rows WHERE task = 'bazaar-Listing-category' AND label IS NOT NULL AND NOT isnan(label)),
    n AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM rows),
    a AS (SELECT *, md5(concat_ws('|', 's', task_row_id::VARCHAR)) AS h FROM rows),
    f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, task_row_id) AS rn FROM a),
    first AS (SELECT f.* FROM f, n WHERE rn <= greatest(1, 200 // n.k)),
    rest AS (SELECT *, row_number() OVER (ORDER BY h, task_row_id) AS q FROM f WHERE task_row_id NOT IN (SELECT task_row_id FROM first))
    SELECT task_row_id, label FROM first UNION ALL SELECT task_row_id, label FROM rest WHERE q <= 200 - (SELECT count(*) FROM first)"""
)
def stratified_context(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_rows").filter((F.col("task") == "bazaar-Listing-category") & F.col("label").isNotNull() & ~F.isnan("label"))
    return S.stratified_context(t.select("task_row_id", "label").distinct(), "task_row_id", "label", 200, "s")


@query("SELECT task, bool_and(label = floor(label)) AS is_classification FROM task_rows WHERE label IS NOT NULL AND NOT isnan(label) GROUP BY task")
def is_classification(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_rows").filter(~F.isnan("label"))
    return t.groupBy("task").agg(S.is_classification(t, "label").alias("is_classification"))


@query(
    f"""SELECT c_custkey, ({_NUMBER.format("'c', c_custkey::VARCHAR")} % 4)::INT AS column_no,
        ({_NUMBER.format("'c', c_custkey::VARCHAR")} % 4 = 0) AS m0, ({_NUMBER.format("'c', c_custkey::VARCHAR")} % 4 = 3) AS m3 FROM customer"""
)
def random_column(spark: SparkSession, d: str) -> DataFrame:
    """One column per row to be predicted, and the mask that hides it."""
    rows = table(spark, d, "customer").select("c_custkey", (S.hash_number(F.lit("c"), "c_custkey") % 4).cast("int").alias("column_no"))
    mask = onehot_mask(F.col("column_no"), F.lit(4))
    return rows.select("c_custkey", "column_no", mask[0].alias("m0"), mask[3].alias("m3"))
