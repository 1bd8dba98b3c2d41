"""Queries on logs, trials, prompts, merges, sets, windows and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lattica.functions import text as T
from lattica.operators import leaderboard as L
from lattica.operators import merge as G
from lattica.operators import prompts as P
from lattica.operators.asof import as_of
from lattica.plans.graph_queries import round6
from lattica.plans.model_queries import _MENTIONS, _RELATIONS, column_mentions, relations
from lattica.session import table, work_dir
from lattica.sources import datasets as D
from lattica.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Logs

_METRIC = r"test_metric/([A-Za-z0-9_\-]+)(?:/([A-Za-z0-9_]+))?:\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
_LOG = rf"""
    raw AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM raw),
    own AS (SELECT *, CASE WHEN regexp_matches(line, '=== (.+?) ===')
        THEN trim(regexp_replace(trim(regexp_extract(line, '=== (.+?) ===', 1)), '\s*\(.*?\)\s*$', '')) END AS own FROM lines),
    marked AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS marker FROM own),
    parsed AS (SELECT doc_id, line_no::INT AS line_no, marker, regexp_extract(line, '{_METRIC}', 1) AS task, regexp_extract(line, '{_METRIC}', 2) AS metric,
        regexp_extract(line, '{_METRIC}', 3)::DOUBLE AS value FROM marked WHERE own IS NULL AND marker IS NOT NULL AND regexp_matches(line, '{_METRIC}')),
    latest AS (SELECT marker, task, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY marker, task ORDER BY doc_id DESC, line_no DESC) AS rn FROM parsed) WHERE rn = 1),
    numbered AS (SELECT *, coalesce(TRY_CAST(regexp_extract(marker, 'N=(\d+)', 1) AS BIGINT), 0) AS n FROM latest),
    best AS (SELECT task, value AS best, marker AS at_marker FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY value DESC, n, marker) AS rn FROM numbered) WHERE rn = 1)
"""


def parsed_logs(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_logs(L.log_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {_LOG} SELECT * FROM parsed")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsed_logs(spark, d)


@query(f"WITH {_LOG} SELECT * FROM latest")
def log_latest(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(parsed_logs(spark, d), "doc_id")


@query(
    f"""WITH {_LOG}, m AS (SELECT *, regexp_extract(marker, '^([a-z])', 1) AS family FROM latest WHERE regexp_matches(marker, '^[abc]'))
    SELECT task, max(CASE WHEN family = 'a' THEN value END) AS a, max(CASE WHEN family = 'b' THEN value END) AS b, max(CASE WHEN family = 'c' THEN value END) AS c FROM m GROUP BY task"""
)
def leaderboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by families of markers: the best value of each."""
    found = L.latest(parsed_logs(spark, d), "doc_id").filter(F.regexp_like("marker", F.lit("^[abc]")))
    best = found.groupBy("task", F.substring("marker", 1, 1).alias("marker")).agg(F.max("value").alias("value"))
    return L.pivot(best, ["a", "b", "c"])


@query(f"WITH {_LOG} SELECT * FROM best")
def best_of(spark: SparkSession, d: str) -> DataFrame:
    return L.best_of(L.latest(parsed_logs(spark, d), "doc_id")).withColumnRenamed("at", "at_marker")


@query(f"WITH {_LOG} SELECT floor(avg(best) * 1e6 + 0.5) / 1e6 AS average, count(*)::BIGINT AS n_tasks FROM best")
def best_of_average(spark: SparkSession, d: str) -> DataFrame:
    return L.best_of(L.latest(parsed_logs(spark, d), "doc_id")).agg(round6(F.avg("best")).alias("average"), F.count(F.lit(1)).alias("n_tasks"))


@query(
    f"""WITH {_LOG} SELECT task, metric, count(*)::BIGINT AS n, max(value) AS best,
        (grouping(task) * 2 + grouping(metric))::BIGINT AS level FROM parsed GROUP BY CUBE (task, metric)"""
)
def cube_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Counts and bests by task, by metric, by both and over all."""
    return parsed_logs(spark, d).cube("task", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"), F.grouping_id().alias("level"))


_CURVES = "c AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS epoch, o_totalprice AS v FROM orders)"


def curves(spark: SparkSession, d: str) -> DataFrame:
    """A curve of training, as it were: the prices of a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(w).alias("epoch"), F.col("o_totalprice").alias("v"))


@query(
    f"""WITH {_CURVES}, t AS (SELECT *, max(v) OVER (PARTITION BY run ORDER BY epoch) AS top FROM c),
    b AS (SELECT t.*, (SELECT min(u.epoch) FROM t u WHERE u.run = t.run AND u.v = t.top) AS since FROM t),
    s AS (SELECT run, min(CASE WHEN epoch - since > 3 THEN epoch END) AS stop_epoch FROM b GROUP BY run)
    SELECT b.run, max(b.top) AS best, max(b.since) AS best_epoch, any_value(s.stop_epoch) AS stop_epoch FROM b JOIN s ON s.run = b.run
    WHERE s.stop_epoch IS NULL OR b.epoch <= s.stop_epoch GROUP BY b.run"""
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return L.early_stop(curves(spark, d), "run", "epoch", "v", 3)


@query(f"WITH {_CURVES} SELECT run, epoch, v, max(v) OVER (PARTITION BY run ORDER BY epoch) AS top, coalesce(v > max(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_better FROM c WHERE epoch % 3 = 0")
def evaluate_every(spark: SparkSession, d: str) -> DataFrame:
    """The running best of every third epoch."""
    rows = curves(spark, d).filter(F.col("epoch") % 3 == 0)
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("run", "epoch", "v", F.max("v").over(w).alias("top"), F.coalesce(F.col("v") > before, F.lit(True)).alias("is_better"))


_TRIALS = "t AS (SELECT (c_custkey % 40)::INT AS trial, (c_nationkey % 10)::INT AS step, max(c_acctbal) AS v FROM customer GROUP BY 1, 2)"


def trials(spark: SparkSession, d: str) -> DataFrame:
    key = ((F.col("c_custkey") % 40).cast("int").alias("trial"), (F.col("c_nationkey") % 10).cast("int").alias("step"))
    return table(spark, d, "customer").groupBy(*key).agg(F.max("c_acctbal").alias("v"))


@query(
    f"""WITH {_TRIALS} SELECT trial, step, v, count(v) OVER w >= 5 AND coalesce(v < quantile_cont(v, 0.5) OVER w, FALSE) AS pruned FROM t
    WINDOW w AS (PARTITION BY step ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def median_prune(spark: SparkSession, d: str) -> DataFrame:
    return L.median_pruned(trials(spark, d), "trial", "step", "v", 5)


@query(f"WITH {_TRIALS} SELECT trial, max(v) AS value FROM t GROUP BY trial ORDER BY value DESC NULLS LAST, trial LIMIT 5")
def trial_top5(spark: SparkSession, d: str) -> DataFrame:
    return D.top_trials(trials(spark, d).groupBy("trial").agg(F.max("v").alias("value")))


@query(f"WITH {_LOG} SELECT task, metric, marker, value FROM (SELECT *, row_number() OVER (PARTITION BY task, metric ORDER BY value DESC, marker) AS rn FROM latest) WHERE rn = 1")
def keep_best(spark: SparkSession, d: str) -> DataFrame:
    """The run whose weights are kept, per task and metric."""
    return L.keep_best(L.latest(parsed_logs(spark, d), "doc_id"), ["task", "metric"], "value", "marker").select("task", "metric", "marker", "value")


# Prompts

_CLEAN = """CASE WHEN contains({0}, 'Griffin_text_') THEN replace(regexp_replace({0}, '^.*___Griffin_text_', ''), '_', ' ') || ' (text)'
        ELSE replace(regexp_replace({0}, '^.*___', ''), '_', ' ') END"""
_ENTITY = "replace(regexp_replace({0}, '^.*-', ''), '_', ' ')"
_KNOWN = r"^[a-z]+-[A-Z][a-z]+(_[a-z]+)?$"


@query(
    f"""WITH {_MENTIONS}, {_RELATIONS},
    k AS (SELECT DISTINCT entity, name FROM cols WHERE regexp_matches(entity, '{_KNOWN}')),
    t AS (SELECT task, task_type, num_class, metric, masked, seed_entity AS root, {_ENTITY.format("seed_entity")} AS r FROM metatask),
    own AS (SELECT task, string_agg('  - ' || c, chr(10) ORDER BY c) AS s FROM (
        SELECT DISTINCT t.task, {_CLEAN.format("k.name")} AS c FROM t JOIN k ON k.entity = t.root WHERE NOT list_contains(t.masked, k.name)) GROUP BY 1),
    links AS (SELECT root, string_agg(l, chr(10) ORDER BY l) AS s FROM (SELECT DISTINCT entity AS root,
        CASE direction WHEN 'head of' THEN '  - leads to ' ELSE '  - is named by ' END || {_ENTITY.format("dst_entity")} || ' by ' || replace(fk, '_', ' ') AS l FROM reg) GROUP BY 1),
    names AS (SELECT entity, list(DISTINCT {_CLEAN.format("name")} ORDER BY {_CLEAN.format("name")}) AS a FROM k GROUP BY 1),
    one AS (SELECT DISTINCT entity AS root, dst_entity AS near FROM reg WHERE entity <> dst_entity),
    two AS (SELECT DISTINCT a.root, b.near FROM one a JOIN one b ON b.root = a.near WHERE b.near <> a.root AND (a.root, b.near) NOT IN (SELECT (root, near) FROM one)),
    near1 AS (SELECT root, string_agg(l, chr(10) ORDER BY l) AS s FROM (SELECT DISTINCT one.root, '  - ' || {_ENTITY.format("one.near")} || CASE WHEN a IS NULL THEN ''
        ELSE ': [' || array_to_string(a[1:6], ', ') || CASE WHEN len(a) > 6 THEN ', ... (' || len(a)::VARCHAR || ' total)' ELSE '' END || ']' END AS l FROM one LEFT JOIN names ON names.entity = one.near) GROUP BY 1),
    far1 AS (SELECT root, string_agg(l, chr(10) ORDER BY l) AS s FROM (SELECT DISTINCT two.root, '  - ' || {_ENTITY.format("two.near")}
        || ': [' || array_to_string(a[1:6], ', ') || CASE WHEN len(a) > 6 THEN ', ... (' || len(a)::VARCHAR || ' total)' ELSE '' END || ']' AS l FROM two JOIN names ON names.entity = two.near) GROUP BY 1)
    SELECT t.task, 'Task: Predict the value asked for by ''' || replace(replace(t.task, '-', ' '), '_', ' ') || ''' from this record and the records connected to it.' || chr(10)
        || 'Record: ' || t.r || chr(10) || CASE WHEN task_type = 'regression' THEN 'The answer is a number, scored by ' || metric || '.'
            ELSE 'The answer is one of ' || num_class::VARCHAR || ' classes, scored by ' || metric || '.' END
        || coalesce(chr(10) || chr(10) || t.r || ' has' || chr(10) || own.s, '') || coalesce(chr(10) || chr(10) || t.r || ' is connected' || chr(10) || links.s, '')
        || coalesce(chr(10) || chr(10) || 'Connected tables' || chr(10) || near1.s, '') || coalesce(chr(10) || chr(10) || 'Tables behind them' || chr(10) || far1.s, '') AS prompt
    FROM t LEFT JOIN own ON own.task = t.task LEFT JOIN links ON links.root = t.root LEFT JOIN near1 ON near1.root = t.root LEFT JOIN far1 ON far1.root = t.root"""
)
def schema_prompt(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "metatask").select("task", "task_type", "num_class", F.col("seed_entity").alias("root"), "metric", "masked")
    columns = column_mentions(spark, d).filter(F.regexp_like("entity", F.lit(_KNOWN))).select("entity", "name").distinct()
    return P.schema_prompts(tasks, columns, relations(spark, d))


@query(
    """SELECT task, CASE WHEN task_type = 'regression' OR num_class = 1 THEN 'single number' WHEN num_class = 2 THEN 'yes or no' ELSE 'class index' END AS expected,
        'Given the data for ''' || replace(replace(task, '-', ' '), '_', ' ') || ''', which class is it? Output the class index.' AS question
    FROM metatask WHERE task_type = 'regression' OR num_class <= 2"""
)
def prompt_audit(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose question, asked as if all were classifications, doesn't suit the kind of answer."""
    return P.audit(table(spark, d, "metatask"), T.fallback_question(F.col("task"), F.lit("retrieval")))


_PARTS = """
    p AS (SELECT task_row_id, split, unnest([1, 2, 3]) AS part, unnest([length(task), length(seed_text), 4])::BIGINT AS len
        FROM (SELECT DISTINCT task_row_id, split, task, seed_text FROM task_rows WHERE seed_text IS NOT NULL)),
    e AS (SELECT *, sum(len) OVER (PARTITION BY task_row_id ORDER BY part)::BIGINT AS e FROM p)
"""


def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task_rows").filter(F.col("seed_text").isNotNull()).select("task_row_id", "split", "task", "seed_text").distinct()
    lengths = F.array(F.length("task"), F.length("seed_text"), F.lit(4))
    parts = rows.select("task_row_id", "split", F.posexplode(lengths).alias("p", "len"))
    return parts.select("task_row_id", "split", (F.col("p") + 1).alias("part"), F.col("len").cast("bigint").alias("len"))


@query(f'WITH {_PARTS} SELECT task_row_id, part, e - len AS "start", e AS "end" FROM e')
def token_positions(spark: SparkSession, d: str) -> DataFrame:
    return P.part_positions(prompt_parts(spark, d), ["task_row_id"], "part", "len").select("task_row_id", "part", "start", "end")


@query(f"WITH {_PARTS}, n AS (SELECT task_row_id, split, sum(len)::BIGINT AS n FROM p GROUP BY 1, 2) SELECT task_row_id, split, n, (max(n) OVER (PARTITION BY split) - n)::BIGINT AS pad FROM n")
def left_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = prompt_parts(spark, d).groupBy("task_row_id", "split").agg(F.sum("len").alias("n"))
    return P.left_pads(rows, ["split"], "n").select("task_row_id", "split", "n", "pad")


@query(
    """SELECT DISTINCT task_row_id, concat_ws(chr(10), 'Task: Predict the value asked for by ''' || replace(replace(t.task, '-', ' '), '_', ' ') || ''' from this record and the records connected to it.',
        t.seed_text, 'Given the data for ''' || replace(replace(t.task, '-', ' '), '_', ' ') || ''', ' || CASE WHEN task_type = 'regression' THEN 'what is the value? Output a single number.'
            ELSE 'which class is it? Output the class index.' END, CASE WHEN t.split = 'train' THEN format('{:.4f}', t.label) END) AS prompt
    FROM task_rows t JOIN metatask m ON m.task = t.task WHERE t.label IS NOT NULL AND NOT isnan(t.label)"""
)
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The whole prompt of each row, with the answer in training only."""
    tasks = table(spark, d, "metatask").select("task", "task_type")
    rows = table(spark, d, "task_rows").filter(F.col("label").isNotNull() & ~F.isnan("label")).join(tasks, "task")
    task = F.col("task")
    answer = F.when(F.col("split") == "train", T.four_digits(F.col("label")))
    system = F.concat(F.lit("Task: "), T.fallback_description(task))
    prompt = P.assemble(system, T.fallback_question(task, F.col("task_type")), F.col("seed_text"), answer, entity_first=True)
    return rows.select("task_row_id", prompt.alias("prompt")).distinct()


# Merges and sets


@query(
    """WITH a AS (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey AS k, upper(s_name) AS v FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT k, v FROM b UNION ALL SELECT k, v FROM a WHERE k NOT IN (SELECT k FROM b)"""
)
def merge_datasets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return G.merge_override(s.filter("k % 3 <> 0"), s.filter("k % 2 = 0").withColumn("v", F.upper("v")), ["k"])


@query("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 = 0")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return G.conflicts(s.filter("k % 3 = 0"), s.withColumn("v", F.when(F.col("k") % 4 == 0, F.upper("v")).otherwise(F.col("v"))), ["k"], ["v"])


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(spark, d, "supplier").filter("s_acctbal > 0").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_acctbal < 0").select("s_nationkey"))


# Windows, as-of joins and streams


@query(
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, p.event_id AS last_purchase FROM e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM p GROUP BY 1, 2) p ON p.user_id = e.user_id AND p.ts < e.ts"""
)
def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest purchase of the same user before each other event."""
    e = table(spark, d, "events")
    none = F.lit(None).cast("timestamp_ntz")
    events = e.filter("event_type <> 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    changes = e.filter("event_type = 'purchase'").select(F.lit("purchase").alias("kind"), "user_id", F.col("ts").alias("since"), F.col("ts").alias("r1"), none.alias("r2"), F.col("event_id").alias("id"))
    return as_of(events, changes, ["user_id"], "event_id").select("event_id", F.col("id").alias("last_purchase"))


@query(
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, ntile(4) OVER w AS quarter, percent_rank() OVER w AS percent,
        nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.lag(price).over(w).alias("before"),
        F.lead(price).over(w).alias("after"),
        F.ntile(4).over(w).cast("bigint").alias("quarter"),
        F.percent_rank().over(w).alias("percent"),
        F.nth_value(price, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
    )


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS n_customers, floor(avg(o_totalprice) * 1e6 + 0.5) / 1e6 AS mean_price
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""
)
def rollup_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers"), round6(F.avg("o_totalprice")).alias("mean_price")
    )


@query()
def approximate_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey").alias("n_parts"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median_price")
    )


def _streamed(spark: SparkSession, d: str, name: str, make, mode: str) -> DataFrame:
    """What a stream over the events, delivered as files in the order of their time, has written in its batches."""
    at = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table(spark, d, "events").repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    stream = make(W.read_events(spark, f"{at}/in"))
    W.run_to_table(stream, f"{at}/out", f"{at}/state", mode)
    return spark.read.schema(stream.schema.add("batch", T_.LongType())).parquet(f"{at}/out")


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS start_ts, event_type, count(*)::BIGINT AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total
    FROM events GROUP BY 1, 2"""
)
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream of events, run to its end."""
    found = _streamed(spark, d, "windows", lambda e: W.window_counts(e, "ts", "event_type", "value", "1 hour"), "complete")
    return W.last_batch(found).select(F.col("start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes', TRUE)::INT AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL '30 minutes' AS end_ts, count(*)::BIGINT AS n FROM s GROUP BY user_id, session"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with gaps of at least 30 minutes between them."""
    found = W.session_counts(table(spark, d, "events"), "ts", "user_id", "30 minutes")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("SELECT user_id, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last FROM events GROUP BY user_id")
def stream_running_degrees(spark: SparkSession, d: str) -> DataFrame:
    return W.last_per_key(_streamed(spark, d, "degrees", lambda e: W.running_degrees(e, "user_id", "event_id"), "update"), "user_id")


# Datasets on disk


@query("SELECT relation, direction, count(*)::BIGINT AS n, sum(number)::BIGINT AS numbers, max(dst___timestamp) AS last_ts FROM edges GROUP BY 1, 2")
def dataset_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Edges written in their layout, one folder per directed relation, and read again."""
    root = f"{work_dir(spark)}/dataset-{uuid.uuid4().hex}"
    D.write_table(table(spark, d, "edges").withColumnRenamed("number", "row_id"), root, "edges")
    return D.read_table(spark, root, "edges").groupBy("relation", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("numbers"), F.max("dst___timestamp").alias("last_ts"))


@query("SELECT r.entity, r.row_id, e.\"timestamp\" AS ts FROM (SELECT entity, row_id FROM class_rows UNION ALL SELECT entity, row_id FROM entity_rows WHERE row_id % 50 = 0) r JOIN (SELECT DISTINCT entity, row_id, \"timestamp\" FROM entity_rows) e ON e.entity = r.entity AND e.row_id = r.row_id")
def row_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their ids, as often as these are asked for."""
    rows = table(spark, d, "entity_rows").select("entity", "row_id", F.col("timestamp").alias("ts"))
    asked = table(spark, d, "class_rows").select("entity", "row_id").unionByName(rows.filter("row_id % 50 = 0").select("entity", "row_id"))
    key = F.struct("entity", "row_id")
    return D.rows_by_id(rows.distinct().withColumn("key", key).select("key", "ts"), asked.select(key.alias("key")), "key").select("key.entity", "key.row_id", "ts")


@query("SELECT task_type AS task_group, (row_number() OVER (PARTITION BY task_type ORDER BY task) - 1)::INT AS position, task FROM metatask")
def task_groups(spark: SparkSession, d: str) -> DataFrame:
    """Named lists of tasks, here by their type."""
    groups: dict[str, list[str]] = {}
    for r in table(spark, d, "metatask").select("task", "task_type").orderBy("task").collect():
        groups.setdefault(r["task_type"], []).append(r["task"])
    return D.task_groups(spark, groups)
