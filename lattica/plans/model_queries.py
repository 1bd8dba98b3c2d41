"""Queries on metadata, encodings, messages, heads and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import catalog as C
from lattica.functions import text as T
from lattica.functions import vectors as V
from lattica.operators import heads as H
from lattica.operators import message as M
from lattica.operators import metrics as X
from lattica.operators import sampling as S
from lattica.operators import tasks as K
from lattica.plans.graph_queries import _khop_sql, khop, round6
from lattica.session import broadcast_if_small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def unpivot(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("dim", "value")).withColumn("value", round6(F.col("value")))


# Metadata

COLUMN_LINE = r"^ *- ([A-Za-z]+-[A-Za-z_]+)___([a-z_]+) \(([a-z0-9]+)\)$"
_MENTIONS = """
    lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    mentions AS (
        SELECT regexp_extract(line, '^ *- ([A-Za-z]+-[A-Za-z_]+)___([a-z_]+) \\(([a-z0-9]+)\\)$', 1) AS entity,
            regexp_extract(line, '^ *- ([A-Za-z]+-[A-Za-z_]+)___([a-z_]+) \\(([a-z0-9]+)\\)$', 2) AS col,
            regexp_extract(line, '^ *- ([A-Za-z]+-[A-Za-z_]+)___([a-z_]+) \\(([a-z0-9]+)\\)$', 3) AS dtype FROM lines),
    cols AS (
        SELECT entity, entity || '___' || CASE WHEN dtype = 'text' THEN 'Griffin_text_' ELSE '' END || col AS name, dtype, count(*)::BIGINT AS n_mentions
        FROM mentions WHERE entity <> '' GROUP BY 1, 2, 3)
"""


def column_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The columns that schema cards among the documents list: entity, name, dtype, n_mentions."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", COLUMN_LINE, i)
    found = lines.select(part(1).alias("entity"), part(2).alias("col"), part(3).alias("dtype")).filter(F.col("entity") != "")
    prefix = F.when(F.col("dtype") == "text", T.TEXT_PREFIX).otherwise("")
    named = found.withColumn("name", F.concat("entity", F.lit(T.NAME_JOINT), prefix, "col"))
    return named.groupBy("entity", "name", "dtype").agg(F.count(F.lit(1)).alias("n_mentions"))


@query(f"WITH {_MENTIONS} SELECT * FROM cols")
def column_registry(spark: SparkSession, d: str) -> DataFrame:
    return column_mentions(spark, d)


@query(f"WITH {_MENTIONS} SELECT DISTINCT entity, name FROM cols WHERE name NOT IN (SELECT replace(name, 'Griffin_text_', '') FROM cols WHERE contains(name, 'Griffin_text_'))")
def text_shadow(spark: SparkSession, d: str) -> DataFrame:
    return C.without_shadowed(column_mentions(spark, d).select("entity", "name").distinct())


@query(
    f"""WITH {_MENTIONS}
    SELECT name, CASE WHEN contains(name, 'Griffin_text_') THEN replace(regexp_replace(name, '^.*___Griffin_text_', ''), '_', ' ') || ' (text)'
        ELSE replace(regexp_replace(name, '^.*___', ''), '_', ' ') END AS clean_column,
        CASE WHEN contains(entity, '-') THEN replace(regexp_replace(entity, '^.*-', ''), '_', ' ') ELSE entity END AS clean_entity
    FROM (SELECT DISTINCT entity, name FROM cols WHERE regexp_matches(entity, '^[a-z]+-[A-Z][a-z]+(_[a-z]+)?$'))"""
)
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    names = column_mentions(spark, d).filter(F.regexp_like("entity", F.lit("^[a-z]+-[A-Z][a-z]+(_[a-z]+)?$"))).select("entity", "name").distinct()
    return names.select("name", T.clean_column_name(F.col("name")).alias("clean_column"), T.clean_entity_name(F.col("entity")).alias("clean_entity"))


@query(
    """WITH rows AS (
        SELECT DISTINCT entity, row_id, "timestamp" AS ts FROM entity_rows UNION SELECT DISTINCT entity, row_id, NULL FROM class_rows),
    n AS (SELECT entity, count(*) AS n_rows, count(ts) AS n_timed, min(row_id) AS low, max(row_id) AS high FROM rows GROUP BY entity)
    SELECT m.entity, m.num, coalesce(n.n_rows, 0)::BIGINT AS n_rows, coalesce(n.n_rows, 0) = m.num AS is_complete,
        coalesce(n.low >= 0 AND n.high < m.num, TRUE) AS is_in_range, coalesce(n.n_timed, 0) = 0 AS has_no_times, m.is_static, m.is_target
    FROM metanode m LEFT JOIN n ON n.entity = m.entity"""
)
def entity_registry(spark: SparkSession, d: str) -> DataFrame:
    """Entities as declared, held against the rows that there are."""
    none = F.lit(None).cast("timestamp_ntz")
    rows = table(spark, d, "entity_rows").select("entity", "row_id", F.col("timestamp").alias("ts"))
    rows = rows.unionByName(table(spark, d, "class_rows").select("entity", "row_id", none.alias("ts"))).distinct()
    n = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("timed"), F.min("row_id").alias("low"), F.max("row_id").alias("high"))
    return table(spark, d, "metanode").join(n, "entity", "left").select(
        "entity",
        "num",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"),
        (F.coalesce("n", F.lit(0)) == F.col("num")).alias("is_complete"),
        F.coalesce((F.col("low") >= 0) & (F.col("high") < F.col("num")), F.lit(True)).alias("is_in_range"),
        (F.coalesce("timed", F.lit(0)) == 0).alias("has_no_times"),
        "is_static",
        "is_target",
    )


@query(
    """SELECT m.entity, m.num, count(t.task)::BIGINT AS n_tasks, m.is_target AND count(t.task) > 0 AS is_class_table
    FROM metanode m LEFT JOIN metatask t ON t.target_entity = m.entity AND t.task_type = 'retrieval' GROUP BY m.entity, m.num, m.is_target"""
)
def target_entities(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "metatask").filter(F.col("task_type") == "retrieval").groupBy(F.col("target_entity").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, d, "metanode").join(tasks, "entity", "left").withColumn("n_tasks", F.coalesce("n", F.lit(0)).cast("bigint"))
    return joined.select("entity", "num", "n_tasks", (F.col("is_target") & (F.col("n_tasks") > 0)).alias("is_class_table"))


_RELATIONS = """
    r AS (SELECT DISTINCT relation, string_split(relation, ':') AS p FROM edges),
    reg AS (
        SELECT relation, 'head of' AS direction, p[1] AS entity, p[3] AS dst_entity, regexp_replace(p[2], '^[^-]*-', '') AS fk FROM r
            WHERE len(p) = 3 AND NOT ends_with(p[2], '-self_loop') AND NOT starts_with(p[2], 'reverse_')
        UNION ALL SELECT relation, 'tail of', p[3], p[1], regexp_replace(p[2], '^[^-]*-', '') FROM r
            WHERE len(p) = 3 AND NOT ends_with(p[2], '-self_loop') AND NOT starts_with(p[2], 'reverse_') AND p[1] <> p[3])
"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    return C.relation_registry(table(spark, d, "edges"))


@query(f"WITH {_RELATIONS} SELECT * FROM reg")
def relation_registry(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d)


@query(
    """SELECT DISTINCT direction || ' ' || relation AS edge_name, CASE direction WHEN 'head of' THEN 'outgoing' ELSE 'incoming' END AS way,
        split_part(relation, ':', 1) AS source, regexp_replace(split_part(relation, ':', 2), '^[^-]*-', '') AS fk, split_part(relation, ':', 3) AS target,
        entity = CASE direction WHEN 'head of' THEN split_part(relation, ':', 1) ELSE split_part(relation, ':', 3) END AS is_owner
    FROM edges WHERE entity IS NOT NULL"""
)
def relation_endpoints(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").filter(F.col("entity").isNotNull()).select("direction", "relation", "entity").distinct()
    named = e.withColumn("edge_name", F.concat_ws(" ", "direction", "relation"))
    p = T.relation_parts(F.col("edge_name"))
    owner = F.when(p["direction"] == "outgoing", p["source"]).otherwise(p["target"])
    return named.select("edge_name", p["direction"].alias("way"), p["source"].alias("source"), p["fk"].alias("fk"), p["target"].alias("target"), (F.col("entity") == owner).alias("is_owner")).distinct()


@query(
    """SELECT entity, count(DISTINCT row_id)::BIGINT AS n_rows, bool_and("timestamp" IS NULL) AS all_static, min("timestamp") AS first_ts, max("timestamp") AS last_ts
    FROM entity_rows GROUP BY entity"""
)
def static_ts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("timestamp")
    return table(spark, d, "entity_rows").groupBy("entity").agg(
        F.count_distinct("row_id").alias("n_rows"), F.bool_and(t.isNull()).alias("all_static"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts")
    )


@query(
    """SELECT task, task_type, CASE task_type WHEN 'regression' THEN target_entity ELSE seed_entity END AS target,
        CASE task_type WHEN 'regression' THEN seed_entity ELSE target_entity END AS seed, masked[1] AS mask,
        masked[1] = CASE task_type WHEN 'regression' THEN target_entity || '___' || regexp_replace(task, '^.*-', '')
            ELSE seed_entity || '___' || substr(target_entity, length(seed_entity) + 2) END AS mask_agrees
    FROM metatask"""
)
def task_registry(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with seed and target swapped for regressions, and the mask as derived from the names."""
    regression = F.col("task_type") == "regression"
    derived = F.when(regression, F.concat("target_entity", F.lit("___"), F.regexp_replace("task", "^.*-", ""))).otherwise(
        F.concat("seed_entity", F.lit("___"), F.substr(F.col("target_entity"), F.length("seed_entity") + 2))
    )
    return table(spark, d, "metatask").select(
        "task",
        "task_type",
        F.when(regression, F.col("target_entity")).otherwise(F.col("seed_entity")).alias("target"),
        F.when(regression, F.col("seed_entity")).otherwise(F.col("target_entity")).alias("seed"),
        F.get("masked", F.lit(0)).alias("mask"),
        (F.get("masked", F.lit(0)) == derived).alias("mask_agrees"),
    )


@query(
    """SELECT task, split, count(*)::BIGINT AS n_rows, count(nodeidx)::BIGINT AS n_ids, (count(*) FILTER (WHERE label IS NOT NULL AND NOT isnan(label)))::BIGINT AS n_labels,
        count("timestamp")::BIGINT AS n_times FROM (SELECT DISTINCT * FROM task_rows) GROUP BY task, split"""
)
def task_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task_rows").distinct()
    parts = K.union_splits({s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "valid", "test")})
    return K.split_sizes(parts, "nodeidx", "label", "timestamp")


@query(
    """SELECT task, split, node_pairs[2] AS class_id, count(DISTINCT ref_id)::BIGINT AS n_rows FROM metadata
    WHERE len(node_pairs) >= 2 AND (split = 'train' OR labels = 1) GROUP BY 1, 2, 3"""
)
def positive_only(spark: SparkSession, d: str) -> DataFrame:
    return K.retrieval_rows(table(spark, d, "metadata")).groupBy("task", "split", "class_id").agg(F.count_distinct("ref_id").alias("n_rows"))


@query(
    """SELECT 'ALLTASK' AS word, task FROM metatask UNION ALL SELECT 'RETTASK', task FROM metatask WHERE task_type = 'retrieval'
    UNION ALL SELECT 'REGTASK', task FROM metatask WHERE task_type = 'regression'
    UNION ALL SELECT 'ALLTASK EXCEPT__harbor-Call-delay', task FROM metatask WHERE task <> 'harbor-Call-delay'
    UNION ALL SELECT 'RETTASK orchard', task FROM metatask WHERE task_type = 'retrieval' OR starts_with(task, 'orchard')"""
)
def keyword_except(spark: SparkSession, d: str) -> DataFrame:
    known = [tuple(r) for r in table(spark, d, "metatask").select("task", "task_type").orderBy("task").collect()]
    groups = {"orchard": [t for t, _ in known if t.startswith("orchard")]}
    words = ("ALLTASK", "RETTASK", "REGTASK", "ALLTASK EXCEPT__harbor-Call-delay", "RETTASK orchard")
    return spark.createDataFrame([(w, t) for w in words for t in C.resolve_tasks(w.split(), known, groups)], "word string, task string")


@query(
    _khop_sql(2, 3)
    + """SELECT i.depth::INT AS depth, count(*)::BIGINT AS n_instances, count(CASE WHEN i.depth > 0 THEN c.c_acctbal END)::BIGINT AS n_visible,
        count(CASE WHEN i.depth > 0 AND i.row_id <> i.seed_id THEN c.c_acctbal END)::BIGINT AS n_visible_strict
    FROM inst i JOIN customer c ON i.entity = 'customer' AND c.c_custkey = i.row_id GROUP BY 1"""
)
def seed_mask(spark: SparkSession, d: str) -> DataFrame:
    """A masked column is hidden on the seeds only; visits of the seed's row later on show it, unless masked as well."""
    found = khop(spark, d, 2, 3)[0].filter(F.col("entity") == "customer")
    rows = found.join(table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("shown")), "row_id").withColumn("strict", F.col("shown"))
    hidden = K.masked(rows.withColumn("seed", F.col("depth") == 0), ["shown"], "seed")
    strict = K.masked(hidden.withColumn("own", F.col("row_id") == F.col("seed_id")), ["strict"], "own")
    return strict.groupBy("depth").agg(F.count(F.lit(1)).alias("n_instances"), F.count("shown").alias("n_visible"), F.count("strict").alias("n_visible_strict"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def column_drop(spark: SparkSession, d: str) -> DataFrame:
    """The variant that hides a masked column of the whole root entity."""
    return table(spark, d, "customer").drop("c_acctbal")


_SPACE = """
    r AS (SELECT 'customer' AS entity, 0 AS place, c_custkey AS row_id FROM customer UNION ALL SELECT 'nation', 1, n_nationkey FROM nation
        UNION ALL SELECT 'region', 2, r_regionkey FROM region UNION ALL SELECT 'supplier', 3, s_suppkey FROM supplier)
"""


def index_space(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keys = (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"))
    return K.unified([(t, table(spark, d, t), k) for t, k in keys], "customer")


@query(f"WITH {_SPACE} SELECT entity, row_id::BIGINT AS row_id, (row_number() OVER (ORDER BY place, row_id) - 1)::BIGINT AS position FROM r")
def hetero_union(spark: SparkSession, d: str) -> DataFrame:
    return index_space(spark, d)[0]


@query(f'WITH {_SPACE}, n AS (SELECT entity, place, count(*) AS n FROM r GROUP BY 1, 2) SELECT entity, n::BIGINT AS n, (sum(n) OVER (ORDER BY place) - n)::BIGINT AS "offset" FROM n')
def type_offsets(spark: SparkSession, d: str) -> DataFrame:
    return index_space(spark, d)[1]


# Encodings


@query(
    """WITH v AS (SELECT *, (row_number() OVER (ORDER BY md5(o_orderpriority)) - 1)::BIGINT AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT v.code, v.o_orderpriority AS value, count(*)::BIGINT AS n_rows FROM orders JOIN v USING (o_orderpriority) GROUP BY 1, 2"""
)
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    """A text column as codes into a dictionary, and back."""
    o = table(spark, d, "orders").select("o_orderpriority")
    words = K.dictionary(o, "o_orderpriority")
    coded = H.lookup(o, "o_orderpriority", words, "value").select("code")
    return H.lookup(coded.withColumnRenamed("code", "c"), "c", words).groupBy("code", "value").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """WITH k AS (SELECT DISTINCT c_nationkey AS code FROM customer), i AS (SELECT unnest(range(8))::INT AS dim)
    SELECT code, dim, floor(cos(code * pow(10, -2 + 3 * dim / 7.0)) * 1e6 + 0.5) / 1e6 AS value FROM k CROSS JOIN i"""
)
def category_cosine(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "customer").select(F.col("c_nationkey").alias("code")).distinct()
    return unpivot(codes.select("code", V.category_encoding(F.col("code"), 8).alias("vec")), ["code"])


@query()
def numeric_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", V.numeric_encoding(F.col("c_acctbal"), 8).alias("vec"))
    return rows.select("c_custkey", round6(V.numeric_decoding(F.col("vec"), F.array(*[F.lit(1.0 / (i + 1)) for i in range(8)]))).alias("decoded"))


def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("x"), "label")


_LONG = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(
    f"""WITH {_LONG}, s AS (SELECT vec_id, avg(v) AS m, var_pop(v) AS s2 FROM x GROUP BY 1)
    SELECT vec_id, dim::INT AS dim, floor((v - m) / sqrt(s2 + 1e-5) * 1e6 + 0.5) / 1e6 AS value FROM x JOIN s USING (vec_id)"""
)
def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    return unpivot(embedding_rows(spark, d).select(F.col("id").alias("vec_id"), V.layer_norm(F.col("x")).alias("vec")), ["vec_id"])


@query(
    f"""WITH {_LONG}, s AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1)
    SELECT vec_id, dim::INT AS dim, floor(v / n * 1e6 + 0.5) / 1e6 AS value FROM x JOIN s USING (vec_id)"""
)
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return unpivot(embedding_rows(spark, d).select(F.col("id").alias("vec_id"), V.l2_normalize(F.col("x")).alias("vec")), ["vec_id"])


# Messages

DIM = 64
_GRAPH = """
    g AS (
        SELECT 'near' AS relation, vec_id AS src, (vec_id * 7 + 1) % 500 AS dst FROM embeddings WHERE label < 8
        UNION ALL SELECT 'near', vec_id, (vec_id * 3 + 2) % 500 FROM embeddings WHERE label < 8
        UNION ALL SELECT 'far', vec_id, (vec_id * 13 + 5) % 500 FROM embeddings WHERE label >= 4),
    rel AS (SELECT * FROM (VALUES ('near', 1), ('far', 2)) t(relation, code) CROSS JOIN (SELECT unnest(range(64)) AS dim))
"""


def vector_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = embedding_rows(spark, d)
    to = lambda a, b: ((F.col("id") * a + b) % 500).alias("dst")
    near = nodes.filter("label < 8").select(F.lit("near").alias("relation"), F.col("id").alias("src"), to(7, 1))
    more = nodes.filter("label < 8").select(F.lit("near").alias("relation"), F.col("id").alias("src"), to(3, 2))
    far = nodes.filter("label >= 4").select(F.lit("far").alias("relation"), F.col("id").alias("src"), to(13, 5))
    rel = spark.createDataFrame([("near", 1), ("far", 2)], "relation string, code int").select("relation", V.category_encoding(F.col("code"), DIM).alias("rel"))
    return nodes.select("id", "x"), near.unionByName(more).unionByName(far), rel


def _messages_sql(src: str, dst: str) -> str:
    return f"""WITH {_LONG}, {_GRAPH},
    m AS (SELECT g.{src} AS id, g.relation, x.dim, avg(x.v) AS mean FROM g JOIN x ON x.vec_id = g.{dst} GROUP BY 1, 2, 3),
    t AS (SELECT m.id, m.dim, max(m.mean * cos(r.code * pow(10, -2 + 3 * r.dim / 63.0))) AS v FROM m JOIN rel r ON r.relation = m.relation AND r.dim = m.dim GROUP BY 1, 2)
    SELECT x.vec_id AS id, x.dim::INT AS dim, coalesce(floor(t.v * 1e6 + 0.5) / 1e6, 0.0) AS value FROM x LEFT JOIN t ON t.id = x.vec_id AND t.dim = x.dim"""


@query(_messages_sql("src", "dst"))
def mean_max_forward(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, rel = vector_graph(spark, d)
    return unpivot(M.relational_messages(nodes, edges, rel, DIM), ["id"], "message")


@query(_messages_sql("dst", "src"))
def mean_max_reverse(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, rel = vector_graph(spark, d)
    return unpivot(M.relational_messages(nodes, edges, rel, DIM, reverse=True), ["id"], "message")


def _layers(spark: SparkSession, d: str, sequential: bool) -> DataFrame:
    nodes, edges, rel = vector_graph(spark, d)
    layers = [M.Layer.seeded(DIM, seed, zero_gates=False) for seed in (1, 2)]
    out = None
    for i, x in M.message_passing(nodes, edges, rel, layers, DIM, sequential):
        part = x.select(F.lit(i).alias("layer"), "id", round6(V.total(F.col("x"))).alias("total"), round6(F.get("x", F.lit(0))).alias("first"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def gnn_layer_parallel(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d, False)


@query()
def gnn_layer_sequential(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d, True)


@query(f"WITH {_LONG} SELECT label, dim::INT AS dim, floor(avg(v) * 1e6 + 0.5) / 1e6 AS value FROM x GROUP BY 1, 2")
def column_mean_context(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per label, as the context of a task that has no vector of its own."""
    return unpivot(M.mean_vectors(embedding_rows(spark, d), ["label"], "x", DIM), ["label"])


_FEATURES = """
    f AS (SELECT c_custkey, c_acctbal, c_nationkey, [c_acctbal / 1000.0, c_nationkey / 10.0, 1.0] AS s FROM customer),
    w AS (SELECT c_custkey, s, exp(s[1] - greatest(s[1], s[3])) AS e1, exp(s[3] - greatest(s[1], s[3])) AS e3 FROM f)
"""


@query(
    f"""WITH {_FEATURES}
    SELECT c_custkey, floor((e1 * s[1] + e3 * s[3]) / (e1 + e3) * 1e6 + 0.5) / 1e6 AS pooled, floor((e1 * 1.0 + e3 * 9.0) / (e1 + e3) * 1e6 + 0.5) / 1e6 AS squared FROM w"""
)
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a row pooled by softmax weights; the second one is masked."""
    c = F.col
    scores = F.array(c("c_acctbal") / 1000.0, c("c_nationkey") / 10.0, F.lit(1.0))
    weights = V.masked_softmax_weights(scores, F.array(F.lit(True), F.lit(False), F.lit(True)))
    vectors = F.array(F.array(c("c_acctbal") / 1000.0, F.lit(1.0)), F.array(F.lit(5.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(9.0)))
    pooled = table(spark, d, "customer").select("c_custkey", V.weighted_sum(vectors, weights, 2).alias("p"))
    return pooled.select("c_custkey", round6(c("p")[0]).alias("pooled"), round6(c("p")[1]).alias("squared"))


@query(
    """SELECT vec_id, floor((embedding[1]::DOUBLE * exp(0.0) + embedding[2]::DOUBLE * exp(1.0) + embedding[3]::DOUBLE * exp(-1.0)) / (exp(0.0) + exp(1.0) + exp(-1.0)) * 1e6 + 0.5) / 1e6 AS mixed FROM embeddings"""
)
def layer_mix(spark: SparkSession, d: str) -> DataFrame:
    """Softmax mixture of the last layers, here of three one-number ones."""
    rows = embedding_rows(spark, d)
    layers = F.array(*[F.array(F.get("x", F.lit(i))) for i in range(3)])
    return rows.select(F.col("id").alias("vec_id"), round6(M.mix_layers(layers, [0.0, 1.0, -1.0], 1)[0]).alias("mixed"))


@query(
    """WITH p AS (SELECT l_orderkey, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS rn FROM lineitem)
    SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_extendedprice END) AS last_price, floor(avg(l_quantity) * 1e6 + 0.5) / 1e6 AS mean_quantity FROM p GROUP BY 1"""
)
def position_pool(spark: SparkSession, d: str) -> DataFrame:
    """The last position of a sequence, beside the mean of all."""
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_extendedprice", order).alias("last_price"), round6(F.avg("l_quantity")).alias("mean_quantity"))


# Heads and metrics

_CENTERS = f"{_LONG}, c AS (SELECT label AS class_id, dim, avg(v) AS c FROM x GROUP BY 1, 2), z AS (SELECT x.vec_id, x.label, c.class_id, sum(x.v * c.c) AS z FROM x JOIN c USING (dim) GROUP BY 1, 2, 3)"


def scored_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with a logit per class: the product with the mean vector of the class."""
    rows = embedding_rows(spark, d)
    classes = M.mean_vectors(rows, ["label"], "x", DIM, "c").select(F.col("label").alias("class_id"), "c")
    return H.class_scores(rows, classes).select(F.col("id").alias("vec_id"), "label", "logits")


@query(f"WITH {_CENTERS} SELECT vec_id, class_id, floor(z * 1e6 + 0.5) / 1e6 AS score FROM z")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    return unpivot(scored_embeddings(spark, d), ["vec_id"], "logits").withColumnsRenamed({"dim": "class_id", "value": "score"})


@query(f"WITH {_CENTERS}, b AS (SELECT vec_id, label, class_id, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class_id) AS rn FROM z) SELECT avg((class_id = label)::INT::DOUBLE) AS score FROM b WHERE rn = 1")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return X.hit_rate(scored_embeddings(spark, d), [], "logits", "label")


@query(
    f"""WITH {_CENTERS}, l AS (SELECT vec_id, max(z) + ln(sum(exp(z - m))) AS l FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z) GROUP BY vec_id)
    SELECT floor(-avg(l.l - z.z) * 1e6 + 0.5) / 1e6 AS score FROM z JOIN l USING (vec_id) WHERE z.class_id = z.label"""
)
def logloss(spark: SparkSession, d: str) -> DataFrame:
    return X.logloss(scored_embeddings(spark, d), [], "logits", "label").select(round6(F.col("score")).alias("score"))


@query(
    f"""WITH {_CENTERS}, p AS (SELECT vec_id, label, class_id, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z)),
    r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY p) AS rn FROM p),
    a AS (SELECT class_id, sum(CASE WHEN label = class_id THEN rn END) AS s, (count(*) FILTER (WHERE label = class_id))::DOUBLE AS n1, (count(*) FILTER (WHERE label <> class_id))::DOUBLE AS n0 FROM r GROUP BY 1)
    SELECT floor(avg((s - n1 * (n1 + 1) / 2) / (n1 * n0)) * 1e6 + 0.5) / 1e6 AS score FROM a WHERE n1 > 0 AND n0 > 0"""
)
def auroc_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return X.auroc_multiclass(scored_embeddings(spark, d), [], "logits", "label").select(round6(F.col("score")).alias("score"))


@query(
    """WITH k AS (SELECT DISTINCT event_type AS kind FROM events), e AS (SELECT kind, value, (event_type = kind)::INT AS y FROM events CROSS JOIN k),
    c AS (SELECT kind, value, sum(y) AS pos, count(*) - sum(y) AS neg FROM e GROUP BY 1, 2),
    r AS (SELECT *, sum(neg) OVER (PARTITION BY kind ORDER BY value) - neg AS below FROM c)
    SELECT kind, floor(sum(pos * (below + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE * 1e6 + 0.5) / 1e6 AS score FROM r GROUP BY kind"""
)
def auroc_binary(spark: SparkSession, d: str) -> DataFrame:
    """The value of an event as a score of each kind of event."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(1000).collect()]
    each = e.select("value", "event_type", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    scores = X.auroc_binary(each, ["kind"], "value", F.col("event_type") == F.col("kind"))
    return scores.select("kind", round6(F.col("score")).alias("score"))


_NUMBER = "concat('0x', substr(md5(concat_ws('|', 'p', task_row_id::VARCHAR)), 1, 8))::BIGINT"
_PREDICTED = f"""
    p AS (SELECT DISTINCT r.task, r.task_row_id, r.label, r.label + ({_NUMBER} % 201 - 100) / 50.0 AS predicted
        FROM task_rows r JOIN metatask m ON m.task = r.task WHERE m.task_type = 'regression' AND r.split = 'test' AND r.label IS NOT NULL AND NOT isnan(r.label))
"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Test rows of regressions with a made-up prediction; labels that are NULL or NaN among them."""
    tasks = broadcast_if_small(table(spark, d, "metatask").filter(F.col("task_type") == "regression").select("task"))
    rows = table(spark, d, "task_rows").filter(F.col("split") == "test").join(tasks, "task").select("task", "task_row_id", "label").distinct()
    return rows.withColumn("predicted", F.coalesce("label", F.lit(0.0)) + (S.hash_number(F.lit("p"), "task_row_id") % 201 - 100) / 50.0)


@query(f"WITH {_PREDICTED} SELECT task, floor(-sqrt(avg((predicted - label) ** 2)) * 1e6 + 0.5) / 1e6 AS score FROM p GROUP BY task")
def rmse(spark: SparkSession, d: str) -> DataFrame:
    return X.rmse(predictions(spark, d), ["task"], "predicted", "label").withColumn("score", round6(F.col("score")))


@query(f"WITH {_PREDICTED} SELECT task, floor(-avg(abs(predicted - label)) * 1e6 + 0.5) / 1e6 AS score FROM p GROUP BY task")
def mae(spark: SparkSession, d: str) -> DataFrame:
    return X.mae(predictions(spark, d), ["task"], "predicted", "label").withColumn("score", round6(F.col("score")))


@query(f"WITH {_PREDICTED} SELECT floor(avg(s) * 1e6 + 0.5) / 1e6 AS average FROM (SELECT -avg(abs(predicted - label)) AS s FROM p GROUP BY task)")
def task_average(spark: SparkSession, d: str) -> DataFrame:
    return X.task_average(X.evaluate(predictions(spark, d), ["task"], "mae", "predicted", "label")).select(round6(F.col("average")).alias("average"))


@query(f"WITH {_PREDICTED} SELECT task, floor(avg(CASE WHEN abs(predicted - label) <= 1 THEN 0.5 * (predicted - label) ** 2 ELSE abs(predicted - label) - 0.5 END) * 1e6 + 0.5) / 1e6 AS loss, floor(avg((predicted - label) ** 2) * 1e6 + 0.5) / 1e6 AS mse FROM p GROUP BY task")
def huber_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).filter(X.valid(F.col("label")))
    miss = F.col("predicted") - F.col("label")
    return rows.groupBy("task").agg(round6(F.avg(V.huber_loss(F.col("predicted"), F.col("label")))).alias("loss"), round6(F.avg(miss * miss)).alias("mse"))


@query(
    f"""WITH {_CENTERS}, l AS (SELECT vec_id, label, class_id, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY vec_id)) AS lp FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z))
    SELECT label, floor(avg((1 - exp(lp)) ** 2 * -lp) * 1e6 + 0.5) / 1e6 AS loss FROM l WHERE class_id = label GROUP BY label"""
)
def focal_loss(spark: SparkSession, d: str) -> DataFrame:
    return scored_embeddings(spark, d).groupBy("label").agg(round6(F.avg(V.focal_loss(F.col("logits"), F.col("label")))).alias("loss"))


@query(
    f"""WITH {_LONG}, c AS (SELECT label, dim, avg(v) AS c FROM x GROUP BY 1, 2),
    s AS (SELECT vec_id, label, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) AS s FROM x JOIN c USING (label, dim) GROUP BY 1, 2)
    SELECT label, floor((1 - avg(s)) * 1e6 + 0.5) / 1e6 AS loss FROM s GROUP BY label"""
)
def cosine_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding_rows(spark, d)
    centers = M.mean_vectors(rows, ["label"], "x", DIM, "c")
    return rows.join(centers, "label").groupBy("label").agg(round6(1 - F.avg(V.cosine(F.col("x"), F.col("c")))).alias("loss"))


_STATS = """
    l AS (SELECT DISTINCT task, task_row_id, split, label FROM task_rows WHERE label IS NOT NULL AND NOT isnan(label)),
    s AS (SELECT task, count(*)::BIGINT AS n, avg(label) AS center, stddev_pop(label) + 1e-6 AS spread FROM l WHERE split = 'train' GROUP BY task)
"""


def train_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task_rows").filter(F.col("split") == "train").select("task", "task_row_id", "label").distinct()
    return X.target_statistics(rows, ["task"], "label")


@query(f"WITH {_STATS} SELECT task, n, floor(center * 1e6 + 0.5) / 1e6 AS center, floor(spread * 1e6 + 0.5) / 1e6 AS spread FROM s")
def target_stats(spark: SparkSession, d: str) -> DataFrame:
    return train_statistics(spark, d).withColumns({"center": round6(F.col("center")), "spread": round6(F.col("spread"))})


@query(f"WITH {_STATS} SELECT l.task, l.split, floor(avg((label - center) / spread) * 1e6 + 0.5) / 1e6 AS mean_z, 0.0::DOUBLE AS worst FROM l JOIN s USING (task) GROUP BY 1, 2")
def zscore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task_rows").select("task", "task_row_id", "split", "label").distinct().filter(X.valid(F.col("label")))
    z = rows.join(train_statistics(spark, d), "task").withColumn("z", V.zscore(F.col("label"), F.col("center"), F.col("spread")))
    back = V.unzscore(F.col("z"), F.col("center"), F.col("spread"))
    return z.groupBy("task", "split").agg(round6(F.avg("z")).alias("mean_z"), round6(F.max(F.abs(back - F.col("label")))).alias("worst"))


@query(
    """WITH c AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 = 0), q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 <> 0),
    s AS (SELECT q.vec_id, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rn FROM q CROSS JOIN c)
    SELECT vec_id, floor(avg(label) * 1e6 + 0.5) / 1e6 AS prediction FROM s WHERE rn <= 5 GROUP BY vec_id"""
)
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    """A head without training: the mean label of the five nearest rows of its context."""
    rows = embedding_rows(spark, d)
    head = H.NearestNeighbors(5).fit(rows.filter("id % 5 = 0"), "x", "label", "id")
    return head.predict(rows.filter("id % 5 <> 0"), "id", "x").select(F.col("id").alias("vec_id"), round6(F.col("prediction")).alias("prediction"))


@query()
def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding_rows(spark, d)
    weights = H.ridge_probe(rows.filter("id % 5 <> 0"), "x", "label", DIM)
    return H.probe_scores(rows.filter("id % 5 = 0"), "x", weights).select(F.col("id").alias("vec_id"), "label", F.round("prediction", 4).alias("prediction"))


@query("SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY label")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*)::BIGINT AS n FROM (SELECT DISTINCT task_row_id, label FROM task_rows WHERE label IS NOT NULL AND NOT isnan(label)) GROUP BY label ORDER BY n DESC, label LIMIT 5")
def label_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent labels."""
    rows = table(spark, d, "task_rows").filter(X.valid(F.col("label"))).select("task_row_id", "label").distinct()
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(5)


@query(
    """SELECT event_id, coalesce(TRY_CAST(list_last(string_split(trim(s), ' ')) AS DOUBLE), 0.0) AS number FROM (
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Answer: ' || user_id::VARCHAR WHEN event_id % 3 = 1 THEN '' ELSE 'not a number' END AS s FROM events)"""
)
def parse_prediction_text(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 3
    said = F.when(i == 0, F.concat(F.lit("Answer: "), F.col("user_id").cast("string"))).when(i == 1, "").otherwise("not a number")
    return table(spark, d, "events").select("event_id", T.last_number(said).alias("number"))


@query(
    """SELECT vec_id, i::INT AS class_id, CASE WHEN i = label - 2 THEN 10.0 ELSE -10.0 END::DOUBLE AS logit FROM embeddings CROSS JOIN (SELECT unnest(range(6)) AS i)"""
)
def onehot_logits(spark: SparkSession, d: str) -> DataFrame:
    """Logits from a class number; numbers out of range give the lowest logits only."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.onehot_logits(F.col("label") - 2, 6)).alias("class_id", "logit"))
    return rows


# What else a loader needs


@query(f"WITH {_RELATIONS} SELECT entity, (count(*) FILTER (WHERE direction = 'head of'))::BIGINT AS n_out, (count(*) FILTER (WHERE direction = 'tail of'))::BIGINT AS n_in, string_agg(direction || ' ' || relation, '; ' ORDER BY direction, relation) AS adjacency FROM reg GROUP BY entity")
def entity_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """The relations of each entity, folded into its metadata."""
    names = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "direction", "relation"))), "; ")  # relations of one entity
    return relations(spark, d).groupBy("entity").agg(
        F.count_if(F.col("direction") == "head of").alias("n_out"), F.count_if(F.col("direction") == "tail of").alias("n_in"), names.alias("adjacency")
    )


@query(f"WITH {_MENTIONS} SELECT entity, count(DISTINCT name)::BIGINT AS n_columns FROM cols GROUP BY entity HAVING count(DISTINCT name) > 1")
def completion_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with more than one column, of which one can be predicted from the others."""
    return column_mentions(spark, d).groupBy("entity").agg(F.count_distinct("name").alias("n_columns")).filter("n_columns > 1")


@query(
    f"""WITH {_MENTIONS} SELECT t.task, count(DISTINCT c.name)::BIGINT AS n_columns, (count(DISTINCT c.name) FILTER (WHERE NOT list_contains(t.masked, c.name)))::BIGINT AS n_visible
    FROM metatask t JOIN cols c ON c.entity = t.seed_entity GROUP BY t.task"""
)
def visible_columns(spark: SparkSession, d: str) -> DataFrame:
    columns = column_mentions(spark, d).groupBy("entity").agg(F.collect_set("name").alias("names"))
    tasks = table(spark, d, "metatask").join(columns, F.col("seed_entity") == F.col("entity"))
    return tasks.select("task", F.size("names").cast("bigint").alias("n_columns"), F.size(F.array_except("names", "masked")).cast("bigint").alias("n_visible"))


@query(
    """SELECT t.task, c.row_id AS class_id, c.name FROM metatask t JOIN (SELECT DISTINCT entity, row_id, name FROM class_rows) c ON c.entity = t.target_entity
    WHERE t.task_type = 'retrieval' AND c.row_id >= 0 AND c.row_id < t.num_class"""
)
def class_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The class rows 0 .. K-1 of each task's target entity."""
    tasks = table(spark, d, "metatask").filter(F.col("task_type") == "retrieval").select("task", F.col("target_entity").alias("entity"), "num_class")
    classes = table(spark, d, "class_rows").select("entity", "row_id", "name").distinct()
    return classes.join(broadcast_if_small(tasks), "entity").filter((F.col("row_id") >= 0) & (F.col("row_id") < F.col("num_class"))).select("task", F.col("row_id").alias("class_id"), "name")


_TEXTS = """
    t AS (SELECT code, list_transform(emb, lambda x: x::DOUBLE) AS e FROM textemb),
    s AS (SELECT code, e IS NULL OR len(e) = 0 AS is_missing, len(e) <> 64 AS is_short, e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x = 0)) AS is_zero,
        e IS NOT NULL AND len(e) > 0 AND list_bool_or(list_transform(e, lambda x: NOT isfinite(x))) AS is_not_finite FROM t)
"""


@query(
    f"""WITH {_TEXTS} SELECT count(*)::BIGINT AS n, count_if(is_missing)::BIGINT AS n_missing, count_if(coalesce(is_short, FALSE))::BIGINT AS n_other_length,
        count_if(is_zero)::BIGINT AS n_zero, count_if(is_not_finite)::BIGINT AS n_not_finite FROM s"""
)
def vector_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are missing, of another length, zero or not finite."""
    e = F.col("emb")
    some = e.isNotNull() & (F.size(e) > 0)
    odd = F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return table(spark, d, "textemb").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(e.isNull() | (F.size(e) == 0)).alias("n_missing"),
        F.count_if(e.isNotNull() & (F.size(e) != DIM)).alias("n_other_length"),
        F.count_if(some & F.forall(e, lambda x: x == 0)).alias("n_zero"),
        F.count_if(some & odd).alias("n_not_finite"),
    )


@query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count_if(coalesce(n, 0) < 8)::BIGINT AS n_short, sum(greatest(8 - coalesce(n, 0), 0))::BIGINT AS n_empty_slots FROM customer LEFT JOIN n ON o_custkey = c_custkey")
def slot_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with fewer neighbours than slots, and the slots left empty."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    empty = F.greatest(F.lit(8) - F.coalesce("n", F.lit(0)), F.lit(0))
    return table(spark, d, "customer").join(n, "c_custkey", "left").agg(F.count_if(empty > 0).alias("n_short"), F.sum(empty).cast("bigint").alias("n_empty_slots"))


@query()
def seed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that a head is fitted on: one per seed after two layers, with its label."""
    nodes, edges, rel = vector_graph(spark, d)
    layers = [M.Layer.seeded(DIM, seed, zero_gates=False) for seed in (1, 2)]
    *_, (_, last) = M.message_passing(nodes, edges, rel, layers, DIM)
    seeds = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return last.join(seeds, "id").select("id", "label", round6(V.norm(F.col("x"))).alias("norm"))


@query()
def model_forward(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of the whole model: two kinds of nodes with two and one columns, one of them hidden on some."""
    nodes, edges, rel = vector_graph(spark, d)
    kind = F.when(F.col("id") % 2 == 0, "even").otherwise("odd")
    hidden = F.when(F.col("id") % 10 != 0, F.col("x"))
    columns = F.when(F.col("id") % 2 == 0, F.array(hidden, V.l2_normalize(F.col("x")))).otherwise(F.array("x"))
    rows = nodes.select("id", kind.alias("entity"), columns.alias("columns"), F.lit(None).cast("array<double>").alias("task"))
    names = {"even": M.np.eye(2, DIM), "odd": M.np.eye(1, DIM, 5)}
    out = M.run_model(rows, names, edges, rel, [M.ModelLayer.seeded(DIM, k, zero_gates=False) for k in (1, 2)], DIM)
    return out.select("id", round6(F.get("x", F.lit(0))).alias("first"), round6(V.norm(F.col("x"))).alias("norm"))
