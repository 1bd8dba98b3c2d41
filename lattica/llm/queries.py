"""The queries of the problems on training data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.language import document_languages, fit_languages, label_language, segments
from lattica.llm.mixture import mix
from lattica.llm.nested_sample import nested_sample
from lattica.llm.overlap import near_copies
from lattica.llm.similar_vectors import fit_index, similar_pairs
from lattica.llm.tokens import count_tokens, encode_documents
from lattica.session import table


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return nested_sample(table(spark, d, "task_rows"), ["task", "nodeidx"], "batch_no", 0.1)


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_rows")
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("valid", "test"), 1)
    return t.select(F.col("task_row_id").alias("id"), "task", side.alias("side"), "label", F.col("timestamp").alias("at"), F.col("seed_text").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = near_copies(split_rows(spark, d))
    a = members.select(F.col("class").alias("class_a"), F.col("id").alias("id_a"))
    b = members.select(F.col("class").alias("class_b"), F.col("id").alias("id_b"))
    rows = pairs.join(a, "class_a").join(b, "class_b")
    return rows.select(F.least("id_a", "id_b").alias("row_id_a"), F.greatest("id_a", "id_b").alias("row_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per task, split and source: the rows outside train, those with a copy in train, the pairs, the mean overlap.

    Counted per class of copies, so a class of many rows costs as much as one of a single row.
    """
    pairs, members = near_copies(split_rows(spark, d))
    trained = members.filter("side = 0").groupBy(F.col("class").alias("class_a")).agg(F.count(F.lit(1)).alias("n"))
    per_class = pairs.join(trained, "class_a").groupBy(F.col("class_b").alias("class")).agg(F.sum("n").alias("pairs"), F.max("overlap").alias("overlap"))
    t = table(spark, d, "task_rows").filter(F.col("split").isin("valid", "test"))
    rows = t.select(F.col("task_row_id").alias("id"), "task", "split", "source").distinct()
    met = members.filter("side = 1").join(per_class, "class").select("id", "pairs", "overlap")
    return rows.join(met, "id", "left").groupBy("task", "split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("pairs").alias("n_overlapping"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        F.avg("overlap").alias("mean_overlap"),
    )


VECTOR_NUMBERS = 64


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(table(spark, d, "textemb").select("code", "emb"), "code", "emb", VECTOR_NUMBERS, 0.9)
    return pairs.select(F.col("a").alias("code_a"), F.col("b").alias("code_b"))


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of every vector whose code is divisible by 100, against all vectors."""
    t = table(spark, d, "textemb").select("code", "emb")
    found = fit_index(t, "code", "emb", VECTOR_NUMBERS).search(t, t.filter(F.col("code") % 100 == 0), k=10, probes=48)
    return found.select(F.col("query").alias("code"), "rank", F.col("id").alias("neighbour"), F.round("cosine", 5).alias("cosine"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"), "doc_id", "text")


def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"), "doc_id", "text")


def mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = count_tokens(table(spark, d, "documents"), "doc_id", "text", ["source"])
    return mix(sizes, table(spark, d, "mix_weights"), "doc_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d)[1]


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    found = segments(docs, "doc_id", "text", fit_languages(docs, "doc_id", "text", "lang"))
    return found.drop("sure", "letters").withColumn("confidence", F.round("confidence", 4))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return document_languages(segments(docs, "doc_id", "text", fit_languages(docs, "doc_id", "text", "lang")), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """A document of several languages has a row for each of them, any other one if its main language isn't its label."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", label_language(F.col("lang")).alias("label"))
    found = document_languages(segments(docs, "doc_id", "text", fit_languages(docs, "doc_id", "text", "lang"), ["label"]), "doc_id", ["label"])
    wrong = F.col("main") & ~F.col("several") & ~F.col("label").eqNullSafe(F.col("lang"))
    return found.filter(F.col("mixed") | wrong).select("doc_id", "lang")


QUERIES = {
    "p2_sample": p2_sample,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_knn": p4_knn,
    "p7_ids": p7_ids,
    "p7_token_counts": p7_token_counts,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
    "p9_documents": p9_documents,
}

SQL = {
    "p4_found": """
        WITH v AS (
            SELECT code, list_transform(emb, lambda x: x::DOUBLE) AS e FROM textemb
            WHERE len(emb) = 64 AND list_bool_and(list_transform(emb, lambda x: isfinite(x))) AND list_bool_or(list_transform(emb, lambda x: x <> 0)))
        SELECT a.code AS code_a, b.code AS code_b FROM v a JOIN v b ON a.code < b.code
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p2_sample": """
        WITH ordered AS (
            SELECT b::INT AS bucket, row_number() OVER (ORDER BY md5('order:' || b::VARCHAR)) AS place FROM range(4096) t(b)),
        seen AS (
            SELECT task, nodeidx, min(coalesce(batch_no, 2147483647)) AS first_batch,
                (concat('0x', substr(md5(task || '|' || nodeidx::VARCHAR), 1, 8))::BIGINT % 4096)::INT AS bucket
            FROM task_rows WHERE task IS NOT NULL AND nodeidx IS NOT NULL GROUP BY task, nodeidx),
        batches AS (SELECT DISTINCT first_batch AS b FROM seen),
        filled AS (
            SELECT batches.b, o.place, count(s.nodeidx) AS n FROM batches CROSS JOIN ordered o
            LEFT JOIN seen s ON s.bucket = o.bucket AND s.first_batch <= batches.b GROUP BY 1, 2),
        covered AS (SELECT b, place, sum(n) OVER (PARTITION BY b ORDER BY place) AS upto, sum(n) OVER (PARTITION BY b) AS total FROM filled),
        needed AS (SELECT b, min(place) AS need FROM covered WHERE upto >= ceil(0.1 * total) GROUP BY b),
        listed AS (SELECT o.bucket, min(n.b) AS listed FROM ordered o JOIN needed n ON o.place <= n.need GROUP BY o.bucket)
        SELECT s.task, s.nodeidx, s.bucket, nullif(greatest(l.listed, s.first_batch), 2147483647)::INT AS since_batch
        FROM seen s JOIN listed l ON l.bucket = s.bucket""",
}
