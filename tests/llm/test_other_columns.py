"""Columns beyond those that an operator reads may have any name, also those that it uses itself."""

from pyspark.sql import functions as F

from lattica.llm import language, mixture, nested_sample, overlap, similar_vectors, tokens


def clashing(df, *names):
    return df.withColumns({n: F.rand() for n in names})


def rows(df):
    return sorted(df.collect())


def test_sample(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(300)], "task string, nodeidx bigint, batch_no int")
    more = clashing(df, "bucket", "place", "listed", "__batch", "since_batch", "count")
    args = (["task", "nodeidx"], "batch_no", 0.3)
    assert rows(nested_sample.nested_sample(more, *args)) == rows(nested_sample.nested_sample(df, *args)) != []


def test_overlap(spark):
    text = "an old crate of copper lamps stored near the north pier since the storm closed the harbour last spring"
    df = spark.createDataFrame([(i, "x", i % 2, 1.0, None, text) for i in range(6)], "id bigint, task string, side int, label double, at timestamp_ntz, text string")
    pairs, members = overlap.near_copies(clashing(df, "class", "key", "class_a", "overlap", "block", "v"))
    assert pairs.count() == 1 and members.count() == 6


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float((i // 2 * j) % 7) - 2 for j in range(64)]) for i in range(2, 40)], "code bigint, emb array<float>")
    more = clashing(df, "a", "b", "id", "class", "member", "h1", "load", "list", "query", "cosine")
    assert rows(similar_vectors.similar_pairs(more, "code", "emb", 64, 0.9)) == rows(similar_vectors.similar_pairs(df, "code", "emb", 64, 0.9)) != []
    assert similar_vectors.fit_index(more, "code", "emb", 64).search(more, more, 3, 8).count() == 38 * 3


def test_tokens_and_languages(spark):
    df = spark.createDataFrame([(1, "The harbour office closed the gate because nobody paid.", "en")], "doc_id bigint, text string, lang string")
    assert len(tokens.encode_documents(clashing(df, "ids", "n_tokens"), "doc_id", "text").first()["ids"]) > 5
    more = clashing(df, "label", "segment", "start", "confidence", "letters", "share")
    found = language.document_languages(language.segments(more, "doc_id", "text", language.fit_languages(more, "doc_id", "text", "lang")), "doc_id")
    assert [(r["doc_id"], r["lang"]) for r in found.collect()] == [(1, "en")]


def test_mixture(spark):
    df = spark.createDataFrame([(i, "s", 10 + i % 5) for i in range(100)], "doc_id bigint, source string, n_tokens bigint")
    weights = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    args = dict(id_col="doc_id", total_tokens=600)
    more = mixture.mix(clashing(df, "rate", "copies", "bin", "tilt", "cap", "docs"), clashing(weights, "share", "repeats"), **args)[0]
    assert rows(more) == rows(mixture.mix(df, weights, **args)[0]) != []
