"""Languages on held-out labels and stated cases."""

import pytest
from pyspark.sql import functions as F

from lattica.llm import language as L
from lattica.llm import queries

TEXTS = {
    "en": ["The harbour office closed the gate because nobody paid the dues.", "We should ask the owners which key they trust."],
    "de": ["Das Hafenamt schloss das Tor, weil niemand die Gebühren bezahlt hat.", "Wir sollten die Besitzer fragen, welchem Schlüssel sie vertrauen."],
    "fr": ["Le bureau du port a fermé la porte parce que personne n'a payé les droits.", "Nous devrions demander aux propriétaires quelle clé est la bonne."],
    "zh": ["港口办公室关上了大门，因为没有人付费。", "我们应该问问负责人，他们相信哪一个键。"],
    "ru": ["Портовая контора закрыла ворота, потому что никто не заплатил.", "Нам следует спросить владельцев, какому ключу они доверяют."],
}


@pytest.fixture(scope="module")
def model(spark):
    return L.fit_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", "lang")


def languages(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = L.document_languages(L.segments(df, "doc_id", "text", model), "doc_id").collect()
    return {(r["doc_id"], r["lang"]): r for r in rows}


def test_labels(spark):
    cases = {"EN": "en", "en-GB": "en", "en_US": "en", " eng ": "en", "Deutsch": "de", "français": "fr", "中文": "zh", "zh-Hans-CN": "zh", "русский": "ru", "und": None, "??": None, "": None, None: None, "xx": None, "n/a": None, "unknown": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string").withColumn("k", L.label_language(F.col("l")))
    assert {r["l"]: r["k"] for r in df.collect()} == cases


def test_known_sentences(spark, model):
    texts = [" ".join(v) for v in TEXTS.values()]
    got = languages(spark, model, texts + [t.upper() for t in texts] + [L.plain(t) for t in texts])
    for i in range(3 * len(texts)):
        assert [k for (d, k) in got if d == i] == [list(TEXTS)[i % len(texts)]]
    assert all(0.5 < r["confidence"] <= 1 and not r["mixed"] for r in got.values())


def test_mixed_documents(spark, model):
    mixed = " ".join(TEXTS["en"]) + "\n\n" + " ".join(TEXTS["de"])
    one = " ".join(TEXTS["en"] * 3) + " " + TEXTS["de"][0]
    got = languages(spark, model, [mixed, one])
    assert got[0, "en"]["mixed"] and got[0, "de"]["mixed"]
    assert got[1, "en"]["main"] and not got[1, "en"]["mixed"]
    df = spark.createDataFrame([(0, mixed)], "doc_id bigint, text string")
    parts = sorted((r["start"], r["length"], r["lang"]) for r in L.segments(df, "doc_id", "text", model).collect())
    assert [p[2] for p in parts] == ["en", "de"] and mixed[parts[1][0] :].startswith("Das Hafenamt")
    assert parts[0][0] == 0 and mixed[: parts[0][1]].endswith("trust.")


def test_what_has_no_language(spark, model):
    texts = [None, "", " \n\t", "=== c9_N64 ===\ntest_metric/harbor-Call-delay/rmse: 0.31", "7affe750 320ad74b", "a_514\t0.40\t62", "Schadenfreude", "harbor-Call___lot_id (text)", "12 34 56.7", "." * 10_000]
    assert languages(spark, model, texts) == {}


def test_damaged_texts(spark, model):
    german = " ".join(TEXTS["de"])
    broken = german.encode().decode("cp1252")
    html = "<p>" + german.replace("ü", "&uuml;") + "</p>"
    assert {k for k in languages(spark, model, [broken, html, german.replace(" ", "  ")])} == {(0, "de"), (1, "de"), (2, "de")}


def test_held_out_labels(spark, model):
    """Trained at one scale, scored on the documents of another, whose labels are right for nearly all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("label", L.label_language(F.col("lang"))).filter("label is not null")
    found = L.document_languages(L.segments(docs.select("doc_id", "text"), "doc_id", "text", model), "doc_id")
    rows = found.join(docs.select("doc_id", "label"), "doc_id")
    clean = rows.filter("main").join(rows.filter("mixed").select("doc_id").distinct(), "doc_id", "left_anti")
    n, right = clean.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("label"))).first()
    assert n > 5000 and right / n > 0.9


def test_long_text_and_no_labels(spark, model):
    long = (" ".join(TEXTS["fr"]) + " ") * 2000
    got = languages(spark, model, [long])
    assert got[0, "fr"]["sentences"] == 4000
    none = spark.createDataFrame([(1, "No labels here at all.", None)], "doc_id bigint, text string, lang string")
    blank = L.fit_languages(none, "doc_id", "text", "lang")
    assert L.segments(none, "doc_id", "text", blank).count() == 1


def test_query(spark, small):
    rows = [tuple(r) for r in queries.p9_found(spark, small).collect()]
    assert rows and len(rows) == len(set(rows)) and {k for _, k in rows} <= set(L.LANGUAGES)


def test_paths_are_the_best_and_linear():
    """Against all paths by the plain recursion; and 200,000 sentences of one document in seconds."""
    import time

    import numpy as np

    rng = np.random.default_rng(3)
    scores = rng.normal(0, 3, (400, len(L.LANGUAGES)))
    first = np.array([0, 1, 5, 6, 90, 390])
    want = []
    for a, b in zip(first, [*first[1:], 400]):
        best, back = scores[a], []
        for s in scores[a + 1 : b]:
            moved = best[:, None] - L.SWITCH * (1 - np.eye(len(best)))
            back.append(moved.argmax(axis=0))
            best = s + moved.max(axis=0)
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        want += path[::-1]
    assert L.best_paths(scores, first).tolist() == want
    start = time.process_time()
    assert len(L.best_paths(rng.normal(0, 3, (200_000, len(L.LANGUAGES))), np.array([0]))) == 200_000
    assert time.process_time() - start < 20


def test_document_of_200_000_sentences(spark, model):
    line = TEXTS["en"][0] + " " + TEXTS["en"][1] + "\n"
    text = line * 99_000 + (" ".join(TEXTS["de"]) + "\n") * 1_000
    got = languages(spark, model, [text])
    assert got[0, "en"]["sentences"] == 198_000 and got[0, "de"]["sentences"] == 2_000 and got[0, "en"]["mixed"]
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    parts = sorted((r["start"], r["lang"]) for r in L.segments(df, "doc_id", "text", model).collect())
    assert [k for _, k in parts] == ["en", "de"] and text[parts[1][0] :].startswith("Das Hafenamt")


def test_places_of_sentences():
    texts = ['He said: "We wait here for the boats." Then they left the old harbour.', "", "First line of words here\r\n  second line of words there", "我们等船。港口今天关门了！"]
    found = L.find_sentences(texts)
    got = [(d, texts[d][a:b]) for d, a, b in zip(found.doc.tolist(), found.start.tolist(), found.end.tolist())]
    assert got == [
        (0, 'He said: "We wait here for the boats.'),
        (0, "Then they left the old harbour."),
        (2, "First line of words here"),
        (2, "second line of words there"),
        (3, "港口今天关门了！"),
    ]


def test_main_language_beside_a_mixture(spark):
    """A document whose longest language has one sure sentence only is one of the others, not of that one as well."""
    part = lambda lang, letters, sure: (1, lang, 0.99, letters, 3, sure)
    found = spark.createDataFrame([part("en", 900, 1), part("de", 300, 2), part("fr", 200, 2)], "doc_id bigint, lang string, confidence double, letters bigint, sentences int, sure int")
    rows = {r["lang"]: r for r in L.document_languages(found, "doc_id").collect()}
    assert rows["en"]["main"] and not rows["en"]["mixed"] and all(r["several"] for r in rows.values())
    assert rows["de"]["mixed"] and rows["fr"]["mixed"] and abs(sum(r["share"] for r in rows.values()) - 1) < 1e-9
