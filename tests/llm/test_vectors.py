"""Most similar vectors against brute force."""

import numpy as np
import pytest

from lattica.llm import queries
from lattica.llm import similar_vectors as S

D = 64


def frame(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "code bigint, emb array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, D))
    x = centers[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, D))
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + 0.2 * rng.normal(size=D)
    return x * rng.lognormal(size=(3000, 1))


def brute_pairs(x, least):
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= least, 1))
    return set(zip(a.tolist(), b.tolist()))


def test_pairs_equal_brute_force(spark, clustered):
    want = brute_pairs(clustered, 0.9)
    got = [tuple(r) for r in S.similar_pairs(frame(spark, clustered), "code", "emb", D, 0.9).collect()]
    assert len(want) >= 100 and len(got) == len(set(got))
    assert set(got) <= want and len(got) >= 0.99 * len(want)


def test_search_recall(spark, clustered):
    df = frame(spark, clustered)
    got = S.fit_index(df, "code", "emb", D).search(df, df.filter("code % 100 = 0"), 10, 32).collect()
    u = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        near = u @ u[q]
        near[q] = -2
        mine = sorted((r["rank"], r["id"], r["cosine"]) for r in got if r["query"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(c == pytest.approx(near[i], abs=1e-5) for _, i, c in mine)
        hits += len({i for _, i, _ in mine} & set(np.argsort(-near)[:10].tolist()))
    assert hits >= 0.95 * 300


def test_unusable_vectors_have_no_partner(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=D)
    odd = [v, v * 3, None, [], v[:50], np.zeros(D), np.where(np.arange(D) == 3, np.nan, v), np.where(np.arange(D) == 3, np.inf, v), [None, *v[1:]], v * 1e-30, -v]
    df = frame(spark, odd, range(10, 10 + len(odd)))
    got = {tuple(r) for r in S.similar_pairs(df, "code", "emb", D, 0.9).collect()}
    assert got == {(10, 11), (10, 19), (11, 19)}
    assert S.similar_pairs(df.filter("code between 12 and 18"), "code", "emb", D, 0.9).count() == 0
    assert S.similar_pairs(df.limit(0), "code", "emb", D, 0.9).count() == 0


def test_copies_are_expanded_in_the_end(spark):
    rng = np.random.default_rng(2)
    v, w = rng.normal(size=D), rng.normal(size=D)
    df = frame(spark, [v, v, v, v + 0.05 * w, w, w, None, None], [5, 3, 9, 4, 7, 8, 1, 2])
    assert {tuple(r) for r in S.copy_classes(df, "code", "emb").collect()} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7)}
    assert {tuple(r) for r in S.similar_pairs(df, "code", "emb", D, 0.9).collect()} == {(3, 5), (3, 9), (5, 9), (3, 4), (4, 5), (4, 9), (7, 8)}


def test_codes_lose_less_than_they_say(clustered):
    x = (clustered / np.linalg.norm(clustered, axis=1, keepdims=True)).astype(np.float32)
    rng = np.random.default_rng(3)
    c = S.kmeans(x, 32, rng, True)
    home = S._nearest(x, c, True)
    rest = (x - c[home]).reshape(len(x), 16, -1)
    model = S.Model(c, np.stack([S.kmeans(np.ascontiguousarray(rest[:, m]), 256, rng, False, 3) for m in range(16)]), np.ones(32, np.int32))
    codes, lost = model.encode(x, home)
    near = model.products(x[:50], home, codes)
    assert (np.abs(near - x @ x[:50].T) <= lost[:, None] / 250 + 1e-5).all()


def test_hot_list_in_parts(spark, clustered, monkeypatch):
    monkeypatch.setattr(S, "MAX_PART_ROWS", 20)
    got = {tuple(r) for r in S.similar_pairs(frame(spark, clustered), "code", "emb", D, 0.9).collect()}
    assert len(got) >= 0.99 * len(brute_pairs(clustered, 0.9))


def test_queries(spark, small):
    from compare import compare

    compare(spark, small, queries.p4_found, queries.SQL["p4_found"])
    assert queries.p4_knn(spark, small).count() > 0
