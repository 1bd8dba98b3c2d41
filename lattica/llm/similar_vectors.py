"""Most similar vectors for every vector: inverted lists, product-quantised residuals, exact reranking.

fit_index trains coarse centroids and codebooks on a bounded sample. Every usable vector is then filed in the list of
its nearest centroid, with its residual as product-quantised code. A query is held against the codes of the lists that
it probes through its table of inner products with all codewords (asymmetric distances), and what passes is ranked
again by its true cosine.

Each list is worked on by one task at a time. What travels to a list is bounded: for `pairs_above`, where every vector
is a query, a vector travels whole only to its own list, and its short code to the lists near it; for `search` with a
stated set of queries, the codes stay in their own list and the queries travel. Lists that hold very many vectors are
split into parts, by the sample's share of the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import broadcast_if_small, materialize

SEED = 17
#: The model is fitted on at most this many vectors; every vector is indexed.
SAMPLE_ROWS = 131_072
SAMPLE_PER_LIST = 48
MAX_LISTS = 8_192
CODEWORDS = 256
MAX_PART_ROWS = 50_000
QUERY, ENTRY = 0, 1


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the usable values: `dim` numbers, none NULL or not finite, not all zero."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets = np.asarray(lists.offsets)
    flat = lists.values
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    fits = np.flatnonzero((np.diff(offsets) == dim) & ~np.asarray(lists.is_null()))
    x = values[offsets[fits][:, None] + np.arange(dim)] if len(fits) else np.zeros((0, dim))
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good][:, None]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return fits[good], x.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray, by_product: bool) -> np.ndarray:
    half = 0 if by_product else (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 8192] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 8192)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, c, spherical)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = total / np.maximum(n, 1)[:, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


@dataclass
class Model:
    centroids: np.ndarray  # lists x dim
    codebooks: np.ndarray  # parts of a vector x codewords x numbers in a part
    split: np.ndarray  # parts of each list

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out, rounded up."""
        rest = (x - self.centroids[home]).reshape(len(x), len(self.codebooks), -1)
        codes = np.empty((len(x), len(self.codebooks)), np.uint8)
        for m, book in enumerate(self.codebooks):
            codes[:, m] = _nearest(rest[:, m], book, False) if len(x) else 0
            rest[:, m] -= book[codes[:, m]]
        lost = np.sqrt((rest**2).sum(axis=(1, 2)))
        return codes, np.minimum(np.ceil(lost * 250 + 1), 255).astype(np.uint8)

    def products(self, queries: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines, entries x queries, by each query's table of products with all codewords."""
        lists, place = np.unique(home, return_inverse=True)
        out = (self.centroids[lists] @ queries.T)[place]
        parts = queries.reshape(len(queries), len(self.codebooks), -1)
        for m, book in enumerate(self.codebooks):
            out += (book @ parts[:, m].T)[codes[:, m]]
        return out


class IvfPq:
    def __init__(self, shared: Broadcast, dim: int, id_col: str, vec_col: str):
        self.shared, self.dim, self.id_col, self.vec_col = shared, dim, id_col, vec_col

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).cast("bigint").alias("id"), F.col(self.vec_col).cast("array<float>").alias("emb"))

    def _file(self, df: DataFrame, queries_probe: int, entries_probe: int) -> DataFrame:
        """Rows for the lists: (list, part, kind, id, home, load); a probe of 0 leaves out that kind."""
        shared, dim = self.shared, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: Model = shared.value
            for batch in batches:
                at, x = unit_rows(batch.column(1), dim)
                if not len(at):
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
                near = x @ model.centroids.T
                most = min(max(queries_probe, entries_probe), near.shape[1])
                probes = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.tile(np.arange(most), (len(x), 1))
                probes = np.take_along_axis(probes, np.argsort(-np.take_along_axis(near, probes, 1), axis=1, kind="stable"), 1)
                home = probes[:, 0]
                if entries_probe:
                    p = probes[:, :entries_probe]
                    codes, lost = model.encode(x, home)
                    row = np.repeat(np.arange(len(x)), p.shape[1])
                    lists = p.reshape(-1)
                    yield _filed(lists, ids[row] % model.split[lists], ENTRY, ids[row], home[row], np.hstack([codes, lost[:, None]])[row])
                if queries_probe:
                    p = probes[:, :queries_probe]
                    lists = p.reshape(-1)
                    times = model.split[lists]
                    row = np.repeat(np.repeat(np.arange(len(x)), p.shape[1]), times)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    lists = np.repeat(lists, times)
                    yield _filed(lists, part, QUERY, ids[row], home[row], x[row].view(np.uint8).reshape(len(row), -1))

        return self._rows(df).mapInArrow(run, "list int, part int, kind tinyint, id bigint, home int, load binary")

    def _matched(self, filed: DataFrame, least: float | None, top: int) -> DataFrame:
        """(query, load, id, near): the entries that may reach `least`, or the `top` entries of each query and list."""
        shared, dim = self.shared, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: Model = shared.value
            for ids, x, entries, home, load in _lists(batches, dim):
                for i in range(0, len(entries), 16_384):
                    e, h, c = entries[i : i + 16_384], home[i : i + 16_384], load[i : i + 16_384]
                    for j in range(0, len(ids), 512):
                        q, v = ids[j : j + 512], x[j : j + 512]
                        near = model.products(v, h, c[:, :-1])
                        if least is not None:
                            a, b = np.nonzero(near + (c[:, -1] / 250.0)[:, None] >= least)
                        elif len(e) <= top:
                            a, b = np.divmod(np.arange(near.size), len(q))
                        else:
                            a = np.argpartition(-near, top - 1, axis=0)[:top].reshape(-1)
                            b = np.tile(np.arange(len(q)), top)
                        other = e[a] != q[b]
                        a, b = a[other], b[other]
                        if len(a):
                            raw = np.ascontiguousarray(v[b]).view(np.uint8).reshape(len(b), -1)
                            yield pa.RecordBatch.from_arrays([pa.array(q[b]), _binary(raw), pa.array(e[a]), pa.array(near[a, b])], names=["query", "load", "id", "near"])

        sorted_lists = filed.repartition("list", "part").sortWithinPartitions("list", "part", "kind")
        return sorted_lists.mapInArrow(run, "query bigint, load binary, id bigint, near float")

    def _reranked(self, found: DataFrame, df: DataFrame) -> DataFrame:
        """(query, id, cosine): the true cosine of each candidate."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = unit_rows(batch.column(3), dim)
                q = _loads(batch.column(1), dim * 4).view(np.float32)[at].astype(np.float64)
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
                cosine = (q * x).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(cosine)], names=["query", "id", "cosine"])

        joined = found.select("query", "load", "id").join(self._rows(df), "id").select("query", "load", "id", "emb")
        return joined.mapInArrow(run, "query bigint, id bigint, cosine double")

    def pairs_above(self, df: DataFrame, least: float, probes: int = 6) -> DataFrame:
        """(a, b, cosine), a < b: all pairs with a cosine of at least `least` that share a probed list.

        A code is passed on whenever its product plus the length that it leaves out reaches `least`, so the codes lose
        no pair; only pairs of which neither lies in the lists probed by the other are missed.
        """
        found = self._matched(self._file(df, 1, probes), least - 1e-6, 0)
        once = found.withColumns({"a": F.least("query", "id"), "b": F.greatest("query", "id")}).dropDuplicates(["a", "b"])
        exact = self._reranked(once, df).filter(F.col("cosine") >= least - 1e-7)
        return exact.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "cosine").dropDuplicates(["a", "b"])

    def search(self, df: DataFrame, queries: DataFrame, k: int, probes: int, rerank: int = 8) -> DataFrame:
        """(query, rank, id, cosine): the k most similar vectors of df for each query; ties by the smaller id."""
        filed = self._file(queries, probes, 0).unionByName(self._file(df, 0, 1))
        near = self._matched(filed, None, k * rerank)
        first = Window.partitionBy("query").orderBy(F.desc("near"), "id")
        kept = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k * rerank)
        exact = self._reranked(kept, df).dropDuplicates(["query", "id"])
        best = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
        return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "id", "cosine")


def _filed(lists: np.ndarray, part: np.ndarray, kind: int, ids: np.ndarray, home: np.ndarray, load: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(lists.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(lists), kind, np.int8)), pa.array(ids), pa.array(home.astype(np.int32)), _binary(load)],
        names=["list", "part", "kind", "id", "home", "load"],
    )


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _loads(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw.reshape(len(column), width)


def _lists(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    """From rows sorted by list, part and kind: each list's query ids and vectors, entry ids, homes and codes."""
    current, queries, entries = None, [], []

    def whole():
        if queries and entries:
            yield (
                np.concatenate([q[0] for q in queries]),
                np.concatenate([q[1] for q in queries]),
                *(np.concatenate([e[i] for e in entries]) for i in range(3)),
            )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lists, parts, kinds, ids, homes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.flatnonzero((lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), n]):
            key = (lists[i], parts[i])
            if key != current:
                yield from whole()
                current, queries, entries = key, [], []
            load = batch.column(5).slice(i, j - i)
            if kinds[i] == QUERY:
                queries.append((ids[i:j], _loads(load, dim * 4).view(np.float32)))
            elif queries:
                width = len(load[0].as_py())
                entries.append((ids[i:j], homes[i:j], _loads(load, width)))
    yield from whole()


def fit_index(df: DataFrame, id_col: str, vec_col: str, dim: int, code_bytes: int = 32, sample_rows: int = SAMPLE_ROWS) -> IvfPq:
    """Trains centroids and codebooks on a sample of at most sample_rows vectors, drawn by the hash of the id.

    About two lists per square root of the number of rows, at most MAX_LISTS. With fewer usable vectors than
    that there are as many lists as vectors; a table without any gives one list that stays empty.
    """
    spark = df.sparkSession
    n = df.count()
    wanted = int(min(MAX_LISTS, max(16, 2 ** round(np.log2(2 * np.sqrt(max(n, 1)))))))
    size = min(sample_rows, wanted * SAMPLE_PER_LIST)
    part = min(1.0, 1.1 * size / max(n, 1))
    rows = df.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(part * (1 << 20)) + 1) if part < 1 else df
    taken = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("emb")).limit(2 * size).toArrow().combine_chunks()
    rng = np.random.default_rng(SEED)
    x = np.zeros((0, dim), np.float32)
    if taken.num_rows:
        taken = taken.sort_by("id").combine_chunks()
        emb = taken.column("emb")
        x = unit_rows(emb.chunk(0) if isinstance(emb, pa.ChunkedArray) else emb, dim)[1]
    if not len(x):
        x = np.eye(1, dim, dtype=np.float32)
    x = x[:size]
    centroids = kmeans(x, wanted, rng, True)
    home = _nearest(x, centroids, True)
    rest = (x - centroids[home]).reshape(len(x), code_bytes, -1)
    fit = rest[rng.choice(len(x), min(len(x), 16_384), replace=False)]
    books = np.stack([_padded(kmeans(np.ascontiguousarray(fit[:, m]), CODEWORDS, rng, False, 6)) for m in range(code_bytes)])
    share = np.bincount(home, minlength=len(centroids)) / len(x)
    split = np.maximum(1, np.ceil(share * n / MAX_PART_ROWS)).astype(np.int32)
    return IvfPq(spark.sparkContext.broadcast(Model(centroids, books, split)), dim, id_col, vec_col)


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], CODEWORDS - len(book), axis=0)])


def copy_classes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, class) of all rows whose vector occurs under several ids; the class is the smallest of these ids."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(7), vec_col).alias("h2"))
    several = rows.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.max("id").alias("last")).filter(F.col("last") > F.col("class"))
    return rows.join(several, ["h1", "h2"]).select("id", "class").distinct()


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int, least: float, probes: int = 6) -> DataFrame:
    """(a, b), a < b: the pairs of vectors with a cosine of at least `least` > 0.

    Copies of the same vector are searched once, under the smallest of their ids, and expanded in the end. Vectors
    that are NULL, not of `dim` numbers, not finite or all zero have no partner; a NULL id names no vector.
    """
    copies = materialize(copy_classes(df, id_col, vec_col), "vector-copies")
    rest = broadcast_if_small(copies.filter(F.col("id") != F.col("class")).select(F.col("id").alias(id_col)), 1_000_000)
    single = df.join(rest, id_col, "left_anti")
    index = fit_index(single, id_col, vec_col, dim)
    pairs = index.pairs_above(single, least, probes).select("a", "b")
    for side in "ab":
        of = copies.select(F.col("id").alias("member"), F.col("class").alias(side))
        pairs = pairs.join(of, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    usable = copies.join(_usable(df, id_col, vec_col, dim), "id", "left_semi")
    x, y = usable.alias("x"), usable.alias("y")
    same = x.join(y, (F.col("x.class") == F.col("y.class")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return pairs.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.filter((F.size(v) == dim) & finite & F.exists(v, lambda e: e != 0)).select(F.col(id_col).cast("bigint").alias("id"))
