"""Vector search: exact, 8-bit with rescoring, sign bits, inverted lists and product codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from ..storage import new_path
from .sparse import ranked

#: Query vectors that go to the executors at once: bounds the broadcast whatever the query set's size.
QUERY_BATCH = 4096
#: Vectors that are scored at once against a batch.
BLOCK_ROWS = 2048
#: Vectors that fit centroids and codes, about.
SAMPLE = 20_000


def assert_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The rows themselves; reading one of another dimension fails."""
    fits = F.col(column).isNull() | (F.size(column) == dim)
    return vectors.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), F.size(column).cast("string"))).cast("boolean")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    return _unit_rows(_matrix(column))


class Best:
    """The `keep` best of all rows shown so far, for each query: by falling whole-number score, ties to the smaller id."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.low = keep, np.iinfo(np.int64).min
        self.score = np.full((queries, 0), self.low, np.int64)
        self.ids = np.zeros((queries, 0), np.int64)
        self.more = np.zeros((queries, 0))

    def add(self, scores: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """scores: queries x rows, below 2 ** 42; more: what goes along with each; which: the queries that the scores are of."""
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        n = min(self.keep, len(ids))
        key = scores.astype(np.int64) * (1 << 20) + np.arange(len(ids))[::-1]
        at = np.argpartition(-key, n - 1, axis=1)[:, :n]
        found = [np.take_along_axis(scores, at, 1).astype(np.int64), ids[at], np.take_along_axis(more[:, order], at, 1) if more is not None else np.zeros(at.shape)]
        if which is not None:  # the others get rows that lose against any
            whole = [np.full((len(self.ids), n), self.low, np.int64), np.zeros((len(self.ids), n), np.int64), np.zeros((len(self.ids), n))]
            for w, f in zip(whole, found, strict=True):
                w[which] = f
            found = whole
        score, ids, more = (np.concatenate(x, axis=1) for x in zip((self.score, self.ids, self.more), found, strict=True))
        at = np.lexsort((ids, -(score + 1)))[:, : self.keep]  # the least number has no opposite
        self.score, self.ids, self.more = (np.take_along_axis(x, at, 1) for x in (score, ids, more))

    def batch(self, names: list) -> pa.RecordBatch:
        real = self.score > self.low
        q = np.repeat(np.arange(len(names)), real.sum(axis=1))
        columns = [pa.array([names[i] for i in q], pa.int64()), pa.array(self.ids[real]), pa.array(self.score[real]), pa.array(self.more[real])]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "near", "more"])


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores to 6 places, in millionths."""
    return np.rint(scores * 1e6).astype(np.int64)


def scanned(rows: DataFrame, queries: DataFrame, keep: int, prepare: Callable, score: Callable) -> DataFrame:
    """query_id, doc_id, near and more: from each task the `keep` best of its rows for each query.

    rows has doc_id, embedding and whatever else `score` reads; queries has query_id and
    embedding.  prepare(vectors) makes of a batch of query vectors what is broadcast;
    score(best, prepared, batch) adds an Arrow batch to a Best.  One batch of queries is
    a lazy plan; more are cut by a hash of the identifier, go out one after another, and
    leave their rows in the shared folder, so that driver and executors hold one batch.
    """
    spark = rows.sparkSession
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))

    def scan(part: DataFrame):
        got = part.collect()
        shared = spark.sparkContext.broadcast(([r.query_id for r in got], prepare(np.array([r.embedding for r in got], np.float64)) if got else None))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, prepared = shared.value
            best = Best(len(names), keep)
            for batch in batches:
                for start in range(0, len(batch) if names else 0, BLOCK_ROWS):
                    score(best, prepared, batch.slice(start, BLOCK_ROWS))
            yield best.batch(names)

        return rows.mapInArrow(search, "query_id long, doc_id long, near long, more double"), shared

    n = asked.count()
    if n <= QUERY_BATCH:
        return scan(asked)[0]
    path, parts = new_path(spark, "scanned"), -(-2 * n // QUERY_BATCH)  # about half a batch each, so that none is much larger
    for k in range(parts):
        found, shared = scan(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k))
        found.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema("query_id long, doc_id long, near long, more double").parquet(path)


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull()).select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>"))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k_dense, keep: Column | None = None) -> DataFrame:
    """query_id, doc_id, score (cosine, 6 places) and rank: exact, by block products.

    vectors has doc_id and embedding (rows without one are left out); queries has
    query_id and embedding.  The shuffle has k rows for each query and task.
    """

    def score(best: Best, q: np.ndarray, batch: pa.RecordBatch) -> None:
        best.add(_whole(q @ _unit(batch.column(1)).T), batch.column(0).to_numpy())

    found = scanned(_rows(vectors if keep is None else vectors.where(keep)), queries, k, _unit_rows, score)
    return ranked(found.select("query_id", "doc_id", (F.col("near") / 1e6).alias("score")), k)


def int8_topk(vectors: DataFrame, queries: DataFrame, k: int, s: Settings = DEFAULTS) -> DataFrame:
    """8-bit products choose oversampling * k candidates; exact cosines rank them.  Vectors come with length 1."""
    pool = int(k * s.oversampling)
    codes = lambda x: np.trunc(x * 127.0 + np.copysign(0.5, x))  # noqa: E731  halves away from zero

    def score(best: Best, q: np.ndarray, batch: pa.RecordBatch) -> None:
        x = _matrix(batch.column(1))
        best.add((codes(q) @ codes(x).T).astype(np.int64), batch.column(0).to_numpy(), _unit_rows(q) @ _unit_rows(x).T)

    found = ranked(scanned(_rows(vectors), queries, pool, lambda q: q, score), pool, score="near").drop("rank")
    return ranked(found.select("query_id", "doc_id", F.round("more", 6).alias("score")), k)


def hamming_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, distance and rank by differing signs of all components."""

    def score(best: Best, q: np.ndarray, batch: pa.RecordBatch) -> None:
        signs = np.where(_matrix(batch.column(1)) > 0, 1.0, -1.0)
        best.add(((q @ signs.T - q.shape[1]) / 2).astype(np.int64), batch.column(0).to_numpy())

    found = ranked(scanned(_rows(vectors), queries, k, lambda q: np.where(q > 0, 1.0, -1.0), score), k, score="near")
    return found.select("query_id", "doc_id", (-F.col("near")).alias("distance"), "rank")


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """About `sample` vectors, chosen by a hash of the identifier: rows are filtered where they lie, none are sorted."""
    rows = _rows(vectors)
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = sample / max(rows.count(), 1)
    got = (rows if share >= 1 else rows.where(chance < share)).collect() or rows.limit(1).collect()
    return np.array([r.embedding for r in sorted(got, key=lambda r: (r.doc_id, r.embedding))], np.float64)


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of a bounded sample."""
    x = sampled(vectors, sample)
    c = x[np.random.default_rng(seed).choice(len(x), cells, len(x) < cells)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def with_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """doc_id, embedding and cell: the inverted lists of an index; write it partitioned by cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_unit(batch.column(1)) @ shared.value.T).argmax(axis=1) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype("i4"))], ["doc_id", "embedding", "cell"])

    return _rows(vectors).mapInArrow(place, "doc_id long, embedding array<double>, cell int")


def ivf_topk(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, nprobe: int, keep: Column | None = None) -> DataFrame:
    """The k best of the nprobe cells nearest to each query; nprobe trades recall for work without a new index.

    A filter (of columns that the index carries) holds before ranking.  Of an index that
    is stored by cell, cells that no query probes are not read.
    """

    def prepare(q: np.ndarray):
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :nprobe]
        return _unit_rows(q), {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

    def score(best: Best, prepared, batch: pa.RecordBatch) -> None:
        (q, asking), ids, cells = prepared, batch.column(0).to_numpy(), batch.column(2).to_numpy()
        x = _unit(batch.column(1))
        for c in np.unique(cells):
            if (which := asking.get(int(c))) is not None:
                at = np.flatnonzero(cells == c)
                best.add(_whole(q[which] @ x[at].T), ids[at], which=which)

    rows = (index if keep is None else index.where(keep)).select("doc_id", "embedding", "cell")
    return ranked(scanned(rows, queries, k, prepare, score).select("query_id", "doc_id", (F.col("near") / 1e6).alias("score")), k)


def pq_topk(vectors: DataFrame, queries: DataFrame, k: int, parts: int = 16, centres: int = 16, oversampling: int = 8, sample: int = SAMPLE) -> DataFrame:
    """Product codes choose oversampling * k candidates by table sums; exact cosines rank them."""
    x = sampled(vectors, sample)
    width, books = x.shape[1] // parts, []
    for j in range(parts):
        sub = x[:, j * width : (j + 1) * width]
        c = sub[np.random.default_rng(j).choice(len(sub), centres, len(sub) < centres)]
        for _ in range(8):
            near = ((sub[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([sub[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(centres)])
        books.append(c)
    book, pool = np.stack(books), oversampling * k

    def prepare(q: np.ndarray):
        unit = _unit_rows(q)
        return unit, np.einsum("qjw,jcw->qjc", unit[:, : parts * width].reshape(len(q), parts, width), book), book

    def score(best: Best, prepared, batch: pa.RecordBatch) -> None:
        (q, table, own), x = prepared, _unit(batch.column(1))
        codes = np.stack([((x[:, None, j * width : (j + 1) * width] - own[j][None]) ** 2).sum(axis=2).argmin(axis=1) for j in range(parts)])
        best.add(_whole(sum(table[:, j][:, codes[j]] for j in range(parts))), batch.column(0).to_numpy(), q @ x.T)

    found = ranked(scanned(_rows(vectors), queries, pool, prepare, score), pool, score="near").drop("rank")
    return ranked(found.select("query_id", "doc_id", F.round("more", 6).alias("score")), k)
