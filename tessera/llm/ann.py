"""Operator 3: nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are brought to length 1, so that the largest cosine is the largest inner
product.  Pairs of components are quantised to 16 centres each (4 bits).  Codes and
centres minimise a loss that weighs the part of the residual parallel to the vector more
than the rest, since only the parallel part shifts the large inner products.  A search
looks scores up in a table for each query and ranks the RERANK best distinct vectors of
each block by the exact cosine of the original vectors in double precision, then all others
whose looked-up score doesn't prove their cosine below the k-th best of these.  So codes
only save work: the result is that of a search through all vectors.

The proof: let a unit vector x have the code's vector y, a = (x - y)x, and r the length of
x - y without its part along x.  For a unit query with cosine s to x the looked-up score
lies within r sqrt(1 - s^2) of s (1 - a).

The codebook is fitted on a bounded sample of about SAMPLE vectors, chosen by a hash of
the identifier; every vector is indexed and scanned.  On vectors without clusters, such
as those of the test tables, a partition tree would have to probe half of all leaves, so
there is none: queries meet all rows in tiles of QUERY_ROWS by BLOCK_ROWS.  The index
stays where it lies; queries go to it by broadcast, QUERY_ROWS or so at a time, and each
task keeps the k best rows for each query, so only these are shuffled.

Cases: vectors that are null or zero, hold null or non-finite components, or differ in
length from the most common length (of equally common ones the shortest) take no part,
nor do rows without an identifier; vectors are scaled by a power of two before squares
are taken, which changes no cosine and lets none overflow; equal scores go to the smaller vec_id; a candidate
with the query's vec_id is the query's own row; rows that share a vec_id count once for
each query, with their largest score, and ask once, with their smallest vector; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, new_path, written

SAMPLE = 10_000
CENTRES = 16
#: Scores below this share of a vector's length don't count in the loss.
THRESHOLD = 0.2
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048
#: Distinct vectors of a block that are ranked exactly for each query before the bound is known.
RERANK = 96
NEAREST = 5


@dataclass
class Codebook:
    centres: np.ndarray  # pairs of components x 16 x 2
    weight: float  # of the parallel part of the residual, over that of the rest


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component below 1: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def paired(x: np.ndarray) -> np.ndarray:
    """Unit vectors as rows x pairs x 2; an odd last component is paired with 0.  The rows have been scaled()."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if x.shape[1] % 2:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x.reshape(len(x), -1, 2)


def assign(book: Codebook, x: np.ndarray, codes: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
    """Codes (rows x pairs) of paired vectors by coordinate descent on the anisotropic loss."""
    pairs = x.shape[1]
    plain = lambda j: ((x[:, j, None, :] - book.centres[j][None]) ** 2).sum(axis=2)
    if codes is None:
        codes = np.stack([plain(j).argmin(axis=1) for j in range(pairs)], axis=1)
    along = np.stack([((x[:, j] - book.centres[j][codes[:, j]]) * x[:, j]).sum(axis=1) for j in range(pairs)], axis=1)
    total = along.sum(axis=1)
    for _ in range(rounds):
        changed = 0
        for j in range(pairs):
            own = (x[:, j] ** 2).sum(axis=1)[:, None] - x[:, j] @ book.centres[j].T  # parallel part of each choice
            loss = plain(j) + (book.weight - 1) * ((total - along[:, j])[:, None] + own) ** 2
            best = loss.argmin(axis=1)
            changed += int((best != codes[:, j]).sum())
            new = np.take_along_axis(own, best[:, None], 1)[:, 0]
            total, along[:, j], codes[:, j] = total - along[:, j] + new, new, best
        if not changed:
            break
    return codes


def fit(sample: np.ndarray, rounds: int = 4, seed: int = 3) -> Codebook:
    """Fit centres to a sample of vectors: means of each pair first, then codes and centres in turn on the anisotropic loss."""
    x, dim = paired(sample), max(sample.shape[1], 2)
    rng, pairs = np.random.default_rng(seed), paired(sample[:1]).shape[1]
    weight = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    centres = np.stack([x[rng.choice(len(x), CENTRES, len(x) < CENTRES), j] for j in range(pairs)])
    for j in range(pairs):
        for _ in range(8):
            at = ((x[:, j, None, :] - centres[j][None]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(at, minlength=CENTRES)
            for c in range(2):
                mean = np.bincount(at, x[:, j, c], CENTRES) / np.maximum(n, 1)
                centres[j, :, c] = np.where(n > 0, mean, centres[j, :, c])
    book, codes = Codebook(centres, weight), None
    for _ in range(rounds):
        codes = assign(book, x, codes, 2)
        chosen = np.zeros((len(x), pairs, CENTRES, 2), np.float32)  # each vector at its codes' places
        chosen[np.arange(len(x))[:, None], np.arange(pairs), codes] = x
        z = chosen.reshape(len(x), -1)
        n = np.stack([np.bincount(codes[:, j], minlength=CENTRES) for j in range(pairs)])
        size = np.repeat(n.ravel(), 2).astype(float)
        left = (weight - 1) * (z.T @ z).astype(float) + np.diag(size + 1e-3)
        solved = np.linalg.solve(left, weight * z.sum(axis=0, dtype=float) + 1e-3 * book.centres.ravel())
        book = Codebook(np.where(size > 0, solved, book.centres.ravel()).reshape(pairs, CENTRES, 2), weight)
    return book


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(book: Codebook, queries: np.ndarray) -> np.ndarray:
    """For each query and byte of a code, the part of the inner product for each of the byte's 256 values."""
    x = paired(queries)
    part = np.einsum("qjc,jkc->qjk", x, book.centres)
    if part.shape[1] % 2:
        part = np.pad(part, ((0, 0), (0, 1), (0, 0)))
    return (part[:, 1::2, :, None] + part[:, ::2, None, :]).reshape(len(x), -1, 256).astype(np.float32)


def residuals(book: Codebook, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For paired vectors and their packed codes: the residual's part along the vector, and the length of the rest."""
    pairs = x.shape[1]
    at = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, :pairs]
    left = x - book.centres[np.arange(pairs), at]
    along = (left * x).sum(axis=(1, 2))
    rest = left - along[:, None, None] * x
    return along, np.sqrt((rest**2).sum(axis=(1, 2)))


def least_scores(along: np.ndarray, across: np.ndarray, cosine: float) -> np.ndarray:
    """The least looked-up score that a vector with the given residual can have if its cosine is `cosine` or more."""
    scale = np.maximum(np.hypot(1 - along, across), 1e-300)
    s = np.clip(np.maximum(cosine, -(1 - along) / scale), -1, 1)  # the least value of s (1 - along) - across sqrt(1 - s^2), or the first s that counts
    return s * (1 - along) - across * np.sqrt(1 - s**2)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def k_best(query_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, each identifier once, ties to the smaller vec_id."""
    order = np.lexsort((-score, ids, query_ids))
    query_ids, ids, score = query_ids[order], ids[order], score[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (query_ids[1:] != query_ids[:-1])
    query_ids, ids, score = query_ids[first], ids[first], score[first]
    order = np.lexsort((ids, -score, query_ids))
    query_ids, ids, score = query_ids[order], ids[order], score[order]
    within = np.arange(len(ids)) - np.searchsorted(query_ids, query_ids) < k
    return query_ids[within], ids[within], score[within]


def search_tile(book: Codebook, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
    """The k nearest rows of a block for each query: query_id, vec_id and exact score, ties to the smaller vec_id.

    Equal vectors are scanned once; of their rows the k + 1 smallest distinct identifiers
    are enough, as one may be the query's own.  All vectors have been scaled().
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes = ids[order], vectors[order], codes[order]
    _, first, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8)))[:, 0], return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")  # by identifier within a group
    again = np.zeros(len(ids), bool)
    again[1:] = (group[by_group[1:]] == group[by_group[:-1]]) & (ids[by_group[1:]] == ids[by_group[:-1]])
    by_group = by_group[~again]
    place = np.arange(len(by_group)) - np.searchsorted(group[by_group], group[by_group])
    by_group = by_group[place <= k]
    start, end = np.searchsorted(group[by_group], np.arange(len(first))), np.searchsorted(group[by_group], np.arange(len(first)), "right")
    column = np.ascontiguousarray(codes[first].T)
    length, q_length = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    along, across = residuals(book, paired(vectors[first]), codes[first])

    def first_of_each(rows: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of different identifiers."""
        order = np.lexsort((ids[rows], -exact))
        order = order[np.sort(np.unique(ids[rows[order]], return_index=True)[1])][:k]
        return rows[order], exact[order]

    def ranked(groups: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows, but the query's own, of distinct vectors by their exact cosines to query i."""
        n = end[groups] - start[groups]
        rows = by_group[np.repeat(start[groups] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        rows = rows[ids[rows] != query_ids[i]]
        return first_of_each(rows, (vectors[rows] * queries[i]).sum(axis=1) / (length[rows] * q_length[i]))

    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(queries), 256):
        table = tables(book, queries[lo : lo + 256])
        for i, own in enumerate(table, lo):
            score = own[0][column[0]]
            for b in range(1, len(column)):
                score += own[b][column[b]]
            best = np.argpartition(-score, rerank)[:rerank] if len(score) > rerank else np.arange(len(score))
            rows, exact = ranked(best, i)
            if len(score) > len(best):
                slack = 1e-9 + (len(own) + 2) * np.finfo(np.float32).eps * float(np.abs(own).max(axis=1).sum())  # rounding of the table and its sums
                may = np.ones(len(score), bool) if len(rows) < k else score >= least_scores(along, across, exact[k - 1] - 1e-12) - slack
                may[best] = False
                if may.any():
                    more, other = ranked(np.flatnonzero(may), i)
                    rows, exact = first_of_each(np.concatenate([rows, more]), np.concatenate([exact, other]))
            found.append((np.full(len(rows), query_ids[i]), ids[rows], exact))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3)) if found else (ids[:0], ids[:0], length[:0])


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches put together to tables of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, len(batch), rows):
            held.append(batch.slice(start, rows))
            n += len(held[-1])
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    infinite = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return rows.where(F.size("embedding") == (lengths["dim"] if lengths else 0))


def nearest(vectors: DataFrame, query, k: int = NEAREST, rerank: int = RERANK, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of all rows for each row of `vectors` for which `query` holds."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-rows")
    total = rows.count()
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    chance = F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(chance < min(1.0, sample / total)).limit(2 * sample).collect() or rows.limit(1).collect()
    chosen = np.array([r.embedding for r in sorted(chosen, key=lambda r: (r.vec_id, r.embedding))])
    shared, dim = spark.sparkContext.broadcast(fit(scaled(chosen))), chosen.shape[1]

    def encode(batches):
        for batch in batches:
            codes = packed(assign(shared.value, paired(scaled(matrix(batch.column(1), dim))))) if len(batch) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "code"])

    index = written(rows.mapInArrow(lean(encode), "vec_id long, embedding array<double>, code binary"), "ann-index")
    # a query whose row comes with several vectors asks with the smallest
    queries = written(index.where(query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    schema, names = "query_id long, vec_id long, score double", ["query_id", "vec_id", "score"]

    def hits(part: DataFrame) -> tuple:
        got = part.toArrow()
        asked = spark.sparkContext.broadcast((got.column(0).to_numpy(), scaled(matrix(got.column(1), dim))))

        def search(batches):
            q_ids, wanted = asked.value
            best = (q_ids[:0], q_ids[:0], np.zeros(0))
            for base in blocks(batches, block_rows):
                codes = np.frombuffer(b"".join(base.column(2).to_pylist()), np.uint8).reshape(len(base), -1)
                found = search_tile(shared.value, base.column(0).to_numpy(), scaled(matrix(base.column(1), dim)), codes, q_ids, wanted, k, rerank)
                best = k_best(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names)

        return index.mapInArrow(lean(search), schema), asked

    parts = max(1, -(-queries.count() // query_rows))
    if parts == 1:
        found = hits(queries)[0]
    else:  # one after another, so that driver and executors hold one part of the queries
        path = new_path(spark, "ann-hits")
        for part in range(parts):
            df, asked = hits(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part))
            df.write.mode("append").parquet(path)
            asked.destroy()
        found = spark.read.schema(schema).parquet(path)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fiftieths(vectors: DataFrame) -> DataFrame:
    """The 5 nearest of all rows for each row whose vec_id is divisible by 50."""
    return nearest(vectors, F.col("vec_id") % 50 == 0)
