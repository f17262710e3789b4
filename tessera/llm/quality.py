"""Operator 9: a quality classifier from naive Bayes support vectors.

Indicators of hashed n-grams (characters, words, and shapes of words, with a mark for a
word that repeats the one before) are scaled by the log-count ratios of the two
classes, brought to length 1, and a linear model with hinge loss is fitted by dual
coordinate descent.  A logistic curve, fitted on labelled rows that the model hasn't
seen, turns its margin into a score from 0 to 1.

It's fitted on a bounded sample of labelled rows: about SAMPLE documents, chosen by a
hash of the identifier, of which the driver gets at most 2 ** BITS / 8 bytes each (49 MB
in all).  Every text is scored whole.

Cases: null and empty texts have no indicators and get the score of the intercept;
labels that are null or without a document teach nothing; repeated labels of a document
count as their largest; with fewer than two classes the score is the share of label 1
(0.5 without any label); repeated rows each give a row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import char_grams, code_points, groups, mixed
from .shared import arrow_rows, held_out, lean

BITS = 16
#: Bound of the sample that fits the model.
SAMPLE = 6000
THRESHOLD = 0.3
AT_ONCE = 1_000_000


@dataclass
class QualityModel:
    ratio: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # of each bucket's scaled indicator
    intercept: float
    slope: float  # of the logistic curve
    offset: float
    constant: float | None = None  # the score of all texts, where nothing could be fitted


def word_grams(codes: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, word pairs, shapes, and runs of two to four shapes; and each one's text, in order of texts."""
    upper = (codes >= 65) & (codes <= 90) | (codes >= 192) & (codes <= 222)
    lower = (codes >= 97) & (codes <= 122) | (codes >= 223) & (codes <= 591)
    digit = (codes >= 48) & (codes <= 57)
    space = (codes == 32) | (codes >= 9) & (codes <= 13)
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    position = np.arange(len(codes), dtype=np.uint64)
    powers = np.cumprod(np.full(len(codes) + 1, 0x9E3779B97F4A7C15, np.uint64))
    inverse = np.cumprod(np.full(len(codes) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers[position])])
    hashed = (sums[end] - sums[start]) * inverse[start]
    word = (hashed ^ (hashed >> np.uint64(29))).astype(np.uint32) ^ (hashed >> np.uint64(32)).astype(np.uint32)
    kinds = upper.view(np.uint8) | lower.view(np.uint8) << 1 | digit.view(np.uint8) << 2
    kinds[kinds == 0] = 8
    shape = np.bitwise_or.reduceat(kinds, np.stack([start, end], 1).ravel())[::2].astype(np.uint32)
    shape |= kinds[start].astype(np.uint32) << 4 | kinds[end - 1].astype(np.uint32) << 8
    owner = np.searchsorted(ends, start, "right") - 1
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    shape |= again.astype(np.uint32) << 12
    found, owners = [mixed(word * np.uint32(7) + np.uint32(1), bits), mixed(shape * np.uint32(11) + np.uint32(2), bits)], [owner, owner]
    for base, most, salt in ((word, 2, 3), (shape, 4, 17)):
        run = base.copy()
        for n in range(2, most + 1):
            run = run[:-1] * np.uint32(0x01000193) + base[n - 1 :]
            inside = owner[: len(run)] == owner[n - 1 :]
            found.append(mixed(run[inside] * np.uint32(13) + np.uint32(salt + n), bits))
            owners.append(owner[: len(run)][inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found)[order], np.concatenate(owners)[order]


def indicators(texts: list[str], bits: int) -> Iterator[np.ndarray]:
    """For each text a vector of 2 ** bits with 1 for each n-gram that it has; the same array is used again."""
    mark = np.zeros(1 << bits, np.float32)
    codes, ends = code_points(texts)
    orders = [char_grams(codes, n, bits) for n in (1, 2, 3)]
    words, owner = word_grams(codes, ends, bits)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        mark[:] = 0
        if text:
            for n, at in enumerate(orders):
                mark[at[ends[k] : ends[k + 1] - n]] = 1
            mark[words[bounds[k] : bounds[k + 1]]] = 1
        yield mark


def packed(mark: np.ndarray) -> bytes:
    """A vector of zeros and ones as bytes: the numbers of the ones, or, where these take more, all bits."""
    ones = np.flatnonzero(mark).astype("<u4")
    return b"n" + ones.tobytes() if 32 * len(ones) <= len(mark) else b"b" + np.packbits(mark > 0).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    """The numbers of the ones of packed()."""
    return np.frombuffer(row, "<u4", offset=1) if row[:1] == b"n" else np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8, offset=1)))


def descend(rows: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; rows gives a row's buckets and values; the last weight is the intercept's."""
    w, alpha, rng = np.zeros(dim + 1), np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1 for v in (rows(i)[1] for i in range(len(y)))])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(y)):
            at, values = rows(i)
            gradient = y[i] * (w[at] @ values + w[dim]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                alpha[i], largest = new, max(largest, abs(step))
                w[at] += step * y[i] * values
                w[dim] += step * y[i]
        if largest < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton's method; the slope isn't negative."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [g @ margin, g.sum()])
        a, b = max(a - step[0], 1e-3), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[bytes], labels: np.ndarray, bits: int) -> QualityModel:
    """Fit on the packed() indicators of each text and labels of 0 and 1; every fifth row only fits the curve."""
    dim, zero = 1 << bits, np.zeros(1 << bits, np.float32)
    if len(set(labels.tolist())) < 2 or min(np.bincount(labels)) < 5:
        return QualityModel(zero, zero, 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    y = np.where(labels > 0, 1.0, -1.0)
    fits = np.ones(len(y), bool)
    for side in (-1.0, 1.0):
        fits[np.flatnonzero(y == side)[::5]] = False
    counts = [np.ones(dim), np.ones(dim)]
    for i in np.flatnonzero(fits):
        counts[int(y[i] > 0)][unpacked(rows[i])] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    def scaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        at = unpacked(rows[i])
        v = ratio[at]
        return at, v / max(np.sqrt(v @ v), 1e-9)

    use = np.flatnonzero(fits)
    cost = np.where(y > 0, len(use) / (2 * np.sum(y[use] > 0)), len(use) / (2 * np.sum(y[use] < 0)))
    w = descend(lambda k: scaled(use[k]), y[use], cost[use], dim)
    rest = np.flatnonzero(~fits)
    margin = np.array([w[at] @ values + w[dim] for at, values in map(scaled, rest)])
    slope, offset = logistic(margin, y[rest])
    return QualityModel(ratio.astype(np.float32), w[:dim].astype(np.float32), float(w[dim]), slope, offset)


def learn(docs: DataFrame, labels: DataFrame, train, bits: int = BITS, sample: int = SAMPLE) -> QualityModel:
    """Fit on about `sample` labelled rows of docs for which `train` holds, chosen by a hash of doc_id."""
    arrow_rows(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality").cast("int")).alias("quality")).where(train)
    n = known.count()
    chance = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = F.broadcast(known.where(chance < min(1.0, sample / max(n, 1))))  # bounded by `sample`
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text").repartition(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in groups([len(t) for t in texts], AT_ONCE):
                found = [packed(mark) for mark in indicators(texts[a:b], bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(found, pa.binary())], ["doc_id", "quality", "at"])

    got = sorted(rows.mapInArrow(lean(run), "doc_id long, quality int, at binary").collect(), key=lambda r: (r.doc_id, r.quality, r["at"]))
    return fit([bytes(r["at"]) for r in got], np.array([int(r.quality > 0) for r in got], int), bits)


def predict(docs: DataFrame, model: QualityModel, bits: int = BITS) -> DataFrame:
    """doc_id and score of every row, from the column text alone; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        square, product = own.ratio**2, own.ratio * own.weight
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            score = np.full(len(texts), own.constant if own.constant is not None else 0.0)
            for a, b in groups([len(t) for t in texts], AT_ONCE) if own.constant is None else []:
                for k, mark in enumerate(indicators(texts[a:b], bits), a):
                    margin = float(mark @ product) / max(float(mark @ square) ** 0.5, 1e-9) + own.intercept
                    score[k] = 1 / (1 + np.exp(-np.clip(own.slope * margin + own.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row; rows held out teach nothing."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"])
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
