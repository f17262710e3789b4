"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, one row for each language and one column for
each n-gram bucket, broadcast to the executors.  It has at most MATRIX numbers: all
languages that any labelled row names are learned, and should they be more than
MATRIX / 2 ** bits, all share fewer buckets.  It is learned from a bounded sample of
labelled rows: about `per_language` documents of each language, chosen by a hash of the
identifier; their counts are summed in Spark.  Every text is scored whole, in numpy.

Cases: a text that is null or has no letter gets `und` with score 0; rows with a null
language teach nothing; without any labelled row every text gets `und` with score 0;
equal scores go to the language that sorts first; repeated rows each give a row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import char_grams, code_points, groups
from .shared import arrow_rows, held_out, lean

BITS = 16
ORDERS = (1, 2, 3)
#: Bound of the sample that teaches the model.
PER_LANGUAGE = 2000
#: Bound of the broadcast matrix, in single-precision numbers: 256 MB.
MATRIX = 1 << 26
#: Characters that are scored at once.
AT_ONCE = 1_000_000
UNKNOWN = "und"
#: How far the mean of a text's n-grams may lie below its language's, in standard deviations of single n-grams.
SPREADS = 1.5


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log probability of each language
    weights: np.ndarray  # languages x (2 ** bits + 1): log probability of each bucket; the last one weighs nothing
    bits: int


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def buckets(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket at each position, the texts' starts, and whether each text has a letter.

    Everything but letters counts as a space; n-grams that start with two spaces, or
    reach into the next text, go to the bucket that weighs nothing.
    """
    codes, ends = code_points([t.lower() for t in texts])
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    idle = np.zeros(len(codes), bool)
    idle[:-1] = ~is_letter[:-1] & ~is_letter[1:]
    idle[ends[1:] - 1] = True
    found = []
    for order in ORDERS:
        at = char_grams(codes, order, bits)
        at[idle if order > 1 else ~is_letter] = 1 << bits
        if order > 2:
            at[np.maximum(ends[1:] - 2, 0)] = 1 << bits
        found.append(at)
    return found, ends, np.logical_or.reduceat(is_letter, ends[:-1]) if texts else np.zeros(0, bool)


def sampled(rows: DataFrame, per_language: int) -> tuple[list, DataFrame]:
    """Counts of all languages, and about `per_language` rows of each, chosen by a hash of doc_id."""
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counted:
        return [], rows.limit(0)
    share = F.create_map(*[F.lit(x) for r in counted for x in (r.lang, min(1.0, per_language / r.n))])
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return counted, rows.where(chance < F.coalesce(share[F.col("lang")], F.lit(0.0)))


def learn(docs: DataFrame, train, bits: int = BITS, per_language: int = PER_LANGUAGE, matrix: int = MATRIX) -> LanguageModel:
    """Learn from the rows of docs (text, lang) for which `train` holds; sampled by a hash of doc_id."""
    arrow_rows(docs.sparkSession)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted, sample = sampled(rows, per_language)
    names = [r.lang for r in counted]
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((0, (1 << bits) + 1), np.float32), bits)
    bits = max(1, min(bits, int(np.log2(matrix / len(names)))))
    number = {x: k for k, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(1).to_pylist(), [number[x] for x in batch.column(0).to_pylist()]
            for a, b in groups([len(t) for t in texts], AT_ONCE):
                found, ends, _ = buckets(texts[a:b], bits)
                language = np.repeat(np.array(own[a:b], np.int64) << 32, np.diff(ends))
                cells, n = np.unique(np.concatenate([(language | at)[at < 1 << bits] for at in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    cells = sample.select("lang", "text").repartition(8).mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    at = cells.column("cell").to_numpy()
    counts = np.zeros((len(names), (1 << bits) + 1), np.float32)
    counts[at >> 32, at & 0xFFFFFFFF] = cells.column("n").to_numpy()
    counts[:, :-1] += 0.5
    total = counts.sum(axis=1, dtype=np.float64, keepdims=True)
    np.log(counts, out=counts, where=counts > 0)
    counts[:, :-1] -= np.log(total)
    seen = np.array([r.n for r in counted], float)
    return LanguageModel(names, np.log(seen / seen.sum()), counts, bits)


def scores(texts: list[str], model: LanguageModel, moments: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The likeliest language of each text, its posterior probability, the mean of its n-grams' log probabilities, and with `moments` their variance."""
    found, ends, has_letter = buckets(texts, model.bits)
    total = np.empty((len(model.languages), len(texts)))
    for k, (row, prior) in enumerate(zip(model.weights, model.prior, strict=True)):
        gathered = row[found[0]]
        for at in found[1:]:
            gathered += row[at]
        total[k] = prior + np.add.reduceat(gathered, ends[:-1], dtype=np.float64)
    best = total.argmax(axis=0)
    score = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    n = sum(np.add.reduceat(at < 1 << model.bits, ends[:-1], dtype=np.float64) for at in found)
    mean, variance = (total[best, np.arange(len(texts))] - model.prior[best]) / np.maximum(n, 1), np.zeros(len(texts))
    if moments:
        own = np.repeat(best, np.diff(ends))
        variance = sum(np.add.reduceat(model.weights[own, at].astype(np.float64) ** 2, ends[:-1]) for at in found) / np.maximum(n, 1) - mean**2
    return [model.languages[k] if x else UNKNOWN for k, x in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0), mean, variance


def predict(docs: DataFrame, model: LanguageModel, moments: bool = False) -> DataFrame:
    """Columns _0, _1 and so on as those of docs, and _lang, _score, _mean and _variance (0 without `moments`; see scores), from the column text alone; no shuffle."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [f"_{k}" for k in range(len(docs.columns))]
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            predicted, score, mean, variance = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in groups([len(t) for t in texts], AT_ONCE) if own.languages else []:
                predicted[a:b], score[a:b], mean[a:b], variance[a:b] = scores(texts[a:b], own, moments)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score), pa.array(mean), pa.array(variance)], [*names, "_lang", "_score", "_mean", "_variance"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return docs.toDF(*names).mapInArrow(lean(run), f"{schema}, _lang string, _score double, _mean double, _variance double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows held out teach nothing."""
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"], docs["lang"].cast("string"))
    model = learn(docs, ~held_out(F.col("doc_id")))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select(F.col("_0").alias("doc_id"), held_out(F.col("_0")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def least_mean(docs: DataFrame, model: LanguageModel, per_language: int = PER_LANGUAGE) -> float:
    """The mean log probability of n-grams below which a text is in no language of the model.

    Held-out texts that are recognised show what a language's texts have; SPREADS standard
    deviations of single n-grams below that, in the language where this is least, is the bound.
    Without such texts those that taught the model do.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    for part in (rows.where(held_out(F.col("doc_id"))), rows):
        _, sample = sampled(part, per_language)
        found = predict(sample.select("text", "lang"), model, moments=True).where(F.col("_1") == F.col("_lang"))
        bounds = found.groupBy("_lang").agg((F.avg("_mean") - SPREADS * F.sqrt(F.avg("_variance"))).alias("bound")).agg(F.min("bound").alias("b")).first()
        if bounds.b is not None:
            return bounds.b
    return float("-inf")


def with_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows whose language is known with a probability of `least` or more, all columns as they are.

    Learns as language_id does; rejects texts without a letter, those on which the languages disagree,
    and those whose n-grams are too rare in every language (least_mean), as the posterior compares
    known languages only and says nothing of others.
    """
    own = docs.select(docs["doc_id"].cast("long"), docs["text"], docs["lang"].cast("string"))
    model = learn(own, ~held_out(F.col("doc_id")))
    if not model.languages:
        return docs.limit(0)
    kept = predict(docs, model).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least) & (F.col("_mean") >= least_mean(own, model)))
    return kept.drop("_lang", "_score", "_mean", "_variance").toDF(*docs.columns)
