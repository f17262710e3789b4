"""Vectors as column expressions, in double precision, and as Arrow functions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """To length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


@F.pandas_udf(LongType())
def term_id(terms: pd.Series) -> pd.Series:
    """31 bits of a BLAKE2b digest: the numbers of terms on the wire.  Joins use the terms themselves, which can't collide."""
    return terms.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") & 0x7FFFFFFF).astype("Int64")


def hash_embedding(dim: int):
    """Stand-in for an embedding model: a unit vector drawn from a generator that the text's digest seeds; carries no meaning."""
    import numpy as np

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")
            v = np.random.Generator(np.random.PCG64(seed)).standard_normal(dim).astype("float32")  # rounded first: single precision throughout
            return v / np.linalg.norm(v)

        return texts.map(one)

    return embed
