"""Batch embedding through a caller-supplied encoder, and vector checks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom import rules
from mailloom.functions.text import bind
from mailloom.operators.chunking import embedding_text, payload

Encoder = Callable[[np.ndarray], np.ndarray]


def embed(
    chunks: DataFrame, make_encoder: Callable[[], Encoder], *, batch_size: int = 200, out: str = "vector"
) -> DataFrame:
    """Add one dense vector per row from its sender, subject and chunk text.

    ``make_encoder`` runs once per Python worker and returns a function from
    an array of texts to a matrix, so a model is loaded once and fed batches.
    """
    name = uuid.uuid4()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ModelCache.get(name)
        if encoder is None:
            encoder = make_encoder()
            ModelCache.add(name, encoder)
        for texts in batches:
            for at in range(0, len(texts), batch_size):
                yield _vectors(encoder, np.array(texts.slice(at, batch_size).to_pylist(), dtype=object))

    text = embedding_text(F.col("sender"), F.col("subject"), F.col("chunk_text"))
    return chunks.withColumn(out, encode(text))


def _vectors(encoder: Encoder, texts: np.ndarray) -> pa.Array:
    """The rows of the encoder's matrix as lists, without an object for each number."""
    matrix = np.ascontiguousarray(encoder(texts), dtype=np.float32)
    if matrix.ndim != 2 or len(matrix) != len(texts):
        raise ValueError(f"an encoder of {len(texts)} texts gave an array of shape {matrix.shape}")
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel()))


def hashing_encoder(dim: int = rules.VECTOR_DIM) -> Callable[[], Encoder]:
    """Token counts in hashed slots; a deterministic stand-in for a model."""

    def make() -> Encoder:
        @lru_cache(maxsize=1 << 16)
        def slot(token: str) -> int:
            return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim

        def encode(texts: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount([slot(t) for t in text.split(" ")], minlength=dim) for text in texts])

        return encode

    return make


def norm(vector: Column) -> Column:
    """Euclidean length, in double precision."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    return bind(
        F.struct(vector.alias("v"), norm(vector).alias("n")),
        lambda s: F.when(s.n == 0, F.transform(s.v, lambda x: x.cast("double"))).otherwise(
            F.transform(s.v, lambda x: x.cast("double") / s.n)
        ),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; NULL where a side has length zero."""
    dot = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.try_divide(dot, norm(left) * norm(right))


def has_dim(vector: Column, dim: int = rules.VECTOR_DIM) -> Column:
    """True for a vector of the declared size without missing entries."""
    return (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())


def split_by_dim(df: DataFrame, vector: str = "vector", dim: int = rules.VECTOR_DIM) -> tuple[DataFrame, DataFrame]:
    """(fitting rows, rejected rows) by vector size."""
    fits = F.coalesce(has_dim(F.col(vector), dim), F.lit(False))
    return df.filter(fits), df.filter(~fits)


def to_points(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows of the points table: id, payload, vector."""
    return chunks.select(F.col("point_id").alias("id"), payload().alias("payload"), F.col(vector).alias("vector"))
