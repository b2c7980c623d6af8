"""Cosine similarity over ARRAY<FLOAT> columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense_matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of ``width``, those vectors as float64) of an Arrow list array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    good = np.flatnonzero(lengths == width)
    if len(good) < len(vectors):
        vectors = vectors.take(pa.array(good))
    values = np.asarray(vectors.flatten(), dtype=np.float64)
    return good, values.reshape(len(good), width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def cosine_to(query: Sequence[float]):
    """A function scoring a vector column against one query; NULL where the width differs.

    Arrow hands whole batches of vectors to numpy, which is far cheaper per
    element than evaluating a lambda per coordinate.
    """
    unit = unit_rows(np.asarray([query], dtype=np.float64))[0]

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        good, matrix = dense_matrix(vectors, len(unit))
        out = np.full(len(vectors), np.nan)
        out[good] = unit_rows(matrix) @ unit
        return pa.array(out, mask=np.isnan(out))

    return score


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, in the JVM; NULL when a norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity_score(cos: Column) -> Column:
    """The index score of a cosine: mapped from -1..1 to 0..1."""
    return (1 + cos) / 2
