"""L1-L3: dense vectors for chunk texts and queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import EngineConfig
from docweave.functions import text as tx


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Deterministic offline embedder: words hashed into signed buckets, L2-normalized."""

    def __init__(self, dim: int = 1024):
        self.dim = dim

    def embed_query(self, text: str) -> list[float]:
        vector = np.zeros(self.dim)
        for word in re.findall(r"\w+", text.lower()):
            code = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)
            vector[code % self.dim] += 1.0 if code >= 1 << 31 else -1.0
        norm = float(np.sqrt(vector @ vector))
        return [float(x) for x in (vector / norm if norm else vector).astype(np.float32)]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def hashed_totals(texts: DataFrame, dim: int, id_column: str = "doc_id") -> DataFrame:
    """(id_column, totals): the offline embedder's signed word counts per bucket, before scaling to length one.

    Word counts are summed per bucket in the map tasks; a row of ``texts`` is one text.
    """
    word = texts.select(id_column, F.explode(tx.tokens(F.col("text"))).alias("word"))
    code = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    signed = word.select(id_column, (code % dim).alias("bucket"), F.when(code >= 1 << 31, 1).otherwise(-1).alias("sign"))
    sums = signed.groupBy(id_column, "bucket").agg(F.sum("sign").alias("total"))
    held = sums.groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "total"))).alias("held"))  # dim entries at most
    joined = texts.select(id_column).join(held, id_column, "left")
    buckets = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    return joined.select(id_column, F.transform(buckets, lambda b: F.coalesce(F.try_element_at("held", b), F.lit(0).cast("long"))).alias("totals"))


def hashed_vectors(texts: DataFrame, dim: int, id_column: str = "doc_id") -> DataFrame:
    """(id_column, embedding): HashingEmbedder's vectors by built-in functions."""
    totals = hashed_totals(texts, dim, id_column)
    squares = F.aggregate("totals", F.lit(0.0), lambda a, t: a + t.cast("double") * t.cast("double"))
    length = F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))
    return totals.withColumn("length", length).select(id_column, F.transform("totals", lambda t: (t / F.col("length")).cast("float")).alias("embedding"))


class OnnxEmbedder:
    """CPU ONNX embedder, available where the optional fastembed package is installed."""

    def __init__(self, model_name: str = "mixedbread-ai/mxbai-embed-large-v1"):
        try:
            from fastembed import TextEmbedding
        except ImportError as exc:
            raise RuntimeError("fastembed is not installed; use HashingEmbedder or install it") from exc
        self._model = TextEmbedding(model_name=model_name)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(x) for x in v] for v in self._model.embed(list(texts))]

    def embed_query(self, text: str) -> list[float]:
        return [float(x) for x in next(iter(self._model.query_embed(text)))]


def check_dimension(embedder: Embedder, expected: int) -> None:
    """L2: one short text is embedded before any job starts; ValueError when its vector has another width."""
    (vector,) = embedder.embed(["width"])
    if len(vector) != expected:
        raise ValueError(f"the model makes vectors of {len(vector)} numbers, embedding_dim is {expected}")


def embed_chunks(
    chunks: DataFrame, make_embedder: Callable[[], Embedder], config: EngineConfig = EngineConfig()
) -> DataFrame:
    """L1: adds ``embedding`` to a table with a ``text`` column.

    The model is made once per task, on the executor, and fed Arrow batches.
    """
    batch, width = config.embed_batch, config.embedding_dim

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for series in texts:
            parts = [series.iloc[at : at + batch] for at in range(0, len(series), batch)]
            made = [pd.Series(embedder.embed(part.tolist())) for part in parts]
            for part, vectors in zip(parts, made):
                if len(vectors) != len(part) or set(map(len, vectors)) != {width}:
                    raise ValueError(f"{len(part)} texts need as many vectors of {width} numbers")
            yield pd.concat(made, ignore_index=True) if made else pd.Series([], dtype=object)

    return chunks.withColumn("embedding", embed("text"))
