"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000
# Text that one Arrow batch hands to numpy at once, in bytes.
BATCH_CHARS = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset (tests), under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder, read back: a lost executor repeats a read, not the work behind it."""
    path = work_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand Python a few rows at a time, so that very long texts fit into a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS)) if int(before) > 0 else str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of at most ``BATCH_CHARS`` bytes of text (a longer text is a run of its own)."""
    start, held = 0, 0
    texts = batch.column(batch.schema.get_field_index(column))
    for row, text in enumerate(texts):
        size = text.as_buffer().size if text.is_valid else 0
        if held and held + size > BATCH_CHARS:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


class WordCache(dict):
    """Word to its ids as bytes, made on first use; words not met for ``2 * CACHE_WORDS`` others are forgotten."""

    CACHE_WORDS = 450_000

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def make(self, word: str) -> bytes:
        raise NotImplementedError

    def keeps(self, word: str) -> bool:
        return True

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
            if not self.keeps(word):
                return ids
        if len(self) >= self.CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in text order, where each text's words begin), cutting at single blanks."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)


def joined_ids(pieces: list[bytes], words: np.ndarray, begins: np.ndarray, dtype: str) -> list[np.ndarray]:
    """For each text the ids of its words on end; ``pieces`` are the ids of every distinct word."""
    flat = np.frombuffer(b"".join(pieces), dtype=dtype)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // flat.itemsize
    starts = np.cumsum(lengths) - lengths
    counts = lengths[words]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.arange(total) + np.repeat(starts[words] - (ends - counts), counts)]
    bounds = np.concatenate(([0], ends))[begins].tolist()
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]
