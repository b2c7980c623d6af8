"""R1-R3 for many questions at once: one scan of the chunks answers a whole question set.

Each task keeps its k best chunks per question while it reads, so what is
shuffled is k rows per question and task, however large the corpus is and
however many chunks match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions import vector as vec
from docweave.operators import retrieval as rt
from docweave.session import shared_folder, stored

# The driver holds at most about this many questions at a time.
QUESTIONS_AT_ONCE = 4096
# A question slice is shipped to every task; larger sets take one scan per slice.
SLICE_BYTES = 64 << 20
SCORE_DIGITS = 9
# Scores (chunks x questions) that a task holds at a time.
SCORED_CELLS = 200_000
# Texts whose words a task holds at a time.
TEXTS_AT_ONCE = 256
# Fixed value: what lies between index terms.
NOT_A_WORD = r"[^\p{L}\p{N}_]+"


class _Best:
    """The k best (score, id) per question seen so far, ties to the smaller id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=object))] * questions

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: chunks x questions; NaN marks a chunk that does not match."""
        for q, (old_scores, old_ids) in enumerate(self.rows):
            column = scores[:, q]
            matching = np.flatnonzero(~np.isnan(column))
            if len(matching) > self.k:
                cut = np.partition(column[matching], -self.k)[-self.k]
                matching = matching[column[matching] >= cut]
            if len(old_scores) == self.k:
                matching = matching[column[matching] >= old_scores[-1]]
            if len(matching) == 0:
                continue
            all_scores = np.concatenate([old_scores, column[matching]])
            all_ids = np.concatenate([old_ids, ids[matching]])
            order = sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))[: self.k]
            self.rows[q] = (all_scores[order], all_ids[order])

    def batches(self, names: Sequence, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for name, (scores, ids) in zip(names, self.rows):
            if len(scores):
                columns = [pa.array([name] * len(scores), schema.field(0).type), pa.array(list(ids), schema.field(1).type), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _slices(questions: Sequence, bytes_each: int) -> list[Sequence]:
    per_slice = max(1, SLICE_BYTES // max(1, bytes_each))
    return [questions[i : i + per_slice] for i in range(0, len(questions), per_slice)]


def _top(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nothing(chunks: DataFrame) -> DataFrame:
    empty = chunks.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    return _top(empty, 1)


def _arrow_type(df: DataFrame) -> tuple[str, pa.DataType]:
    """Chunk ids are strings or longs."""
    kind = df.schema["id"].dataType.simpleString()
    return kind, pa.int64() if kind == "bigint" else pa.string()


def _object_ids(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def dense_top_k(chunks: DataFrame, questions: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """R1 for (query_id, vector) questions: query_id, id, score, rank."""
    kind, id_type = _arrow_type(chunks)
    schema = pa.schema([("query_id", pa.int64()), ("id", id_type), ("score", pa.float64())])
    if not questions:
        return _nothing(chunks)

    def scan(part: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
        names = [q for q, _ in part]
        unit = vec.unit_rows(np.asarray([v for _, v in part], dtype=np.float64)).T

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = _Best(len(names), k)
            for batch in batches:
                good, matrix = vec.dense_matrix(batch.column("embedding"), unit.shape[0])
                cos = vec.unit_rows(matrix) @ unit
                kept.add(_object_ids(batch.column("id"))[good], np.round((1 + cos) / 2, SCORE_DIGITS))
            yield from kept.batches(names, schema)

        return chunks.select("id", "embedding").mapInArrow(best, f"query_id long, id {kind}, score double")

    width = len(questions[0][1])
    return _top(reduce(DataFrame.unionByName, map(scan, _slices(questions, 8 * width))), k)


def question_counts(chunks: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(id, length, terms, tfs) of every chunk: how often it holds the words of a vocabulary, by their numbers."""
    words, (kind, id_type) = pa.array(list(vocabulary), pa.large_string()), _arrow_type(chunks)
    schema = pa.schema([("id", id_type), ("length", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(start, TEXTS_AT_ONCE) for whole in batches for start in range(0, whole.num_rows, TEXTS_AT_ONCE)):
            split = pc.split_pattern_regex(pc.fill_null(batch.column(1).cast(pa.large_string()), ""), NOT_A_WORD)
            flat, bounds = split.flatten(), split.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            length = np.bincount(row[pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0], minlength=batch.num_rows)
            term = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy().astype(np.int64)
            pairs, tf = np.unique(row[term >= 0] * len(words) + term[term >= 0], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(pairs // len(words), minlength=batch.num_rows))))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (pairs % len(words), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(length, pa.int64()), *lists], schema=schema)

    lowered = chunks.select("id", F.lower("text"))
    return lowered.mapInArrow(count, f"id {kind}, length long, terms array<int>, tfs array<int>")


def bm25_top_k(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """R2 for questions (query_id, text): query_id, id, score, rank.

    Texts are read once per part of the questions, for the counts of their words; document frequencies and scores
    come from the stored counts. A chunk is scored inside its task for all questions that share a word with it, and
    a task hands on its k best chunks per question, however common the words are.
    """
    terms = questions.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    weighted = stored(terms.groupBy("query_id", "term").agg(F.count("*").alias("weight")), "question-terms")
    return answer_all(weighted.select("query_id").distinct(), lambda rows: _bm25_part(chunks, weighted, [r["query_id"] for r in rows], k))


def _bm25_part(chunks: DataFrame, weighted: DataFrame, names: Sequence[int], k: int) -> DataFrame:
    """``bm25_top_k`` for the questions ``names``, whose words fit the driver and every task."""
    if not names:
        return _nothing(chunks)
    rows = weighted.join(F.broadcast(weighted.sparkSession.createDataFrame([(n,) for n in names], "query_id long")), "query_id").collect()
    vocabulary = sorted({r["term"] for r in rows})
    number, place = {t: i for i, t in enumerate(vocabulary)}, {n: i for i, n in enumerate(names)}
    counts = stored(question_counts(chunks, vocabulary), "question-counts")
    n_docs, mean = counts.agg(F.count("*"), F.avg("length")).first()
    df = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row per word
    postings: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for r in rows:
        term = number[r["term"]]
        if term in df:
            postings[term].append((place[r["query_id"]], r["weight"] * rt.idf(n_docs, df[term])))
    sizes = np.array([len(p) for p in postings], dtype=np.int64)
    flat = np.array([q for p in postings for q, _ in p], dtype=np.int64)
    weights = np.array([w for p in postings for _, w in p])
    begins, mean = np.cumsum(sizes) - sizes, mean or 1.0
    kind, id_type = _arrow_type(chunks)
    schema = pa.schema([("query_id", pa.int64()), ("id", id_type), ("score", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, at_once = _Best(len(names), k), max(128, SCORED_CELLS // len(names))
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                held = np.diff(batch.column("terms").offsets.to_numpy())
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                row = np.repeat(np.arange(batch.num_rows), held)
                length = batch.column("length").to_numpy()[row]
                impact = tf / (tf + rt.BM25_K1 * (1 - rt.BM25_B + rt.BM25_B * length / mean))
                n = sizes[term]
                ends = np.cumsum(n)
                spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[term] - (ends - n), n)
                cell = np.repeat(row, n) * len(names) + flat[spots]
                shape = (batch.num_rows, len(names))
                score = np.bincount(cell, np.repeat(impact, n) * weights[spots], minlength=shape[0] * shape[1]).reshape(shape)
                hit = np.bincount(cell, minlength=score.size).reshape(shape) > 0
                kept.add(_object_ids(batch.column("id")), np.where(hit, np.round(score, SCORE_DIGITS), np.nan))
        yield from kept.batches(names, schema)

    return _top(counts.mapInArrow(best, f"query_id long, id {kind}, score double"), k)


def answer_all(questions: DataFrame, answer: Callable[[list[Row]], DataFrame], path: str | None = None) -> DataFrame:
    """``answer(rows)`` for a question table of any size (unique column query_id).

    A set that fits the driver's share is answered directly. A larger one is
    cut by hash, and the answers of each part are appended to a table in the
    shared folder, so neither the driver nor a plan ever holds all questions.
    """
    parts = -(-questions.count() // QUESTIONS_AT_ONCE)
    if parts <= 1:
        return answer(questions.collect())
    spark = questions.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/docweave/answers-{uuid.uuid4().hex}"
    code = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    for part in range(parts):
        answer(questions.where(code == part).collect()).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def hybrid_top_k(chunks: DataFrame, questions: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """R4 hybrid for questions (query_id, text, embedding): query_id, id, score, rrf_score, rank.

    A question without a vector is answered by its words alone.
    """
    asked = questions.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    dense = answer_all(asked, lambda rows: dense_top_k(chunks, [tuple(r) for r in rows], k))
    sparse = bm25_top_k(chunks, questions, k)
    return rt.reciprocal_rank_fusion(dense, sparse, k=rrf_k, by=("query_id",)).where(F.col("rank") <= k)
