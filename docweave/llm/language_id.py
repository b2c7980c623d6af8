"""Language of documents by error-correcting output codes over character n-grams.

Every language gets a codeword of bits. For each bit a linear classifier tells the languages with a one from
those with a zero: its weights are log-ratios of smoothed n-gram frequencies, summed over the training texts of
either side. A text takes the language whose codeword has the smallest loss, where each bit's loss is weighed by
how reliable its classifier was in training; two languages nearly level make the text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import held_out, table, text_slices

BUCKETS = 1 << 13
# Margins are per n-gram; the exponential loss sees them times this.
SHARPNESS = 6.0
AMBIGUOUS = 0.1
UNDETERMINED = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed runs of one to three letters (word edges as a blank) in a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint32)
    letters = (codes > 127) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letters, codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]  # one blank between words
    total = np.bincount(((codes * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    for size in (2, 3):
        if len(codes) >= size:
            mixed = codes[: len(codes) - size + 1].copy()
            for i in range(1, size):
                mixed = (mixed * np.uint32(0x01000193)) ^ codes[i : len(codes) - size + 1 + i]
            total += np.bincount(((mixed * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: all ways to part few languages in two, else random balanced bits.

    Up to 7 languages take every split; more take 10 log2 bits drawn from a fixed seed, without equal rows.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        splits = [[1 if language == 0 or mask >> (language - 1) & 1 else -1 for language in range(languages)] for mask in range(2 ** (languages - 1) - 1)]
        return np.array(splits, dtype=float).T
    draw, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(languages)))
    while True:
        words = draw.choice([-1.0, 1.0], size=(languages, bits))
        apart = (words @ words.T - bits * np.eye(languages)).max() < 0.6 * bits
        if apart and (np.abs(words.sum(axis=0)) < languages).all():
            return words


@dataclass
class LanguageModel:
    languages: list[str]
    words: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    reliability: np.ndarray  # bit

    def losses(self, text: str) -> np.ndarray:
        counts = gram_counts(text)
        margins = counts @ self.weights / max(1, counts.sum())
        return np.exp(np.clip(-SHARPNESS * margins * self.words, -20, 20)) @ self.reliability

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, ambiguous); ``und`` and 0 for texts without a letter."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        inverse = 1.0 / self.losses(text)
        share = inverse / inverse.sum()
        best = int(share.argmax())
        second = float(np.partition(share, -2)[-2]) if len(share) > 1 else 0.0
        return self.languages[best], float(share[best]), bool(share[best] - second < AMBIGUOUS)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """A model from all documents that are not held out and have a language; their n-gram counts are summed in Spark."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if has_letter(text):
                        found = gram_counts(text)
                        total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used, pa.int64()), pa.array(found[used], pa.int64())], names=["lang", "bucket", "n"]
            )

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages times buckets at most
    languages = sorted(sums.lang.unique().tolist())
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counts[sums.lang.map(languages.index).to_numpy(), sums.bucket.to_numpy()] = sums.n.to_numpy()
    words = codewords(len(languages))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)  # a language weighs the same however many texts it has
    weights = np.zeros((BUCKETS, words.shape[1]))
    for bit, column in enumerate(words.T):
        ones, zeros = shares[column > 0], shares[column < 0]
        if len(ones) and len(zeros):
            weights[:, bit] = np.log(ones.mean(axis=0)) - np.log(zeros.mean(axis=0))
    # A bit is as reliable as its mean margin over the languages' own n-grams is wide.
    margins = (shares @ weights) * words
    reliability = np.maximum(margins.min(axis=0), 1e-3) if languages else np.ones(words.shape[1])
    return LanguageModel(languages, words, weights, reliability / reliability.sum())


def language(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> Column:
    """A struct (lang, score, ambiguous) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in text]
        return pd.DataFrame(found, columns=["lang", "score", "ambiguous"])

    return predict(F.col(text_column))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their language, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(docs, fit(docs)).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))
