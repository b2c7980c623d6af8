"""Toxicity of documents: disguised words are restored by a noisy channel, then words are weighed.

A disguised word is a lattice of characters: a digit or sign may stand for letters, a run of one letter for one
or two of them, and letters spaced out by blanks or dots for one word. Viterbi search takes the path that a
character trigram model of the corpus and the channel's costs together make likeliest. Words without any such
choice restore to themselves.

A restored word counts by its beginnings and as a whole, as stems take endings. Such features are weighed by how
much oftener labelled toxic texts hold them; a text's score is a logistic function of the evidence of its
distinct words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import held_out, table, text_slices, written
from docweave.llm.near_dedup import shingles

# Labelled rows that the weights are fitted on, at most; a hash of the text picks them where there are more.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
# Up to so many labels (12 bytes each) go to all tasks; beyond it texts and labels are shuffled by id.
BROADCAST_LABELS = 1_000_000
STEM_LENGTHS = (4, 5, 6)
LEAST_TEXTS = 5
LEAST_WEIGHT = 3.0
CACHE_WORDS = 400_000

# The letters that a digit or sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou",
}
SUBSTITUTION_COST, COLLAPSE_COST, KEEP_RUN_COST = 1.5, 0.5, 2.0

_WORD = re.compile(r"[\w@$!|+(€*#]+")
_CHOICE = re.compile(r"[0-9@$!|+(€*#_]|(.)\1\1")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][^\W_]){3,}(?![^\W_])")
_ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüý", "aaaaaaceeeeiiiinooooouuuuy")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = len(LETTERS) + 1  # 0 is the edge of a word and everything else


def _latin_codes() -> np.ndarray:
    codes = np.zeros(256, dtype=np.int64)
    for byte in range(256):
        letter = chr(byte).lower().translate(_ACCENTS)
        codes[byte] = LETTERS.find(letter) + 1 if len(letter) == 1 else 0
    return codes


def character_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """How often each three characters follow each other in all texts; its size is that of the alphabet cubed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _latin_codes(), np.zeros(_SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                joined = "\n".join(t for t in part.column(0).to_pylist() if t)
                c = codes[np.frombuffer(joined.encode("latin-1", "replace"), dtype=np.uint8)]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=_SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["gram", "n"])

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "gram long, n long")
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(_SYMBOLS**3)
    total[rows.gram.to_numpy()] = rows.n.to_numpy()
    return total.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed by P(third | second) and evenly."""
    pairs = counts.sum(axis=0)
    short = (pairs + 1) / (pairs.sum(axis=1, keepdims=True) + _SYMBOLS)
    return np.log((counts + 5 * short[None]) / (counts.sum(axis=2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, with the channel's cost."""
    columns = []
    for run in re.finditer(r"(.)\1*", token):
        sign, length = run.group(1), len(run.group(0))
        letters = STANDS_FOR.get(sign)
        if letters is not None:
            columns.append([(letter * n, SUBSTITUTION_COST * n) for letter in letters for n in range(1, min(length, 2) + 1)])
        elif length <= 2:
            columns.append([(sign * length, 0.0)])
        else:
            choices = [(sign, COLLAPSE_COST), (sign * 2, COLLAPSE_COST)]
            columns.append(choices + [(sign * length, KEEP_RUN_COST)])
    return columns


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind ``token`` (lower case): a Viterbi search over the last two characters."""
    code = {c: i + 1 for i, c in enumerate(LETTERS)}
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for column in lattice(token):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (first, second), (score, word) in paths.items():
            for letters, cost in column:
                a, b, total = first, second, score - cost
                for letter in letters.translate(_ACCENTS):
                    c = code.get(letter, 0)
                    total += model[a, b, c]
                    a, b = b, c
                if (a, b) not in following or following[a, b][0] < total:
                    following[a, b] = (total, word + letters)
        paths = following
    return max((score + model[a, b, 0], word) for (a, b), (score, word) in paths.items())[1]


def features(word: str) -> list[str]:
    return [word[:n] for n in STEM_LENGTHS if len(word) > n] + [word + "."]


@dataclass
class ToxicityModel:
    """Restores and weighs words; ``score`` is for whole texts."""

    characters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -3.0
    known: dict[str, tuple[str, float]] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def words(self, text: str) -> set[str]:
        """The distinct words of the text, restored."""
        return {self._look_up(w)[0] for w in self._tokens(text)}

    def evidence(self, text: str) -> float:
        found = {word: weight for word, weight in map(self._look_up, self._tokens(text)) if weight}
        return math.log1p(sum(found.values()))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-min(max(self.slope * self.evidence(text or "") + self.offset, -30.0), 30.0)))

    def _tokens(self, text: str) -> set[str]:
        lower = text.lower()
        tokens = set(lower.split())
        for run in _SPACED.findall(lower):
            tokens.add(re.sub(r"[ .\-_*]", "", run))
        return tokens

    def _look_up(self, token: str) -> tuple[str, float]:
        found = self.known.get(token)
        if found is None:
            best = ("", 0.0)
            # Outer signs are punctuation as a rule; inner ones may stand for letters.
            for part in dict.fromkeys((token.strip("!|+(*#.,;:?\"')"), token)):
                for word in _WORD.findall(part):
                    clean = decode(word, self.characters) if _CHOICE.search(word) and re.search(r"[^\W\d_]", word) else word
                    weight = max((self.weights.get(f, 0.0) for f in features(clean)), default=0.0)
                    if not best[0] or weight > best[1]:
                        best = (clean, weight)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[token] = best
        return found


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    training_rows: int = TRAINING_ROWS,
) -> ToxicityModel:
    """A model from the labelled documents that are not held out.

    The character model covers all texts; weights come from at most ``training_rows`` distinct labelled texts.
    Null texts, ids and labels are left out; a text with two labels takes the larger. Without toxic examples
    every score is the same low one.
    """
    model = ToxicityModel(language_model(character_counts(docs, text_column)))
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).filter(
        F.col("y").isNotNull() & ~held_out(F.col("id"))
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("text IS NOT NULL")
    marks = written(marks.groupBy("id").agg(F.max("y").alias("y")), "marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    labelled = written(texts.join(marks, "id").select("text", "y"), "labelled", "zstd")
    share = min(1.0, training_rows / max(1, labelled.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            held: dict[tuple[str, int], int] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held["", y] = held.get(("", y), 0) + 1
                for f in {f for word in own.words(text) for f in features(word)}:
                    held[f, y] = held.get((f, y), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in held]), pa.array([y for _, y in held], pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["feature", "y", "n"],
            )

    # Near copies would vouch for each other's words: one text stands for those with the same least shingle hash.
    @F.pandas_udf("long")
    def least_shingle(text: pd.Series) -> pd.Series:
        return pd.Series([int(found.min().view(np.int64)) if len(found := shingles(t)) else 0 for t in text], dtype="int64")

    keyed = written(chosen.select(least_shingle("text").alias("key"), "text", "y"), "keyed", "zstd")
    distinct = written(keyed.groupBy("key").agg(F.min(F.struct("text", "y")).alias("one")).select("one.*"), "training", "zstd")
    by_class = distinct.mapInArrow(used, "feature string, y int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("clean")
    )
    counts = written(by_class, "features")
    all_toxic, all_clean = next(iter(counts.filter("feature = ''").select("toxic", "clean").collect()), (0, 0))
    weight = F.log((F.col("toxic") + 0.5) / (all_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (all_clean + 1.0))
    telling = counts.filter((F.col("toxic") >= LEAST_TEXTS) & (F.col("feature") != "")).withColumn("weight", weight)
    rows = telling.filter(F.col("weight") >= LEAST_WEIGHT).select("feature", "weight").collect()  # bounded by the training rows
    model.weights = {r.feature: r.weight for r in rows}

    fitted = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(text: pd.Series) -> pd.Series:
        return text.map(fitted.value.evidence)

    seen = distinct.select(evidence("text").alias("x"), "y").toPandas()
    if len(seen) and seen.y.nunique() > 1:
        model.slope, model.offset = _logistic(seen.x.to_numpy(), (seen.y > 0).to_numpy(dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, slightly held towards zero."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 0.01 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), gradient)
    return float(w[0] / scale), float(w[1])


def toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> Column:
    """The score of every whole text, from 0 to 1; null and empty texts have no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(shared.value.score)

    return score(F.coalesce(F.col(text_column), F.lit("")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
