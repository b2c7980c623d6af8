"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. Its evidence is linear in what the line and its two neighbours look like (length, words,
shares of signs and capitals, repetition); a matrix of transitions ties a line to the one before. Forward and backward
passes give each line's probability to be good, and a document's quality is their mean, weighted by the lines' lengths.

The field is fitted by the likelihood of labelled documents, whose lines take the document's label, in numpy on a
bounded sample; only what lines look like leaves the tasks. All documents are scored whole, many at a time: step t of
the passes covers the t-th line of every document of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import small_batches, table, text_slices, written

# Labelled documents that the field is fitted on, at most, and lines of each; longer ones are not used for fitting.
TRAINING_ROWS = 6_000
TRAINING_LINES = 400
THRESHOLD = 0.3
STEPS = 150
RATE = 0.15
# How strongly weights are held towards zero, per document.
PENALTY = 1e-4
MOST = 30.0

FEATURES = (
    "empty", "characters", "words", "one_word", "few_words", "word_length", "capitals", "digits", "stops", "signs", "wide",
    "repeated_words", "stuttered_words", "repeated_line", "ends_sentence", "begins_large",
)
_OWN = len(FEATURES)
WIDTH = 3 * _OWN + 3  # the line's, the previous and the next one's, two edges and a constant

_CAPITAL, _DIGIT, _STOP, _SIGN, _WIDE, _BEGIN = 1, 2, 3, 4, 5, 6


def _byte_classes() -> np.ndarray:
    """0 for blanks and small letters; the lead bytes of wide characters stand for the character, the others for nothing."""
    classes = np.zeros(256, dtype=np.uint8)
    classes[33:127] = _SIGN
    for signs, kind in ((b".,;:?'\"()-", _STOP), (b"0123456789", _DIGIT), (bytes(range(65, 91)), _CAPITAL), (bytes(range(97, 123)), 0)):
        classes[list(signs)] = kind
    classes[192:] = _WIDE
    return classes


def _share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return counts / np.maximum(of, 1)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(looks of every line, characters of every line and its end, lines of every text); an empty text is one empty line."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    lines = [line for text in texts for line in text.split("\n")]
    counts = np.array([text.count("\n") + 1 for text in texts], dtype=np.int64)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    classes = _byte_classes()[data]
    continued = (data >= 128) & (data < 192)

    def held(mask: np.ndarray) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return before[ends] - before[starts]

    length = ends - starts - held(continued)
    kinds = {kind: _share(held(classes == kind), length) for kind in (_CAPITAL, _DIGIT, _STOP, _SIGN, _WIDE)}
    column = pa.array(lines, pa.large_string())
    words = pc.split_pattern(column, " ")
    flat = words.flatten()
    row = np.repeat(np.arange(len(lines)), np.diff(words.offsets.to_numpy()))
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    row, code = row[real], code[real]
    n = np.bincount(row, minlength=len(lines))
    pairs = np.unique(row * (len(coded.dictionary) + 1) + code)
    distinct = np.bincount(pairs // (len(coded.dictionary) + 1), minlength=len(lines))
    stutter = np.bincount(row[1:][(row[1:] == row[:-1]) & (code[1:] == code[:-1])], minlength=len(lines))
    numbers = column.dictionary_encode()
    document = np.repeat(np.arange(len(texts)), counts)
    first = np.unique(document * (len(numbers.dictionary) + 1) + numbers.indices.to_numpy(zero_copy_only=False), return_index=True)[1]
    again = np.ones(len(lines), dtype=bool)
    again[first] = False
    full = ends > starts
    last, begin = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool)
    last[full] = np.isin(data[ends[full] - 1], list(b".!?:;\"'"))
    begin[full] = np.isin(classes[starts[full]], (_CAPITAL, _DIGIT))
    looks = np.stack(
        [
            ~full, np.log1p(length), np.log1p(n), n == 1, (n > 1) & (n < 4), np.log1p(_share(length, n)),
            kinds[_CAPITAL], kinds[_DIGIT], kinds[_STOP], kinds[_SIGN], kinds[_WIDE],
            _share(n - distinct, n), _share(stutter, n), again & full, last, begin,
        ],
        axis=1,
    ).astype(np.float32)
    return looks, length + 1, counts


def with_neighbours(looks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's looks beside those of the lines before and after it in its document."""
    ends = np.cumsum(counts)
    top, bottom = np.zeros(len(looks), dtype=bool), np.zeros(len(looks), dtype=bool)
    top[ends - counts], bottom[ends - 1] = True, True
    out = np.zeros((len(looks), WIDTH), dtype=np.float32)
    out[:, :_OWN] = looks
    out[1:, _OWN : 2 * _OWN] = looks[:-1]
    out[:-1, 2 * _OWN : 3 * _OWN] = looks[1:]
    out[top, _OWN : 2 * _OWN] = 0
    out[bottom, 2 * _OWN : 3 * _OWN] = 0
    out[:, -3], out[:, -2], out[:, -1] = top, bottom, 1
    return out


class Steps:
    """Lines of many documents, dealt by their place in the document: step t is a run of ``order``."""

    def __init__(self, counts: np.ndarray):
        longest_first = np.argsort(-counts, kind="stable")
        sizes = counts[longest_first]
        begins = (np.cumsum(counts) - counts)[longest_first]
        steps = int(sizes[0]) if len(sizes) else 0
        # How many documents have more than t lines.
        self.active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        self.bounds = np.concatenate(([0], np.cumsum(self.active)))
        step = np.repeat(np.arange(steps), self.active)
        self.order = begins[np.arange(self.bounds[-1]) - self.bounds[step]] + step


def marginals(evidence: np.ndarray, transitions: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each line to be good, expected transitions summed over all documents).

    ``evidence`` is the log-odds of each line, in the order of lines; ``transitions[a, b]`` the logarithm of the
    weight of a line b after a line a, 0 for bad and 1 for good.
    """
    odds = np.exp(np.clip(evidence[steps.order], -MOST, MOST))
    (bad_bad, bad_good), (good_bad, good_good) = np.exp(np.clip(transitions, -MOST, MOST))
    forward, backward = np.empty(len(odds)), np.empty(len(odds))
    expected = np.zeros((2, 2))
    for t, n in enumerate(steps.active.tolist()):
        here = slice(steps.bounds[t], steps.bounds[t] + n)
        if t:
            p = forward[steps.bounds[t - 1] : steps.bounds[t - 1] + n]
            good, bad = ((1 - p) * bad_good + p * good_good) * odds[here], (1 - p) * bad_bad + p * good_bad
        else:
            good, bad = odds[here], 1.0
        forward[here] = good / (good + bad)
    for t in range(len(steps.active) - 1, -1, -1):
        n, begin = int(steps.active[t]), int(steps.bounds[t])
        backward[begin : begin + n] = 0.5
        if t + 1 < len(steps.active):
            m, after = int(steps.active[t + 1]), int(steps.bounds[t + 1])
            q, weight = backward[after : after + m], odds[after : after + m]
            if_good, if_bad = good_good * weight * q + good_bad * (1 - q), bad_good * weight * q + bad_bad * (1 - q)
            backward[begin : begin + m] = if_good / (if_good + if_bad)
            p = forward[begin : begin + m]
            joint = np.stack([(1 - p) * bad_bad * (1 - q), (1 - p) * bad_good * weight * q, p * good_bad * (1 - q), p * good_good * weight * q])
            expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    good = forward * backward
    result = np.empty(len(odds))
    result[steps.order] = good / (good + (1 - forward) * (1 - backward))
    return result, expected


@dataclass
class LineField:
    """Weights of the looks of lines, brought to one scale, and of transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    @classmethod
    def even(cls) -> "LineField":
        """Without labels of both kinds: every line is as likely good as bad."""
        return cls(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)))

    @classmethod
    def fit(cls, looks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> "LineField":
        """The weights of largest likelihood, held towards zero, by adaptive steps; ``labels`` are those of documents."""
        if not len(labels) or labels.min() == labels.max():
            return cls.even()
        raw = with_neighbours(looks, counts).astype(np.float64)
        mean, scale = raw.mean(axis=0), raw.std(axis=0)
        mean[-1], scale[-1] = 0.0, 1.0
        scale[scale < 1e-6] = 1.0
        x = (raw - mean) / scale
        steps, good = Steps(counts), np.repeat(labels, counts).astype(np.float64)
        stays = float((counts - 1)[labels == 0].sum()), float((counts - 1)[labels == 1].sum())
        seen = np.diag(stays)
        values = np.zeros(WIDTH + 4)
        first, second = np.zeros_like(values), np.zeros_like(values)
        for step in range(1, STEPS + 1):
            chance, expected = marginals(x @ values[:WIDTH], values[WIDTH:].reshape(2, 2), steps)
            slope = np.concatenate((x.T @ (good - chance), (seen - expected).ravel())) / len(labels) - PENALTY * values
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            pace = RATE * (1 - step / (STEPS + 1))
            values += pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(mean, scale, values[:WIDTH], values[WIDTH:].reshape(2, 2))

    def line_chances(self, looks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slopes = self.weights / self.scale
        evidence = with_neighbours(looks, counts) @ slopes.astype(np.float64) - self.mean @ slopes
        return marginals(evidence, self.transitions, Steps(counts))[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The length-weighted mean chance of each text's lines to be good."""
        if not texts:
            return np.zeros(0)
        looks, lengths, counts = line_features(texts)
        chances = self.line_chances(looks, counts)
        begins = np.cumsum(counts) - counts
        return np.add.reduceat(chances * lengths, begins) / np.add.reduceat(lengths, begins)


def held_out_fifth(doc_id: Column) -> Column:
    """Rows kept from learning: a fifth, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """(text, y): at most ``rows`` distinct texts with labels that are not held out, picked by hashes of ids and texts."""
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out_fifth(F.col("id")))
    marks = written(marks.groupBy("id").agg(F.max("y").alias("y")), "marks")
    share = min(1.0, 2 * rows / max(1, marks.count()))
    while True:  # bounded: at most four times as many labels as rows wanted go to all tasks
        picked = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))
        if picked.count() <= 4 * rows:
            break
        share /= 2
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    found = texts.filter(F.col("text").isNotNull()).join(F.broadcast(picked), "id").filter(lines <= TRAINING_LINES)
    distinct = found.groupBy("text").agg(F.max("y").alias("y"))
    return distinct.orderBy(F.xxhash64("text"), "text").limit(rows)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    training_rows: int = TRAINING_ROWS,
) -> LineField:
    """A field from at most ``training_rows`` labelled texts of at most ``TRAINING_LINES`` lines.

    Null texts, ids and labels are left out; an id, or a text, with two labels takes the larger. Without labels of
    both kinds every document scores 0.5.
    """
    chosen = written(training_texts(docs, labels, training_rows, id_column, text_column, label_column), "training", "zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                looks, _, counts = line_features(part.column(0).to_pylist())
                bounds = np.concatenate(([0], np.cumsum(counts))) * _OWN
                flat = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(looks.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([flat, pa.array(counts), part.column(1)], names=["looks", "n", "y"])

    with small_batches(docs.sparkSession):
        seen = chosen.mapInArrow(run, "looks array<float>, n long, y int").toPandas()  # bounded: rows x lines x looks
    if not len(seen):
        return LineField.even()
    return LineField.fit(np.concatenate(seen.looks.tolist()).reshape(-1, _OWN), seen.n.to_numpy(), (seen.y > 0).to_numpy().astype(int))


def line_quality(docs: DataFrame, field: LineField, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, score) of every row: the quality of its whole text; a null text is an empty one, a null id stays.

    An empty text is one empty line. Repeated rows are scored as often as they come. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores = shared.value.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, score double")
    return written(scored, "scored").withColumnRenamed("id", id_column)


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = line_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_fifth(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
