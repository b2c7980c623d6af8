"""The field of lines against enumeration of all labellings, looks against plain counts, and held-out accuracy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import line_quality as lq


def enumerated(evidence, transitions):
    """(chances to be good, expected transitions, logarithm of the sum) over all labellings of one document."""
    total, chances, moves = 0.0, np.zeros(len(evidence)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=len(evidence)):
        weight = math.exp(sum(e for e, y in zip(evidence, labels) if y) + sum(transitions[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        chances += weight * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            moves[a, b] += weight
    return chances / total, moves / total, math.log(total)


def test_passes_equal_enumeration():
    draw = np.random.default_rng(1)
    counts = np.array([3, 1, 6, 6, 2, 9])
    evidence, transitions = draw.normal(size=counts.sum()) * 2, draw.normal(size=(2, 2)) * 2
    chances, moves = lq.marginals(evidence, transitions, lq.Steps(counts))
    wanted = [enumerated(part, transitions) for part in np.split(evidence, np.cumsum(counts)[:-1])]
    assert np.allclose(chances, np.concatenate([w[0] for w in wanted])) and np.allclose(moves, sum(w[1] for w in wanted))
    none, nothing = lq.marginals(np.zeros(0), transitions, lq.Steps(np.zeros(0, dtype=np.int64)))
    assert len(none) == 0 and not nothing.any()


def test_a_fit_is_where_no_step_gains(monkeypatch):
    monkeypatch.setattr(lq, "STEPS", 1500)
    draw = np.random.default_rng(2)
    counts = draw.integers(1, 6, 60)
    looks = draw.normal(size=(counts.sum(), lq._OWN)).astype(np.float32)
    labels = (np.add.reduceat(looks[:, 0], np.cumsum(counts) - counts) + draw.normal(size=60) > 0).astype(int)
    field = lq.LineField.fit(looks, counts, labels)
    x = (lq.with_neighbours(looks, counts) - field.mean) / field.scale

    def likelihood(values):
        total = -lq.PENALTY / 2 * (values**2).sum() * len(labels)
        for part, y in zip(np.split(x @ values[: lq.WIDTH], np.cumsum(counts)[:-1]), labels):
            t = values[lq.WIDTH :].reshape(2, 2)
            total += part.sum() * y + (len(part) - 1) * t[y, y] - enumerated(part, t)[2]
        return total

    best = np.concatenate((field.weights, field.transitions.ravel()))
    assert likelihood(best) > likelihood(np.zeros_like(best)) + 10
    for _ in range(10):
        assert likelihood(best) >= likelihood(best + 0.02 * draw.normal(size=len(best))) - 1e-2


def test_looks_of_lines():
    texts = ["Two Two ok.\n\nAB!! 12 ñÉ", "", "same\nsame\nsame\n"]
    looks, lengths, counts = lq.line_features(texts)
    assert counts.tolist() == [3, 1, 4] and lengths.tolist() == [12, 1, 11, 1, 5, 5, 5, 1]
    seen = [dict(zip(lq.FEATURES, row)) for row in looks.tolist()]
    assert seen[0]["repeated_words"] == seen[0]["stuttered_words"] == pytest.approx(1 / 3) and seen[0]["ends_sentence"] == seen[0]["begins_large"] == 1
    assert seen[0]["stops"] == seen[0]["capitals"] / 2 == pytest.approx(1 / 11) and seen[0]["few_words"] == 1
    assert seen[1]["empty"] == seen[3]["empty"] == 1 and seen[1]["words"] == 0 and not seen[1]["repeated_line"]
    assert seen[2]["capitals"] == seen[2]["signs"] == seen[2]["digits"] == seen[2]["wide"] == pytest.approx(0.2)
    assert [s["repeated_line"] for s in seen] == [0, 0, 0, 0, 0, 1, 1, 0] and seen[4]["one_word"] == 1
    wide = lq.with_neighbours(looks, counts)
    for line, (before, after) in enumerate([(None, 1), (0, 2), (1, None), (None, None), (None, 5), (4, 6), (5, 7), (6, None)]):
        for part, other in ((1, before), (2, after)):
            assert (wide[line, part * lq._OWN : (part + 1) * lq._OWN] == (0 if other is None else looks[other])).all()
        assert wide[line, -3:].tolist() == [before is None, after is None, 1]


def test_texts_score_alike_in_any_company():
    draw = np.random.default_rng(3)
    field = lq.LineField(np.zeros(lq.WIDTH), np.ones(lq.WIDTH), draw.normal(size=lq.WIDTH), draw.normal(size=(2, 2)))
    texts = ["a b c\nd e", "", "x\n" * 3000, "Last one here.", "a b c\nd e"]
    together = field.scores(texts)
    assert np.allclose(together, [field.scores([t])[0] for t in texts]) and ((0 <= together) & (together <= 1)).all()
    looks, lengths, counts = lq.line_features(texts[:1])
    chances = enumerated(lq.with_neighbours(looks, counts) @ field.weights, field.transitions)[0]
    by_hand = (chances * lengths).sum() / lengths.sum()
    assert together[0] == pytest.approx(by_hand, rel=1e-5)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = lq.op11_line_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right[0] > 0.95 and right[1] > 50


def test_odd_rows(spark):
    rows = [(i, ("good words in a line.\n" if i % 2 else "BAD!! BAD!!\n") * (1 + i % 3), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (3, 0, 0), (999, 1, 0)], "doc_id long, quality int, text int")
    field = lq.fit(docs, labels)
    odd = spark.createDataFrame([(None, "good words in a line."), (7, None), (8, ""), (8, ""), (9, "BAD!! BAD!!")], "doc_id long, text string")
    scores = {(r["doc_id"], i): r["score"] for i, r in enumerate(sorted(lq.line_quality(odd, field).collect(), key=str))}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values())
    by_id = {i: s for (i, _), s in scores.items()}
    assert by_id[None] > 0.5 > by_id[9] and by_id[7] == by_id[8]
    assert lq.line_quality(odd.limit(0), field).count() == 0
    for nothing in (lq.fit(docs, labels.filter("quality = 1")), lq.fit(docs.limit(0), labels), lq.fit(docs, labels.limit(0))):
        assert {r["score"] for r in lq.line_quality(odd, nothing).collect()} == {0.5}
    assert lq.training_texts(docs, labels, 3, "doc_id", "text", "quality").count() == 3


def test_long_texts_are_scored_whole():
    field = lq.LineField(np.zeros(lq.WIDTH), np.ones(lq.WIDTH), np.zeros(lq.WIDTH), np.zeros((2, 2)))
    field.weights[lq.FEATURES.index("signs")] = -20.0
    assert field.scores(["word " * 30_000 + "\n" + "!!!!! " * 30_000])[0] == pytest.approx(0.5 * 5 / 11, abs=0.001)
