"""Operators over whole tables, on small tables and against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import decontamination, near_dedup, sharding, vector_search


def sentence(draw, words=60):
    return ["".join(draw.choice("bcdfghlmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3))) for _ in range(words)]


# ------------------------------------------------------------------ near copies


def bag(text, size=5):
    words = text.lower().split()
    size = min(size, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def classes_by_hand(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if a < b and x is not None and y is not None:
                p, q = bag(x), bag(y)
                both = sum((p & q).values())
                total = sum((p | q).values())
                if x == y or (total and both / total >= 0.8):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {i: root(i) for i, _ in rows}


@pytest.fixture(scope="module")
def copies():
    draw = random.Random(11)
    passage = sentence(draw, 55)
    rows = []
    for _ in range(12):
        base = sentence(draw, 120)
        rows.append(base)
        for edits in (0, 1, 2, 3, 5, 9):
            changed = list(base)
            for _ in range(edits):
                changed[draw.randrange(len(changed))] = "edited" + str(draw.randrange(10**6))
            rows.append(changed)
    # A passage that many texts share does not make them copies.
    rows += [passage + sentence(draw, 40) for _ in range(25)]
    rows += [["a", "b"], ["a", "b"], ["a", "c"], [], [], ["x"] * 30_000, ["x"] * 29_000]
    texts = [" ".join(r) for r in rows] + [None, None]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_classes_equal_brute_force(spark, copies):
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in copies], "doc_id long, text string, node int, key string").repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == classes_by_hand(copies)


def test_ids_missing_and_repeated(spark):
    rows = [(None, "same words in this text here"), (4, "same words in this text here"), (9, "same words in this text here"), (4, "another text"), (7, None)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["class_id"] or -1) for r in found) == [("4", 4), ("4", 4), ("7", 7), ("9", 4), ("None", -1)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("texts, words, edits", [(200, 300, (3, 5)), (500, 500, (6, 7))])
def test_many_texts_near_the_similarity(spark, texts, words, edits):
    """Most pairs lie just below 0.8: no link among them may be lost, whoever meets whom first."""
    draw = random.Random(texts)
    rows = []
    for i in range(texts):
        text = [f"b{k}" for k in range(words)]
        for _ in range(draw.randint(*edits)):
            text[draw.randrange(words)] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    units = [set(near_dedup.weight_units(near_dedup.shingles(t)).tolist()) for _, t in rows]
    links = [(i, j) for i in range(texts) for j in range(i) if len(units[i] & units[j]) >= 0.8 * len(units[i] | units[j])]
    classes = list(range(texts))
    for i, j in links:
        low, high = sorted((classes[i], classes[j]))
        classes = [low if c == high else c for c in classes]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(texts)] == classes and len(links) > texts


def test_agreement_of_pairs_at_the_similarity():
    least = near_dedup.least_agreement(112, 0.8)
    draws = np.random.default_rng(0).binomial(112, 0.8, 200_000)
    assert 60 < least < draws.min() + 8 and (draws >= least).all()


def test_a_long_chain_is_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    labels = near_dedup.components(links)
    assert {(r["node"], r["component"]) for r in labels.collect()} == {(i, 0) for i in range(201)} | {(900, 900), (901, 900)}
    more = near_dedup.components(spark.createDataFrame([(150, 901), (901, 950)], "a long, b long"), labels)
    assert {r["component"] for r in more.collect()} == {0} and more.count() == 204


def test_signatures_agree_as_often_as_weights():
    draw = random.Random(1)
    words = sentence(draw, 400)
    for changed in (0, 30, 150):
        other = words[changed:] + sentence(draw, changed)
        a, b = " ".join(words + words[:50]), " ".join(other + other[:50])
        exact = near_dedup.weighted_similarity(a, b)
        x, y = near_dedup.signature(a, 2000), near_dedup.signature(b, 2000)
        assert abs((x == y).mean() - exact) < 0.05
    short = near_dedup.weight_units(near_dedup.shingles("one two three four five six seven"))
    assert (near_dedup.dart_signature(short, 112) == near_dedup._few_units_signature(short, 112)).all()


# ------------------------------------------------------------- decontamination


def test_benchmark_windows_equal_brute_force(spark):
    draw = random.Random(21)
    items = [sentence(draw, n) for n in (8, 20, 33, 60, 120)] + [["too", "short"]]
    docs = []
    for kind in range(60):
        item = list(draw.choice(items[:5]))
        if kind % 4 == 1:
            item = item[: len(item) - draw.randint(0, 3)]
        if kind % 4 == 2:
            del item[draw.randrange(len(item))]
        if kind % 4 == 3:
            item.insert(draw.randrange(len(item)), "inserted")
        docs.append(sentence(draw, draw.randint(0, 50)) + (item if kind % 5 else []) + sentence(draw, draw.randint(0, 50)))
    texts = [", ".join(d).upper() for d in docs] + [None, "", "a b", " ".join(items[1] * 50)]
    rows = list(enumerate(texts)) + [(None, " ".join(items[0]))]
    benchmark = [(i, " ".join(t)) for i, t in enumerate(items)] + [(50, " ".join(items[2])), (51, None), (None, "x"), (52, "")]
    expected = {}
    for i, text in rows:
        words = [w for w in (text or "").lower().replace(",", " ").split()]
        for k, item in enumerate(items[:5]):
            wanted, n = bag(" ".join(item)), len(item)
            for start in range(max(1, len(words) - n + 1)):
                window = bag(" ".join(words[start : start + n])) if len(words) >= 5 else Counter()
                total = sum((window | wanted).values())
                value = sum((window & wanted).values()) / total
                if value >= 0.8:
                    expected[i, k] = max(expected.get((i, k), 0), round(value, 9))
    docs_df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, window string")
    found = decontamination.contamination(docs_df, spark.createDataFrame(benchmark, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == expected and len(expected) > 30
    assert decontamination.contamination(docs_df.limit(0), spark.createDataFrame(benchmark, "item_id long, text string")).count() == 0
    assert decontamination.contamination(docs_df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_windows_that_start_beside_every_alignment(spark):
    item = [f"w{i}" for i in range(1, 101)]
    other = [f"x{i}" for i in range(30)]
    cycle = (["p", "q", "r", "s", "p", "q", "r", "t"] * 6)[:45]
    docs = [other[:10] + item[:6] + other[10:13] + item[6:94] + item[97:] + other[13:23], other[:7] + cycle[3:] + cycle[:6] + other[7:], item[40:] + item[:40]]
    expected = {}
    for i, d in enumerate(docs):
        for k, t in enumerate((item, cycle)):
            values = []
            for start in range(max(1, len(d) - len(t) + 1)):
                window, wanted = bag(" ".join(d[start : start + len(t)])), bag(" ".join(t))
                values.append((sum((window & wanted).values()) / sum((window | wanted).values()), start))
            if (best := max(values)[0]) >= 0.8:
                expected[i, k] = (round(best, 9), {s for v, s in values if v == best})
    docs_df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    items_df = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(cycle))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contamination(docs_df, items_df).collect()}
    assert found.keys() == expected.keys() and (0, 0) in expected
    assert all(round(r["similarity"], 9) == expected[k][0] and r["start"] in expected[k][1] for k, r in found.items())


def test_close_fingerprints_share_a_block(spark):
    draw = random.Random(2)
    base = draw.getrandbits(63)
    rows = [(base, base ^ sum(1 << b for b in draw.sample(range(63), n))) for n in range(17) for _ in range(20)]
    df = spark.createDataFrame(rows, "a long, b long")
    shared = df.filter(F.arrays_overlap(decontamination.blocks(F.col("a"), 16), decontamination.blocks(F.col("b"), 16)))
    assert shared.count() == len(rows)


# -------------------------------------------------------------------- sharding


@pytest.mark.parametrize("rows, shards", [(0, 3), (1, 40), (39, 40), (1000, 7), (2500, 1)])
def test_shards_are_exact(spark, rows, shards):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("slot"))
    found = sharding.shuffle_into_shards(df, shards, ["doc_id", "text"], partition_rows=100).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(rows))
    held = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in range(shards)}
    sizes = [len(v) for v in held.values()]
    assert max(sizes) - min(sizes) <= 1 and all(v == list(range(len(v))) for v in held.values())


def test_shards_of_nulls_and_repeats(spark):
    rows = [(None, None)] * 5 + [(1, "a")] * 7 + [(2, None), (None, "b")]
    found = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4, ["doc_id", "text"]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, i) for s, n in enumerate((4, 4, 3, 3)) for i in range(n)]


def test_counts_follow_the_hypergeometric_law(spark):
    total, marked, drawn = 500, 120, 80
    draws = spark.range(4000).select(sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.rand(3)).alias("x")).toPandas().x
    mean = drawn * marked / total
    variance = mean * (1 - marked / total) * (total - drawn) / (total - 1)
    assert abs(draws.mean() - mean) < 4 * (variance / 4000) ** 0.5 and abs(draws.var() / variance - 1) < 0.15
    for case in ((9, 9, 4), (9, 0, 4), (9, 4, 9), (9, 4, 0), (1, 1, 1)):
        low = max(0, case[2] - (case[0] - case[1]))
        high = min(case[1], case[2])
        seen = {r["x"] for r in spark.range(200).select(sharding.hypergeometric(*map(F.lit, case), F.rand(1)).alias("x")).collect()}
        assert min(seen) >= low and max(seen) <= high


def test_matrix_sums(spark):
    counts = spark.createDataFrame([(0, 30), (1, 0), (3, 70)], "part long, n long")
    rows = {r["part"]: r["to_shard"] for r in sharding.communication_matrix(counts, 4, [34, 33, 33]).collect()}
    assert [sum(rows[p]) for p in range(4)] == [30, 0, 0, 70]
    assert [sum(rows[p][s] for p in range(4)) for s in range(3)] == [34, 33, 33]


# --------------------------------------------------------------- vector search


def nearest_by_hand(rows, query_ids, k=5):
    usable = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in query_ids:
        if q in usable:
            score = {i: float((v * usable[q]).sum() / (np.sqrt((v * v).sum()) * np.sqrt((usable[q] ** 2).sum()))) for i, v in usable.items() if i != q}
            out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 16))
    points = centres[draw.integers(0, 30, 3000)] + 0.4 * draw.normal(size=(3000, 16))
    rows = [(i, points[i].astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[50][1]) for i in range(400)]  # a group of equal vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in vector_search.nearest_neighbours(df, lambda i: i % 50 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    expected = nearest_by_hand(rows, [i for i, _ in rows if i % 50 == 0])
    assert found.keys() == expected.keys() and all(sorted(f) == [1, 2, 3, 4, 5] for f in found.values())
    hits = sum(len(set(found[q].values()) & set(expected[q])) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    assert list(found[50].values()) and sorted(found[50].values()) == [5000, 5001, 5002, 5003, 5004]
    assert sorted(found[5000].values()) == [50, 5001, 5002, 5003, 5004]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]),
        (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0]), (100, None),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in vector_search.nearest_neighbours(df, lambda i: i % 50 == 0).collect())
    assert found == [(0, 1, 50, 1.0), (0, 2, 1, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 0.0)]
    assert vector_search.nearest_neighbours(df.limit(0), lambda i: i % 50 == 0).count() == 0


# -------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from docweave.llm import piece_codec, pii, toxicity

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [(i, t) for i, t in zip(docs.doc_id, docs.text) if model.score(t) < toxicity.THRESHOLD]
    classes = classes_by_hand(kept)
    kept = [(i, t) for i, t in kept if classes[i] == i]
    items = [bag(" ".join(re.findall(r"[^\W_]+", t))) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
    clean = []
    for i, t in kept:
        words = re.findall(r"[^\W_]+", t.lower())
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        worst = 0.0
        for item in items:
            n = sum(item.values())
            if set(grams) & set(item):
                for start in range(max(1, len(grams) - n + 1)):
                    window = Counter(grams[start : start + n])
                    worst = max(worst, sum((window & item).values()) / sum((window | item).values()))
        if worst < 0.8:
            clean.append(i)
    assert sorted(rows) == sorted(clean)
    table = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id").isin(clean))
    texts = pii.private_spans(table).withColumn("text", pii.sanitised(F.col("text"), F.concat("pii_base", "pii_terms")))
    expected = {r["doc_id"]: r["ids_sha256"] for r in piece_codec.encode_decode(texts, digests=True).collect()}
    assert {i: r["ids_sha256"] for i, r in rows.items()} == expected
