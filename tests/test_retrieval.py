import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators import batch_retrieval as br
from docweave.operators import embedding as em
from docweave.operators import retrieval as rt
from docweave.operators.citations import build_citations
from docweave.operators.text_segments import TextSegments
from docweave.operators.vector_clusters import VectorClusters

TEXTS = ["alpha beta beta", "beta gamma", "Alpha, alpha! delta", "", "épsilon beta_1 gamma gamma", "beta gamma"]


@pytest.fixture(scope="module")
def chunks(spark):
    embedder = em.HashingEmbedder(16)
    rows = [(i, t, embedder.embed_query(t)) for i, t in enumerate(TEXTS)] + [(9, None, None), (10, "short", [1.0])]
    return spark.createDataFrame(rows, "id long, text string, embedding array<float>").cache()


def ranked(spark, rows, name="score"):
    return spark.createDataFrame([(i, float(s), r) for i, s, r in rows], "id string, score double, rank int")


def test_dense_is_exact(chunks):
    query = em.HashingEmbedder(16).embed_query("beta gamma")
    got = [(r["id"], round(r["cosine"], 6)) for r in rt.dense_top_k(chunks, query, 4).orderBy("rank").collect()]
    vectors = {r["id"]: np.array(r["embedding"]) for r in chunks.where("embedding is not null and size(embedding) = 16").collect()}
    cosine = {i: float(v @ query / ((np.linalg.norm(v) or 1) * np.linalg.norm(query))) for i, v in vectors.items()}
    best = sorted(cosine, key=lambda i: (-round(cosine[i], 9), i))[:4]
    assert [i for i, _ in got] == best
    assert got[0][1] == 1.0 and got[1][1] == 1.0


def test_bm25_against_the_formula(chunks):
    terms = [[w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()] for t in TEXTS] + [[], ["short"]]
    ids = [*range(6), 9, 10]
    mean = sum(map(len, terms[:6] + terms[7:])) / 7
    scores = {}
    for i, ws in zip(ids, terms):
        s = 0.0
        for q in ("alpha", "beta"):
            df = sum(q in w for w in terms)
            tf = ws.count(q)
            s += np.log(1 + (8 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        scores[i] = s
    got = rt.bm25_top_k(chunks.where("text is not null"), "Alpha beta?", 8).orderBy("rank").collect()
    assert {r["id"] for r in got} == {i for i, s in scores.items() if s > 0}
    single = {r["id"]: r["score"] for r in got}
    questions = chunks.sparkSession.createDataFrame([(1, "Alpha beta?"), (2, "nothing"), (3, None)], "query_id long, text string")
    batch = br.bm25_top_k(chunks.where("text is not null"), questions, 8).collect()
    assert {r["id"]: round(r["score"], 6) for r in batch} == {i: round(s, 6) for i, s in single.items()}
    assert rt.bm25_top_k(chunks, " ?! ", 8).collect() == []


def test_stored_index_agrees(spark, chunks, tmp_path):
    texts = chunks.where("text is not null")
    rt.TextIndex.write(texts, str(tmp_path))
    index = rt.TextIndex.read(spark, str(tmp_path))
    for query in ("alpha beta beta", "gamma", "absent", ""):
        a = [(r["id"], round(r["score"], 9)) for r in index.search(query, 3).orderBy("rank").collect()]
        b = [(r["id"], round(r["score"], 9)) for r in rt.bm25_top_k(texts, query, 3).orderBy("rank").collect()]
        assert a == b


def test_grown_index_equals_a_fresh_one(spark, tmp_path):
    draw = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    text = lambda n: " ".join(draw.choice(words, n, p=weight / weight.sum()))
    schema = "id string, doc_id long, text string"
    old = [(f"{d}:{c}", d, text(int(draw.integers(1, 60)))) for d in range(150) for c in range(2)]
    new = [(f"{d}:{c}", d, text(int(draw.integers(1, 60)))) for d in list(range(0, 40)) + list(range(150, 180)) for c in range(1 + d % 3)] + [("n", 500, None)]
    third = [(f"{d}:{c}", d, text(9)) for d in (1, 2, 160) for c in range(1)]
    index = TextSegments(spark, str(tmp_path / "grown"), range_docs=20)
    assert index.search("w1", 3).count() == 0
    living = {}
    for name, rows in (("a", old), ("b", new), ("c", third)):
        batch = spark.createDataFrame(rows, schema)
        index.add(batch, name)
        index.add(batch, name)  # a second time changes nothing
        living = {d: kept for d, kept in living.items() if d not in {r[1] for r in rows}}
        for row in rows:
            living.setdefault(row[1], []).append(row)
        fresh = spark.createDataFrame([r for kept in living.values() for r in kept], schema).withColumn("text", F.coalesce("text", F.lit("")))
        for query in ("w1 w2 w40", "w59 w59 w0", "w7", "w3 absent", "absent", ""):
            a = [(r["rank"], r["id"], round(r["score"], 9)) for r in index.search(query, 5).collect()]
            b = [(r["rank"], r["id"], round(r["score"], 9)) for r in rt.bm25_top_k(fresh, query, 5).collect()]
            assert sorted(a) == sorted(b), (name, query)
    assert len(index.segments()) == 3


def test_ranges_that_cannot_win_are_not_read(spark, tmp_path):
    index = TextSegments(spark, str(tmp_path / "skips"), range_docs=10)
    rows = [(i, i, "common " * (1 + i % 50) + ("rare " if i % 100 == 7 else "") + "filler " * (i % 37)) for i in range(600)]
    index.add(spark.createDataFrame(rows, "id long, doc_id long, text string"), "all")
    found = index.search("rare common", 3)
    got = [(r["id"], round(r["score"], 9)) for r in found.orderBy("rank").collect()]
    texts = spark.createDataFrame(rows, "id long, doc_id long, text string")
    assert got == [(r["id"], round(r["score"], 9)) for r in rt.bm25_top_k(texts, "rare common", 3).orderBy("rank").collect()]
    assert index.ranges_read < 30


def test_a_segment_that_was_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    index = TextSegments(spark, str(tmp_path / "cut"))
    batch = spark.createDataFrame([(1, 1, "one two"), (2, 2, "two three")], "id long, doc_id long, text string")
    index.add(batch, "whole")
    before = index.search("two", 5).collect()
    monkeypatch.setattr(TextSegments, "_living", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.add(spark.createDataFrame([(1, 1, "two two two")], "id long, doc_id long, text string"), "broken")
    monkeypatch.undo()
    assert index.search("two", 5).collect() == before and len(index.segments()) == 1


def test_clusters_that_cannot_win_are_not_read(spark, tmp_path):
    draw = np.random.default_rng(9)
    centers = draw.normal(size=(25, 12))
    points = centers[draw.integers(0, 25, 2000)] + 0.2 * draw.normal(size=(2000, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(5000, [0.0] * 12), (5001, None), (5002, [1.0, 2.0]), (5003, points[3].tolist())]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    layout = VectorClusters(spark, str(tmp_path / "vectors"))
    assert layout.search([1.0] * 12, 3).count() == 0
    layout.add(vectors.where("id < 1200"), clusters=30)
    layout.add(vectors.where("id >= 1200"), clusters=30)
    layout.add(vectors.limit(0))
    for query, few in ((points[3], True), (centers[7], True), (-points.mean(axis=0), False), (draw.normal(size=12), False)):
        before = layout.clusters_read
        got = [(r["rank"], r["id"], round(r["cosine"], 9)) for r in layout.search(query.tolist(), 5).collect()]
        expected = [(r["rank"], r["id"], round(r["cosine"], 9)) for r in rt.dense_top_k(vectors, query.tolist(), 5).collect()]
        assert sorted(got) == sorted(expected)
        if few:
            assert layout.clusters_read - before < 20 < len(layout.clusters(12))
    assert [r["id"] for r in layout.search([1.0, 2.0], 2).collect()] == [5002]
    # Fewer rows than asked for: all are found, the zero vector too.
    small = VectorClusters(spark, str(tmp_path / "small"))
    small.add(vectors.where("id IN (1, 2, 5000)"))
    assert {r["id"] for r in small.search((-points[1]).tolist(), 9).collect()} == {1, 2, 5000}


def test_batch_dense_agrees(chunks):
    embedder = em.HashingEmbedder(16)
    questions = [(i, embedder.embed_query(t)) for i, t in enumerate(["beta gamma", "delta", "alpha"])]
    batch = br.dense_top_k(chunks, questions, 3).collect()
    for q, vector in questions:
        one = [(r["rank"], r["id"]) for r in rt.dense_top_k(chunks, vector, 3).collect()]
        assert sorted((r["rank"], r["id"]) for r in batch if r["query_id"] == q) == sorted(one)


def test_question_slices_give_the_same(chunks, monkeypatch):
    embedder = em.HashingEmbedder(16)
    questions = [(i, embedder.embed_query(t)) for i, t in enumerate(["alpha", "beta", "gamma delta"])]
    whole = sorted(map(tuple, br.dense_top_k(chunks, questions, 3).collect()))
    monkeypatch.setattr(br, "SLICE_BYTES", 128)
    assert sorted(map(tuple, br.dense_top_k(chunks, questions, 3).collect())) == whole


def test_fusion_order_and_scores(spark):
    one = ranked(spark, [("a", 9, 1), ("b", 8, 2), ("", 7, 3), ("c", 6, 4)])
    two = ranked(spark, [("b", 3, 1), ("d", 2, 2)])
    rows = rt.reciprocal_rank_fusion(one, two).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "a", "d", "c"]
    assert rows[0]["score"] == 8 and abs(rows[0]["rrf_score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert abs(rows[3]["rrf_score"] - 1 / 64) < 1e-12
    tied = rt.reciprocal_rank_fusion(ranked(spark, [("x", 1, 1)]), ranked(spark, [("y", 1, 1)]), k=10).orderBy("rank")
    assert [r["id"] for r in tied.collect()] == ["x", "y"]


def test_modes(chunks):
    vector = em.HashingEmbedder(16).embed_query("delta")
    dense = rt.search(chunks, "delta", vector, "vector", 2).orderBy("rank").collect()
    assert [r["id"] for r in dense] == [r["id"] for r in rt.dense_top_k(chunks, vector, 2).orderBy("rank").collect()]
    assert rt.search(chunks.where("text is not null"), "delta", vector, "hybrid", 2).count() == 2


def test_context_merge_and_rendering(spark):
    rows = spark.createDataFrame(
        [(1, "a", "ta", "S", ""), (2, "", "x", "", ""), (3, "b", None, "", "ref"), (4, "a", "again", "S", ""), (5, "c", "tc", "", "")],
        "seq int, id string, text string, section string, code_ref string",
    )
    merged = rt.merge_context(rows, "seq", 2)
    assert [(r["id"], r["position"]) for r in merged.orderBy("position").collect()] == [("a", 1), ("b", 2)]
    assert rt.render_context(merged, 1).first()["context"] == "[1] (S) t\n\n[2] (ref) "


def test_citations(spark):
    chunks = spark.createDataFrame(
        [("c1", "d1", "S", None, ""), ("c2", "d1", "S", "", None), ("c3", "d2", "T", "7", "")],
        "id string, doc_id string, section string, clause string, code_ref string",
    )
    documents = spark.createDataFrame([("d1", "One", "code", "p1"), ("d2", None, "code", "p2")], "doc_id string, title string, doc_type string, source_path string")
    refs = spark.createDataFrame(
        [(0, "graph:traversal"), (1, None), (2, "c3"), (3, "nope"), (4, "c2"), (5, "c1"), (6, "c3"), (7, "")], "position int, chunk_id string"
    )
    rows = build_citations(refs, chunks, documents).orderBy("position").collect()
    assert [(r["position"], r["doc_id"], r["title"], r["section"], r["clause"]) for r in rows] == [(2, "d2", "", "T", "7"), (4, "d1", "One", "S", "")]


def test_hashed_vectors_agree(spark):
    texts = spark.createDataFrame([(1, "Alpha beta alpha"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["embedding"] for r in em.hashed_vectors(texts, 8).collect()}
    assert rows[1] == pytest.approx(em.HashingEmbedder(8).embed_query("Alpha beta alpha"), abs=1e-6) and rows[2] == rows[3] == [0.0] * 8


def test_embedding_width(spark):
    em.check_dimension(em.HashingEmbedder(8), 8)
    with pytest.raises(ValueError, match="8 numbers"):
        em.check_dimension(em.HashingEmbedder(8), 9)
    with pytest.raises(ValueError):
        EngineConfig(embedding_dim=5000)
    texts = spark.createDataFrame([("a b",), ("",)], "text string")
    out = em.embed_chunks(texts, lambda: em.HashingEmbedder(8), EngineConfig(embedding_dim=8)).collect()
    assert [len(r["embedding"]) for r in out] == [8, 8]


def test_large_question_sets_are_answered_in_parts(spark, chunks, monkeypatch, tmp_path):
    embedder = em.HashingEmbedder(16)
    rows = [(i, embedder.embed_query(t)) for i, t in enumerate(["alpha", "beta", "gamma", "delta"])]
    questions = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    answer = lambda rows: br.dense_top_k(chunks, [tuple(r) for r in rows], 3)
    whole = sorted(map(tuple, br.answer_all(questions, answer).collect()))
    monkeypatch.setattr(br, "QUESTIONS_AT_ONCE", 2)
    parts = br.answer_all(questions, answer, str(tmp_path / "answers"))
    assert sorted(map(tuple, parts.select("query_id", "id", "score", "rank").collect())) == whole
    assert len({q for q, *_ in whole}) == 4


def test_hot_run_keeps_whole_results(spark):
    """A third of all rows in one run: same result as a plain loop."""
    rows = [("hot" if i % 3 == 0 else f"r{i % 50}", i, str(i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, seq long, id string").repartition(7)
    expected = {}
    for run, seq, id_ in rows:
        seen = expected.setdefault(run, [])
        if id_ not in seen:
            seen.append(id_)
    got = {}
    for r in rt.merge_context(df, "seq", 24, by=["run"]).orderBy("run", "position").collect():
        got.setdefault(r["run"], []).append(r["id"])
    assert got == {run: ids[:24] for run, ids in expected.items()}


def test_segments_come_in_the_order_they_were_added(spark, tmp_path):
    index = TextSegments(spark, str(tmp_path / "order"))
    batches = [f"batch{n}" for n in range(6)]
    for batch in batches:
        row = spark.createDataFrame([(batch, batch, 0, 0, 0, 0)], "segment string, batch string, n_docs long, n_words long, dead_docs long, dead_words long")
        row.coalesce(1).write.mode("append").parquet(f"{index.path}/segments")
    assert [s["batch"] for s in index.segments()] == batches


def test_words_of_a_text_are_sorted_without_a_comparison_per_pair(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "ä", "B"],), ([],)], "toks array<string>")
    counted = rows.select(rt.term_frequencies(F.col("toks")).alias("e"))
    assert "array_sort(" not in counted._jdf.queryExecution().optimizedPlan().toString()  # compares by an expression that is not compiled
    assert [r["e"] and [tuple(e) for e in r["e"]] for r in counted.collect()] == [[("B", 1), ("a", 1), ("b", 2), ("ä", 1)], None]


def test_words_are_counted_in_every_text_of_a_large_batch(spark):
    texts = [None if i % 11 == 0 else " ".join(["alpha"] * (i % 3) + ["beta", f"w{i}"] * (i % 2) + ["É_1"]) for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    counts = br.question_counts(rows, ["alpha", "beta", "é_1"])
    found = {r["id"]: (r["length"], dict(zip(r["terms"], r["tfs"]))) for r in counts.collect()}
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        assert found[i] == (len(words), {n: words.count(w) for n, w in enumerate(["alpha", "beta", "é_1"]) if w in words})


class OneBatch:
    """Stands for a table of texts: hands over the function that a task would run."""

    def __init__(self, rows):
        self.schema = rows.schema

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_a_task_holds_the_words_of_a_few_texts_only(spark):
    rows = spark.createDataFrame([], "id long, text string")
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["a b"] * 1000})
    out = list(br.question_counts(OneBatch(rows), ["a"])(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= br.TEXTS_AT_ONCE < 1000
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(1000))
    assert {tuple(x) for b in out for x in b.column("terms").to_pylist()} == {(0,)} and {n for b in out for n in b.column("length").to_pylist()} == {2}
