"""Registered queries of retrieval, fusion, contexts and citations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.catalog.corpora import table
from docweave.catalog.registry import hard_split_sql, query
from docweave.operators import batch_retrieval as br
from docweave.operators import chunking as ck
from docweave.operators import retrieval as rt
from docweave.operators.citations import build_citations
from docweave.operators.embedding import HashingEmbedder, hashed_totals
from docweave.operators.text_segments import TextSegments
from docweave.operators.vector_clusters import VectorClusters
from docweave.session import shared_folder

# The question every single-question query asks, and its vector in the tables' width.
QUESTION = "the thation of ereach, que la mentaire"
WIDTH = 64
VECTOR = HashingEmbedder(WIDTH).embed_query(QUESTION)
K = 8
RRF_K = 60

_VECTOR_SQL = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"
DENSE_SQL = f"""
scored AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR_SQL}) AS cosine FROM embeddings),
dense AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank
          FROM (SELECT id, cosine, (1 + cosine) / 2 AS score FROM scored WHERE cosine IS NOT NULL) QUALIFY rank <= {K})"""

# The same over the vectors of documents only.
OF_DOCUMENTS = (" FROM embeddings)", " FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")

_TERMS = rt.query_terms(QUESTION)
_TERM_ROWS = ", ".join(f"('{t}', {n})" for t, n in sorted(_TERMS.items()))
TOKENS_SQL = """toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ts FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM toks)"""
SPARSE_SQL = f"""
{TOKENS_SQL},
terms(term, weight) AS (VALUES {_TERM_ROWS}),
tf AS (SELECT id, len(ts) AS length, term, weight, len(list_filter(ts, lambda t: t = term)) AS tf FROM toks, terms),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
weighted AS (SELECT id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score
             FROM tf JOIN df USING (term), corpus WHERE tf > 0 GROUP BY id),
sparse AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM weighted QUALIFY rank <= {K})"""
FUSED_SQL = f"""{DENSE_SQL},{SPARSE_SQL},
lists AS (SELECT id, score, 0 AS list, rank FROM dense UNION ALL SELECT id, score, 1, rank FROM sparse),
sums AS (SELECT id, sum(1.0::DOUBLE / ({RRF_K} + rank)) AS rrf_score, arg_min(score, list * 1000 + rank) AS score,
           min(list * 1000 + rank) AS seen FROM lists GROUP BY id),
fused AS (SELECT *, row_number() OVER (ORDER BY round(rrf_score, 12) DESC, seen) AS rank FROM sums)"""
FUSED_CHUNKS_SQL = FUSED_SQL.replace(*OF_DOCUMENTS)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _chunks(spark, sf_dir):
    """Documents as chunks with vectors; not every document has one."""
    return _texts(spark, sf_dir).join(_vectors(spark, sf_dir), "id", "left")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {DENSE_SQL} SELECT id, round(cosine, 6) AS cosine, round(score, 6) AS score, rank FROM dense")
def dense_top_k(spark, sf_dir):
    return _rounded(rt.dense_top_k(_vectors(spark, sf_dir), VECTOR, K), "cosine", "score")


@query(f"WITH {DENSE_SQL} SELECT id, round(cosine, 6) AS cosine, round(score, 6) AS score, rank FROM dense")
def clustered_top_k(spark, sf_dir):
    """The vectors laid out by cluster in two parts, then searched; most clusters are not read."""
    vectors = _vectors(spark, sf_dir)
    layout = VectorClusters(spark, f"{shared_folder(spark).rstrip('/')}/docweave/vectors-{uuid.uuid4().hex}")
    half = F.col("embedding")[0] > 0
    layout.add(vectors.where(half))
    layout.add(vectors.where(~half | half.isNull()))
    return _rounded(layout.search(VECTOR, K), "cosine", "score")


@query(f"WITH {SPARSE_SQL} SELECT id, round(score, 6) AS score, rank FROM sparse")
def bm25_top_k(spark, sf_dir):
    return _rounded(rt.bm25_top_k(_texts(spark, sf_dir), QUESTION, K), "score")


@query(f"WITH {SPARSE_SQL} SELECT id, round(score, 6) AS score, rank FROM sparse")
def stored_index_search(spark, sf_dir):
    """K6, R2: the full-text index written to the shared folder, then searched there."""
    path = f"{shared_folder(spark).rstrip('/')}/docweave/index-{uuid.uuid4().hex}"
    rt.TextIndex.write(_texts(spark, sf_dir), path)
    return _rounded(rt.TextIndex.read(spark, path).search(QUESTION, K), "score")


@query(f"WITH {SPARSE_SQL} SELECT id, round(score, 6) AS score, rank FROM sparse")
def segmented_index_search(spark, sf_dir):
    """K6, R2: an index grown by two batches; the second replaces the German and French documents, stale in the first."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "doc_id", "lang", "text")
    moved = F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False))
    index = TextSegments(spark, f"{shared_folder(spark).rstrip('/')}/docweave/segments-{uuid.uuid4().hex}")
    stale = F.concat(F.lit(QUESTION + " "), F.coalesce("text", F.lit("")))
    index.add(texts.withColumn("text", F.when(moved, stale).otherwise(F.col("text"))), "first")
    index.add(texts.where(moved), "second")
    return _rounded(index.search(QUESTION, K), "score")


@query(
    f"WITH {FUSED_SQL} SELECT id, round(score, 6) AS score, round(rrf_score, 6) AS rrf_score, rank FROM fused"
)
def fused_top_k(spark, sf_dir):
    dense = rt.dense_top_k(_vectors(spark, sf_dir), VECTOR, K)
    sparse = rt.bm25_top_k(_texts(spark, sf_dir), QUESTION, K)
    return _rounded(rt.reciprocal_rank_fusion(dense, sparse, k=RRF_K), "score", "rrf_score")


@query(
    f"""WITH {FUSED_CHUNKS_SQL} SELECT 'hybrid' AS mode, id, round(score, 6) AS score, rank FROM fused WHERE rank <= {K}
        UNION ALL SELECT 'vector', id, round(score, 6), rank FROM dense"""
)
def retrieval_modes(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    found = [
        rt.search(chunks, QUESTION, VECTOR, mode, K, RRF_K).select(F.lit(mode).alias("mode"), "id", "score", "rank")
        for mode in ("hybrid", "vector")
    ]
    return _rounded(found[0].unionByName(found[1]), "score")


@query(
    f"""WITH {SPARSE_SQL} SELECT sha256(string_agg('[' || rank || '] (' || coalesce(nullif(source, ''), CAST(id AS VARCHAR))
           || ') ' || text, chr(10) || chr(10) ORDER BY rank)) AS digest
        FROM sparse JOIN documents ON doc_id = id"""
)
def rendered_context(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("section"),
        F.lit("").alias("clause"), F.lit(None).cast("string").alias("code_ref"),
    )
    top = rt.fetch_chunks(rt.bm25_top_k(chunks, QUESTION, K), chunks)
    text = rt.render_context(rt.merge_context(top, "rank"))
    return text.select(F.sha2("context", 256).alias("digest"))


@query(
    f"""WITH {TOKENS_SQL}, entries AS (SELECT id, unnest(ts) AS term FROM toks),
        counted AS (SELECT id, term, count(*) AS tf FROM entries GROUP BY id, term)
        SELECT term, CAST(count(*) AS BIGINT) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences,
               CAST(max(tf) AS BIGINT) AS most FROM counted GROUP BY term"""
)
def index_terms(spark, sf_dir):
    """K6: the postings of the whole corpus, summed up per term."""
    return rt.postings(_texts(spark, sf_dir)).groupBy("term").agg(
        F.count("*").alias("documents"),
        F.sum("tf").cast("long").alias("occurrences"),
        F.max("tf").cast("long").alias("most"),
    )


GOLDEN_SPARSE_SQL = f"""q AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ts FROM benchmark),
        qt AS (SELECT item_id, term, count(*) AS weight FROM (SELECT item_id, unnest(ts) AS term FROM q) GROUP BY ALL),
        {TOKENS_SQL},
        tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM toks) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        scores AS (SELECT item_id, tf.id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5))
             * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(ts) / mean))), 9) AS score
           FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN toks ON toks.id = tf.id, corpus GROUP BY ALL)"""


@query(
    f"""WITH {GOLDEN_SPARSE_SQL}
        SELECT item_id AS query_id, id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank
        FROM scores QUALIFY rank <= {K}"""
)
def golden_bm25(spark, sf_dir):
    """Every benchmark item as a question, answered in one pass over the documents."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    texts = _texts(spark, sf_dir)
    return _rounded(br.bm25_top_k(texts, questions, K), "score")


@query(
    f"""WITH {GOLDEN_SPARSE_SQL},
        sparse AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= {K}),
        near AS (SELECT q.vec_id AS item_id, e.vec_id AS id, round((1 + list_cosine_similarity(
              CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2, 9) AS score
            FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
        dense AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= {K}),
        lists AS (SELECT *, 0 AS list FROM dense UNION ALL SELECT *, 1 FROM sparse),
        sums AS (SELECT item_id, id, sum(1.0::DOUBLE / ({RRF_K} + rank)) AS rrf_score, arg_min(score, list * 1000 + rank) AS score,
                   min(list * 1000 + rank) AS seen FROM lists GROUP BY item_id, id)
        SELECT item_id AS query_id, id, round(score, 6) AS score, round(rrf_score, 6) AS rrf_score,
               row_number() OVER (PARTITION BY item_id ORDER BY round(rrf_score, 12) DESC, seen) AS rank
        FROM sums QUALIFY rank <= {K}"""
)
def golden_hybrid(spark, sf_dir):
    """E3 in hybrid mode for the whole question set; an item's vector is the one with its number."""
    questions = (
        table(spark, sf_dir, "benchmark")
        .join(table(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id"), "left")
        .select(F.col("item_id").alias("query_id"), "text", "embedding")
    )
    chunks = _chunks(spark, sf_dir)
    return _rounded(br.hybrid_top_k(chunks, questions, K, RRF_K), "score", "rrf_score")


@query(
    f"""WITH dims AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x,
            generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d),
        centers AS (SELECT label, list(x ORDER BY d) AS center FROM dims GROUP BY label),
        scores AS (SELECT c.label AS query_id, vec_id AS id,
            round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), center)) / 2, 9) AS score FROM embeddings, centers c)
        SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM scores QUALIFY rank <= {K}"""
)
def golden_dense(spark, sf_dir):
    """The mean vector of every label as a question, answered in one pass over the vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    centers = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))
    questions = centers.select(
        F.col("label").cast("long").alias("query_id"), F.transform("c", lambda e: e["x"]).alias("center")
    )
    chunks = _vectors(spark, sf_dir)
    found = br.answer_all(questions, lambda rows: br.dense_top_k(chunks, [tuple(r) for r in rows], K))
    return _rounded(found, "score")


@query(
    """SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY first, id) AS position FROM (
         SELECT user_id, CAST(floor(value) AS BIGINT) AS id, min(event_id) AS first FROM events
         WHERE value IS NOT NULL GROUP BY ALL)"""
)
def merged_contexts(spark, sf_dir):
    """R5 per user: the event value's whole part stands for the chunk found, the event for the order."""
    found = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("id"), "event_id")
    merged = rt.merge_context(found, "event_id", by=["user_id"])
    return merged.select("user_id", "id", F.col("position").cast("long").alias("position"))


def _window_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    pieces = F.transform(
        ck.hard_split(F.col("text"), 900, 150),
        lambda w, i: F.struct(
            F.concat(F.lit("Part "), F.floor(i / 2).cast("string")).alias("section"),
            F.lit("").alias("clause"),
            F.lit(None).cast("string").alias("code_ref"),
            w.alias("text"),
        ),
    )
    return ck.explode_chunks(docs, pieces, "doc_id")


def _titled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("doc_type"),
        F.concat(F.lit("data/"), "source", F.lit(".md")).alias("source_path"),
    )


@query(
    f"""WITH windows AS (SELECT doc_id, unnest({hard_split_sql('text')}) AS w,
            generate_subscripts({hard_split_sql('text')}, 1) - 1 AS i FROM documents),
        chunks AS (SELECT sha256(doc_id || ':' || i) AS id, doc_id, 'Part ' || (i // 2) AS section FROM windows),
        refs AS (SELECT user_id, event_id AS position, CASE event_type WHEN 'error' THEN 'graph:traversal' WHEN 'signup' THEN ''
            ELSE sha256((event_id // 10) || ':' || (CAST(json_extract_string(props, '$.k') AS INT) % 4)) END AS chunk_id FROM events),
        places AS (SELECT user_id, min(position) AS position, doc_id, section FROM refs JOIN chunks ON id = chunk_id
                   WHERE chunk_id <> '' AND chunk_id NOT LIKE 'graph:%' GROUP BY user_id, doc_id, section)
        SELECT user_id, position, CAST(p.doc_id AS VARCHAR) AS doc_id, 'Document ' || p.doc_id AS title, lang AS doc_type,
               'data/' || source || '.md' AS source_path, section, '' AS clause, '' AS code_ref
        FROM places p JOIN documents d ON d.doc_id = p.doc_id"""
)
def citations(spark, sf_dir):
    """R7 for every user's events: repeated, graph, empty and unknown references included."""
    kind = F.col("event_type")
    known = ck.chunk_id(
        F.floor(F.col("event_id") / 10), F.get_json_object("props", "$.k").cast("int") % 4
    )
    references = table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("position"),
        F.when(kind == "error", "graph:traversal").when(kind == "signup", "").otherwise(known).alias("chunk_id"),
    )
    return build_citations(references, _window_chunks(spark, sf_dir), _titled_documents(spark, sf_dir), by=["user_id"])


@query(
    f"""WITH {FUSED_CHUNKS_SQL} SELECT rank, round(score, 6) AS score, round(rrf_score, 6) AS rrf_score,
          CAST(id AS VARCHAR) AS doc_id, 'Document ' || id AS title, lang AS doc_type, 'data/' || source || '.md' AS source_path
        FROM fused JOIN documents ON doc_id = id WHERE rank <= {K}"""
)
def cited_retrieval(spark, sf_dir):
    """The flagship: hybrid search over the documents, each hit with its citation."""
    chunks = _chunks(spark, sf_dir)
    top = rt.pin(rt.search(chunks, QUESTION, VECTOR, "hybrid", K, RRF_K))
    located = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        *[F.lit("").alias(c) for c in ("section", "clause", "code_ref")],
    )
    hits = top.withColumn("id", F.col("id").cast("string"))
    cited = build_citations(
        F.broadcast(hits.select(F.col("id").alias("chunk_id"), F.col("rank").alias("position"))), located, _titled_documents(spark, sf_dir)
    )
    scored = hits.select("rank", "score", "rrf_score").join(
        cited.withColumnRenamed("position", "rank"), "rank"
    )
    return _rounded(scored, "score", "rrf_score").select(
        "rank", "score", "rrf_score", "doc_id", "title", "doc_type", "source_path"
    )


@query(
    f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
        codes AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS code FROM words),
        sums AS (SELECT doc_id, code % {WIDTH} AS bucket, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS total FROM codes GROUP BY ALL),
        filled AS (SELECT d.doc_id, b.bucket, CAST(coalesce(total, 0) AS BIGINT) AS total
                   FROM documents d CROSS JOIN (SELECT range AS bucket FROM range({WIDTH})) b LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.bucket = b.bucket)
        SELECT doc_id, count(*) AS width, sha256(string_agg(CAST(total AS VARCHAR), ',' ORDER BY bucket)) AS digest FROM filled GROUP BY doc_id"""
)
def embedded_documents(spark, sf_dir):
    """L1: the offline embedder over all documents, its signed word counts as a digest."""
    totals = hashed_totals(table(spark, sf_dir, "documents").select("doc_id", "text"), WIDTH)
    joined = F.array_join(F.transform("totals", lambda t: t.cast("string")), ",")
    return totals.select("doc_id", F.size("totals").cast("long").alias("width"), F.sha2(joined, 256).alias("digest"))
