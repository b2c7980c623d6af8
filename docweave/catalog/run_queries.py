"""Registered queries of runs, traces and evaluation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docweave.catalog.corpora import table
from docweave.catalog.graph_queries import trade_graph
from docweave.catalog.registry import WS, hard_split_sql, query
from docweave.catalog.retrieval_queries import GOLDEN_SPARSE_SQL, K, RRF_K, WIDTH, _chunks, _titled_documents, _window_chunks
from docweave.config import EngineConfig
from docweave.operators.embedding import HashingEmbedder
from docweave.plans import evaluation, runs
from docweave.plans.graph_schema import GraphSchema
from docweave.plans.llm import Reply
from docweave.plans.question_runs import QuestionRuns


@query(
    """SELECT user_id, arg_min(event_type, event_id) AS first_step, arg_max(event_type, event_id) AS last_step,
              CAST(count(*) AS BIGINT) AS events FROM events GROUP BY user_id"""
)
def trace_summaries(spark, sf_dir):
    return runs.trace_summary(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query(
    """SELECT event_type, CAST(sum(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) AS BIGINT) AS micros, CAST(count(*) AS BIGINT) AS n
       FROM events GROUP BY event_type"""
)
def stage_times(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), F.lit("2024-01-01 00:00:00 UTC").cast("timestamp").alias("start")
    )
    # The tables hold times without a zone; both ends are read in the session's.
    shift = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) - F.unix_micros("start")
    events = events.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - shift))
    return runs.stage_seconds(events, "event_type", "start", "ts")


@query(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'hybrid' ELSE 'vector' END AS mode,
            CASE role WHEN 'user' THEN 'lookup' WHEN 'system' THEN 'compliance-mapping' ELSE 'relationship' END AS route,
            CASE WHEN role = 'user' THEN 'Sufficient. ' || text ELSE 'insufficient: ' || text END AS reply, turn + 1 AS iterations FROM conversations),
       j AS (SELECT *, iterations >= 3 AS capped, iterations < 3 AND reply LIKE 'Sufficient.%' AS sufficient FROM s)
       SELECT conv_id, turn, CASE WHEN mode = 'hybrid' AND route <> 'lookup' THEN 'traverse' ELSE 'sufficiency' END AS after_retrieve,
              sufficient, capped, CASE WHEN capped THEN 'hard cap of 3 iterations reached' WHEN sufficient THEN ''
                               ELSE reply END AS note,
              CASE WHEN sufficient OR capped THEN 'synthesize' ELSE 'retrieve' END AS after_sufficiency FROM j"""
)
def loop_outcomes(spark, sf_dir):
    role, mode = F.col("role"), F.when(F.col("turn") % 2 == 0, "hybrid").otherwise("vector")
    route = F.when(role == "user", "lookup").when(role == "system", "compliance-mapping").otherwise("relationship")
    reply = F.concat(F.when(role == "user", "Sufficient. ").otherwise("insufficient: "), F.col("text"))
    turns = table(spark, sf_dir, "conversations")
    iterations = F.col("turn") + 1
    sufficient, capped = runs.is_sufficient(reply, iterations), runs.is_capped(iterations)
    return turns.select(
        "conv_id",
        "turn",
        runs.after_retrieve(route, mode).alias("after_retrieve"),
        sufficient.alias("sufficient"),
        capped.alias("capped"),
        runs.judge_note(reply, iterations).alias("note"),
        runs.after_sufficiency(sufficient, capped).alias("after_sufficiency"),
    )


@query(
    """WITH f AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS id FROM lineitem),
       c AS (SELECT l_suppkey AS run, l_partkey AS id, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
       SELECT f.run, f.id, coalesce(c.score, 0.0) AS score FROM f LEFT JOIN c USING (run, id)"""
)
def retrieve_details(spark, sf_dir):
    """Suppliers as runs, their parts as found chunks, returned lines as the context."""
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "run", "l_partkey": "id"})
    context = lines.where(F.col("l_returnflag") == "A").groupBy("run", "id").agg(F.max("l_extendedprice").alias("score"))
    return runs.retrieve_details(lines.select("run", "id").distinct(), context, ["run"])


@query(
    f"""WITH windows AS (SELECT doc_id, lang, unnest({hard_split_sql('text')}) AS w FROM documents),
        numbered AS (SELECT doc_id, lang, w FROM windows),
        judged AS (SELECT n.*, l.toxic = 1 AS failed FROM numbered n LEFT JOIN labels l USING (doc_id))
        SELECT lang AS doc_type, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS chunks,
               CAST(count(*) FILTER (failed) AS BIGINT) AS failed_chunks FROM judged GROUP BY lang"""
)
def ingest_counters(spark, sf_dir):
    """A2: windows as chunks; the extraction of a toxic document's chunks counts as failed."""
    types = _titled_documents(spark, sf_dir).select("doc_id", "doc_type")
    chunks = _window_chunks(spark, sf_dir).select("id", "doc_id").join(types, "doc_id")
    toxic = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("toxic") == 1, "refused").otherwise("").alias("error")
    )
    return runs.ingest_counters(chunks, chunks.join(toxic, "doc_id").select("id", "error"))


SCORED_SQL = """
expected AS (SELECT c_custkey % 200 AS user_id, c_custkey AS expectation, 'DOCUMENT ' || (c_custkey % 97) AS phrase,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS clause FROM customer),
cited AS (SELECT user_id, event_id AS position, 'Document ' || (event_id % 1000) AS title, event_type AS section,
            CAST(event_id % 25 AS VARCHAR) AS clause FROM events),
matched AS (SELECT e.user_id, e.expectation, arg_min(c.section, c.position) AS section FROM expected e JOIN cited c
            ON c.user_id = e.user_id AND contains(lower(c.title), lower(e.phrase)) AND (e.clause IS NULL OR e.clause = c.clause)
            GROUP BY ALL),
scored AS (SELECT e.*, m.section IS NOT NULL AS hit, coalesce(m.section, '') AS matched_section
           FROM expected e LEFT JOIN matched m USING (user_id, expectation))"""


def _scored(spark, sf_dir):
    """Customers as expectations, users as runs, events as citations."""
    expected = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 200).alias("user_id"),
        F.col("c_custkey").alias("expectation"),
        F.concat(F.lit("DOCUMENT "), (F.col("c_custkey") % 97).cast("string")).alias("doc_title_contains"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("string")).alias("clause"),
    )
    cited = table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("position"),
        F.concat(F.lit("Document "), (F.col("event_id") % 1000).cast("string")).alias("title"),
        F.col("event_type").alias("section"),
        (F.col("event_id") % 25).cast("string").alias("clause"),
    )
    return evaluation.score_citations(expected, cited, ["user_id"])


@query(f"WITH {SCORED_SQL} SELECT user_id, expectation, hit, matched_section FROM scored")
def scored_citations(spark, sf_dir):
    return _scored(spark, sf_dir).select("user_id", "expectation", "hit", "matched_section")


@query(
    f"""WITH {SCORED_SQL} SELECT user_id, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS expected
        FROM scored GROUP BY user_id"""
)
def citation_hits(spark, sf_dir):
    return evaluation.citation_hits(_scored(spark, sf_dir), ["user_id"])


class CountingModel:
    """Decides by the length of the question, so that SQL can say what it will do."""

    def chat(self, messages, temperature=0.0, max_tokens=0):
        body = json.loads(messages[0])
        question, size = body["question"], len(body["question"])
        if "tables" in body:
            return Reply("SELECT name FROM nodes WHERE label = 'Region'" if size % 2 == 0 else "SELECT * FROM elsewhere")
        if "choices" in body:
            return Reply("Relationship: it divides by three" if size % 3 == 0 else "lookup it is")
        if body["task"].startswith("Word"):
            return Reply(f'"{question}"')
        if "notes" in body:
            graph = "graph" if "Result of SELECT" in body["context"] else "texts"
            return Reply(f"{body['context'].split(')')[0]}; {graph}; {len(body['notes'])} notes")
        return Reply("insufficient: more" if size % 4 == 1 else "Sufficient.")


@query(
    f"""WITH {GOLDEN_SPARSE_SQL},
        codes AS (SELECT item_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS code FROM (SELECT item_id, unnest(ts) AS w FROM q)),
        sums AS (SELECT item_id, code % {WIDTH} AS bucket, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS total FROM codes GROUP BY ALL),
        asked AS (SELECT b.item_id, list(CAST(coalesce(total, 0) AS DOUBLE) ORDER BY r.range) AS v
            FROM benchmark b CROSS JOIN range({WIDTH}) r LEFT JOIN sums s ON s.item_id = b.item_id AND s.bucket = r.range GROUP BY b.item_id),
        near AS (SELECT item_id, vec_id AS id, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)) / 2, 9) AS score
            FROM asked, embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
        dense AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= {K}),
        sparse AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= {K}),
        lists AS (SELECT item_id, id, rank, 0 AS list FROM dense UNION ALL SELECT item_id, id, rank, 1 FROM sparse),
        merged AS (SELECT item_id, id, sum(1.0::DOUBLE / ({RRF_K} + rank)) AS rrf, min(list * 1000 + rank) AS seen FROM lists GROUP BY item_id, id),
        fused AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM merged QUALIFY rank <= {K}),
        found AS (SELECT item_id, 'vector' AS mode, id, rank FROM dense UNION ALL SELECT item_id, 'hybrid', id, rank FROM fused),
        listed AS (SELECT item_id, mode, arg_min(id, rank) AS first, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS cited FROM found GROUP BY ALL),
        sizes AS (SELECT item_id, length(trim(text, {WS})) AS size FROM benchmark),
        decided AS (SELECT *, size % 3 = 0 AND mode = 'hybrid' AS walks, CASE WHEN size % 4 = 1 THEN 3 ELSE 1 END AS iterations FROM listed JOIN sizes USING (item_id))
        SELECT CAST(item_id AS VARCHAR) AS id, mode, CASE WHEN size % 3 = 0 THEN 'relationship' ELSE 'lookup' END AS route, iterations,
            '[1] (' || first || '; ' || CASE WHEN walks AND size % 2 = 0 THEN 'graph' ELSE 'texts' END || '; '
                || (CAST(iterations > 1 AS INT) + CAST(walks AND size % 2 = 1 AS INT)) || ' notes' AS answer,
            cited, CAST(3 + iterations * (2 + CAST(walks AS INT)) AS BIGINT) AS steps FROM decided"""
)
def question_runs(spark, sf_dir):
    """Every benchmark item in both modes through the whole loop, with a model that counts characters."""
    located = [F.lit("").alias(c) for c in ("section", "clause")] + [F.lit(None).cast("string").alias("code_ref")]
    chunks = _chunks(spark, sf_dir).select("*", F.col("id").cast("string").alias("doc_id"), *located)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    config = EngineConfig(embedding_dim=WIDTH, top_k=K, rrf_k=RRF_K)
    loop = QuestionRuns(
        spark, chunks, _titled_documents(spark, sf_dir), trade_graph(spark, sf_dir), GraphSchema.load(), CountingModel, lambda: HashingEmbedder(WIDTH), config
    )
    done = loop.answer(asked)
    steps = done.steps.groupBy("id", "mode").agg(F.count("*").alias("steps"))
    cited = F.array_join(F.transform("citations", lambda c: c["doc_id"]), ",")
    return done.runs.join(steps, ["id", "mode"]).select("id", "mode", "route", "iterations", "answer", cited.alias("cited"), "steps")
