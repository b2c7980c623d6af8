"""A table of questions through the answer loop, a pass per step and iteration.

A run is a row (question and retrieval mode). Model calls happen in tasks and their replies are stored, as they are
not repeatable; what a reply means is decided by the same columns as in a single run (``plans.runs``). Retrieval
answers all distinct queries in one scan each for words and vectors. Runs that the judge settles leave the open
table; a run that fails ends with its error and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.functions import text as tx
from docweave.operators import batch_retrieval as br
from docweave.operators import retrieval as rt
from docweave.operators.citations import FIELDS, build_citations
from docweave.operators.embedding import Embedder, embed_chunks
from docweave.plans import guard, nlquery, runs
from docweave.plans.agent import GRAPH_CHUNK, MODES, request
from docweave.plans.graph_schema import GraphSchema
from docweave.plans.llm import complete
from docweave.plans.patterns import Graph
from docweave.session import stored

RUN = ("id", "mode")
_FAILURES = "array<struct<statement: string, error: string>>"
_CONTEXT = ("seen", "chunk", "text", "section", "clause", "code_ref", "score", "kind")


@dataclass
class Results:
    """runs: id, mode, route, iterations, error, answer, citations. steps: id, mode, turn, step, detail (JSON)."""

    runs: DataFrame
    steps: DataFrame


@dataclass
class QuestionRuns:
    """As ``Agent``, for tables: the model and the embedder are made in the tasks that use them."""

    spark: SparkSession
    chunks: DataFrame
    documents: DataFrame
    graph: Graph
    schema: GraphSchema
    make_llm: Callable[[], object]
    make_embedder: Callable[[], Embedder]
    config: EngineConfig = EngineConfig()

    def said(self, rows: DataFrame, purpose: str, prompt: Callable[[dict], str], data: dict[str, Column], tokens: int) -> DataFrame:
        """``rows`` with the model's reply and the error that took its place, stored; one call per row."""
        make_llm, names = self.make_llm, list(data)

        @F.pandas_udf("struct<reply: string, error: string>")
        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            llm = make_llm()
            for frame in batches:
                out = []
                for values in frame[names].itertuples(index=False, name=None):
                    try:
                        out.append((complete(llm, prompt(dict(zip(names, values))), purpose, tokens), ""))
                    except Exception as exc:  # noqa: BLE001 - a failed call ends its own run
                        out.append(("", str(exc) or type(exc).__name__))
                yield pd.DataFrame(out, columns=["reply", "error"])

        slices = max(1, -(-rows.count() // self.config.extract_slice_rows))
        asked = rows.repartition(slices).withColumn("said", call(F.struct(*[c.alias(n) for n, c in data.items()])))
        return stored(asked.select(*rows.columns, "said.reply", F.col("said.error").alias("failed")), purpose.replace(" ", "-"))

    def asked(self, rows: DataFrame, purpose: str, **data: Column) -> DataFrame:
        def prompt(values: dict) -> str:
            return request(purpose, **{n: v if isinstance(v, str) or v is None else list(v) for n, v in values.items()})

        return self.said(rows, purpose, prompt, data, self.config.answer_max_tokens)

    def found(self, asked: DataFrame) -> DataFrame:
        """(id, mode, chunk, score, rank) of runs (id, mode, query): each distinct query is answered once."""
        settings = self.config
        queries = asked.select(F.col("query").alias("text")).distinct().withColumn("query_id", F.monotonically_increasing_id())
        queries = stored(embed_chunks(stored(queries, "queries"), self.make_embedder, settings), "query-vectors")
        vectors = queries.select("query_id", "embedding")
        dense = stored(br.answer_all(vectors, lambda rows: br.dense_top_k(self.chunks, [tuple(r) for r in rows], settings.top_k)), "dense")
        fused = rt.reciprocal_rank_fusion(dense, br.bm25_top_k(self.chunks, queries, settings.top_k), k=settings.rrf_k, by=("query_id",))
        both = dense.select("query_id", "id", "score", "rank", F.lit("vector").alias("mode")).unionByName(
            fused.where(F.col("rank") <= settings.top_k).select("query_id", "id", "score", "rank", F.lit("hybrid").alias("mode"))
        )
        numbered = asked.join(queries.select("query_id", F.col("text").alias("query")), "query").select(*RUN, "query_id")
        hits = both.withColumnRenamed("id", "chunk")
        return stored(numbered.join(hits, ["query_id", "mode"]).select(*RUN, "chunk", "score", "rank"), "found")

    def traversed(self, open_runs: DataFrame) -> DataFrame:
        """(id, mode, statement, text, refs) of runs (id, mode, query); the statement is empty where none ran.

        Every attempt asks the model for all runs still without a result, and runs each distinct statement once.
        """
        views, settings, schema = self.graph.register_views(), self.config, self.schema
        pending, done = open_runs.select(*RUN, "query", F.array().cast(_FAILURES).alias("failures")), []

        def prompt(values: dict) -> str:
            failures = [dict(f) if isinstance(f, dict) else f.asDict() for f in values["failures"]]
            return nlquery.build_prompt(values["query"], schema, views, failures)

        for _ in range(settings.query_attempts):
            data = {"query": F.col("query"), "failures": F.col("failures")}
            replies = self.said(pending, "graph query", prompt, data, settings.query_max_tokens)
            results = []
            for (reply,) in replies.where("failed = ''").select("reply").distinct().toLocalIterator():
                statement = guard.bare(reply)
                try:
                    if not statement:
                        raise ValueError(nlquery.NO_STATEMENT)
                    rows = nlquery.run_statement(self.spark, statement, views)
                    refs = nlquery.chunk_references(nlquery.page(rows, settings.query_page_rows))
                    results.append((reply, statement, f"Result of {statement}\n{nlquery.page_text(rows, settings)}", refs, ""))
                except Exception as exc:  # noqa: BLE001 - what analysis, guard or execution say is fed back
                    results.append((reply, statement, "", [], str(exc)))
            table = self.spark.createDataFrame(results, "reply string, statement string, text string, refs array<string>, problem string")
            judged = stored(replies.join(table, "reply", "left"), "traversed")
            done.append(judged.where("problem = ''").select(*RUN, "statement", "text", "refs"))
            problem = F.struct(F.coalesce("statement", F.lit("")).alias("statement"), F.coalesce("problem", "failed").alias("error"))
            pending = judged.where("problem IS NULL OR problem != ''").select(*RUN, "query", F.concat("failures", F.array(problem)).alias("failures"))
            if pending.isEmpty():
                break
        else:
            done.append(pending.select(*RUN, F.lit("").alias("statement"), F.lit("").alias("text"), F.array().cast("array<string>").alias("refs")))
        whole = done[0]
        for more in done[1:]:
            whole = whole.unionByName(more)
        return stored(whole, "traversals")

    def rendered(self, state: DataFrame, context: DataFrame) -> DataFrame:
        """``state`` with the column context: what each run has gathered, as one text."""
        merged = rt.merge_context(context.withColumnRenamed("id", "run").withColumnRenamed("chunk", "id"), "seen", self.config.max_context_chunks, ("run", "mode"))
        shown = rt.render_context(merged, self.config.max_chunk_text_chars, ("run", "mode")).withColumnRenamed("run", "id")
        return state.join(shown, list(RUN), "left").withColumn("context", F.coalesce("context", F.lit("")))

    def answer(self, questions: DataFrame, modes: Sequence[str] = MODES) -> Results:
        """All questions (id, question) in all modes. Ids must differ; a null or blank question is a run with an error."""
        settings, steps = self.config, []

        def note(rows: DataFrame, step: str, turn: int, **detail: Column) -> None:
            shown = F.to_json(F.struct(*[c.alias(n) for n, c in detail.items()]))
            steps.append(rows.select(*RUN, F.lit(turn).alias("turn"), F.lit(step).alias("step"), shown.alias("detail")))

        begun = questions.select(
            F.col("id").cast("string").alias("id"), tx.strip(F.coalesce("question", F.lit(""))).alias("question"),
            F.explode(F.array(*map(F.lit, modes))).alias("mode"),
        )
        begun = stored(begun.withColumn("known", F.col("mode").isin(*MODES)), "questions")
        refused = begun.where("question = '' OR NOT known").withColumn(
            "error", F.when(F.col("question") == "", "empty message").otherwise(F.concat(F.lit("unknown retrieval mode "), F.col("mode")))
        )
        failed = [refused.select(*RUN, F.lit(None).cast("string").alias("route"), F.lit(0).alias("iterations"), "error")]

        routed = self.asked(begun.where("question != '' AND known").drop("known"), "route", question=F.col("question"))
        routed = routed.withColumns({"route": tx.route(F.col("reply")), "rationale": tx.route_rationale(F.col("reply"))})
        failed.append(routed.where("failed != ''").select(*RUN, F.lit(None).cast("string").alias("route"), F.lit(0).alias("iterations"), F.col("failed").alias("error")))
        routed = routed.where("failed = ''").drop("reply", "failed")
        note(routed, "route", 0, route=F.col("route"), rationale=F.col("rationale"))
        worded = self.asked(routed, "rewrite", question=F.col("question"))
        failed.append(worded.where("failed != ''").select(*RUN, "route", F.lit(0).alias("iterations"), F.col("failed").alias("error")))
        worded = worded.where("failed = ''").withColumn("query", F.coalesce(tx.non_empty(F.btrim("reply", F.lit('"'))), "question"))
        note(worded, "rewrite", 0, rewritten=F.col("query"))
        state = worded.select(*RUN, "question", "query", "route", F.array().cast("array<string>").alias("notes"))

        found = self.found(state)
        texts = self.chunks.select(F.col("id").alias("chunk"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", *rt.RESULT_COLUMNS)])
        context = found.join(texts, "chunk").select(*RUN, F.col("rank").cast("long").alias("seen"), F.col("chunk").cast("string").alias("chunk"),
                                                    "text", *rt.RESULT_COLUMNS, "score", F.lit("chunk").alias("kind"))
        context = stored(context, "context")
        listed = found.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk", "score"))).alias("found"))  # k rows a run
        settled, graph_rows = [], []
        for turn in range(1, settings.max_iterations + 1):
            hits = state.join(listed, list(RUN), "left")
            chunks = F.coalesce(F.transform("found", lambda f: f["chunk"].cast("string")), F.array().cast("array<string>"))
            note(hits, "retrieve", turn, mode=F.col("mode"), iteration=F.lit(turn), chunks=F.size(chunks), chunk_ids=chunks,
                 scores=F.transform("found", lambda f: f["score"]))
            follows = state.where(runs.after_retrieve(F.col("route"), F.col("mode")) == "traverse")
            if not follows.isEmpty():
                walked = self.traversed(follows)
                note(walked, "traverse", turn, statement=F.col("statement"))
                ran = walked.where("statement != ''")
                graph_rows.append(ran.withColumn("turn", F.lit(turn)))
                place = F.lit(settings.top_k + turn).cast("long").alias("seen")
                blank = [F.lit("").alias(c) for c in rt.RESULT_COLUMNS]
                context = context.unionByName(
                    ran.select(*RUN, place, F.lit(GRAPH_CHUNK).alias("chunk"), "text", *blank, F.lit(0.0).alias("score"), F.lit("graph").alias("kind"))
                )
                lacking = F.lit(f"No graph query ran in {settings.query_attempts} attempts; the answer rests on the documents.")
                state = state.join(walked.where("statement = ''").select(*RUN, F.array(lacking).alias("lacking")), list(RUN), "left")
                state = state.withColumn("notes", F.array_union("notes", F.coalesce("lacking", F.array().cast("array<string>")))).drop("lacking")
            capped = turn >= settings.max_iterations
            if capped:
                judged = state.withColumns({"reply": F.lit(""), "failed": F.lit("")})
            else:
                judged = self.asked(self.rendered(state, context), "sufficiency", question=F.col("question"), context=F.col("context"))
            at = F.lit(turn)
            sufficient = runs.is_sufficient(F.col("reply"), at, settings)
            judged = judged.withColumns({"sufficient": sufficient, "note": runs.judge_note(F.col("reply"), at, settings)})
            failed.append(judged.where("failed != ''").select(*RUN, "route", F.lit(turn).alias("iterations"), F.col("failed").alias("error")))
            judged = stored(judged.where("failed = ''").select(*state.columns, "sufficient", "note"), "judged")
            note(judged, "sufficiency", turn, sufficient=F.col("sufficient"), capped=F.lit(capped), note=F.col("note"), iterations=at)
            over = F.col("sufficient") | F.lit(capped)
            settled.append(judged.where(over).select(*state.columns, F.lit(turn).alias("iterations")))
            if capped:
                break
            added = F.when(F.col("note") != "", F.array("note")).otherwise(F.array().cast("array<string>"))
            state = judged.where(~over).select(*RUN, "question", "query", "route", F.array_union("notes", added).alias("notes"))
            if state.isEmpty():
                break

        final = settled[0]
        for more in settled[1:]:
            final = final.unionByName(more)
        data = {n: F.col(n) for n in ("question", "context", "notes")}
        answered = self.asked(self.rendered(final, context), "synthesize", **data)
        note(answered.where("failed = ''"), "synthesize", settings.max_iterations + 1)
        refs = found.select(*RUN, F.col("chunk").cast("string").alias("chunk_id"), F.col("rank").cast("long").alias("position"))
        for rows in graph_rows:
            named = rows.select(*RUN, F.posexplode("refs").alias("at", "chunk_id"), "turn")
            refs = refs.unionByName(named.select(*RUN, "chunk_id", (F.col("turn") * 1_000_000 + F.col("at")).cast("long").alias("position")))
        cited = build_citations(refs, self.chunks.withColumn("id", F.col("id").cast("string")), self.documents, RUN)
        cited = cited.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("position", *FIELDS))).alias("c"))
        cited = cited.select(*RUN, F.transform("c", lambda c: F.struct(*[c[f].alias(f) for f in FIELDS])).alias("citations"))
        kind = "array<struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>"
        good = answered.join(cited, list(RUN), "left").select(
            *RUN, "route", "iterations", tx.non_empty(F.col("failed")).alias("error"), F.col("reply").alias("answer"),
            F.coalesce("citations", F.array().cast(kind)).alias("citations"),
        )
        for rows in failed:
            good = good.unionByName(rows.select(*RUN, "route", "iterations", "error", F.lit("").alias("answer"), F.array().cast(kind).alias("citations")))
        told = steps[0]
        for more in steps[1:]:
            told = told.unionByName(more)
        return Results(stored(good, "runs"), told)


def by_mode(evaluated: DataFrame, measures: Sequence[str], modes: Sequence[str] = MODES) -> DataFrame:
    """One row per question, every measure once per mode."""
    return evaluated.groupBy("id").pivot("mode", list(modes)).agg(*[F.first(m).alias(m) for m in measures])
