"""Run analytics over tables: loop outcomes, step details, trace summaries, ingest counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.functions import text as tx

TRAVERSING_ROUTES = tx.ROUTES[1:]


def after_retrieve(route: Column, mode: Column) -> Column:
    """Traverse for relational questions in hybrid mode, else judge."""
    return F.when(route.isin(*TRAVERSING_ROUTES) & (mode == "hybrid"), "traverse").otherwise("sufficiency")


def is_capped(iterations: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The loop ends here whatever the judge would say."""
    return iterations >= config.max_iterations


def is_sufficient(reply: Column, iterations: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The judge's word; a capped loop has none."""
    return ~is_capped(iterations, config) & (tx.first_token(reply, "insufficient") == "sufficient")


def judge_note(reply: Column, iterations: Column, config: EngineConfig = EngineConfig()) -> Column:
    capped = F.lit(f"hard cap of {config.max_iterations} iterations reached")
    return (
        F.when(is_capped(iterations, config), capped)
        .when(is_sufficient(reply, iterations, config), "")
        .otherwise(tx.strip(F.coalesce(reply, F.lit(""))))
    )


def after_sufficiency(sufficient: Column, capped: Column) -> Column:
    return F.when(sufficient | capped, "synthesize").otherwise("retrieve")


def retrieve_details(found: DataFrame, context: DataFrame, run: Sequence[str]) -> DataFrame:
    """The found chunk ids of each run with the scores their context rows carry, 0.0 without one."""
    held = context.select(*run, "id", F.col("score").alias("held_score"))
    return found.join(held, [*run, "id"], "left").select(
        *found.columns, F.coalesce("held_score", F.lit(0.0)).alias("score")
    )


def trace_summary(events: DataFrame, run: Sequence[str], order: str, step: str) -> DataFrame:
    """First and last step, number of events and elapsed order of every run.

    Minima and maxima combine in the map tasks, so one long run is no hot group.
    """
    return events.groupBy(*run).agg(
        F.min_by(step, order).alias("first_step"),
        F.max_by(step, order).alias("last_step"),
        F.count("*").alias("events"),
    )


def stage_seconds(events: DataFrame, stage: str, started: str, finished: str) -> DataFrame:
    """A3: wall seconds per stage."""
    seconds = F.unix_micros(finished) - F.unix_micros(started)
    return events.groupBy(stage).agg(F.sum(seconds).alias("micros"), F.count("*").alias("n"))


def ingest_counters(chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """Documents, chunks and failed chunks per class; a chunk without a result counts as fine."""
    joined = chunks.select("id", "doc_id", "doc_type").join(failures.select("id", "error"), "id", "left")
    return joined.groupBy("doc_type").agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count("*").alias("chunks"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed_chunks"),
    )
