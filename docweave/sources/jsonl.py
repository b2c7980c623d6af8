"""Golden questions and run traces as line-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = (
    "id string, question string, intent string, "
    "expected_citations array<struct<doc_title_contains:string,clause:string>>, "
    "expected_graph_paths array<array<string>>, notes string"
)

CITATION = (
    "struct<doc_id:string,title:string,doc_type:string,source_path:string,"
    "section:string,clause:string,code_ref:string>"
)
TRACE = (
    "event string, trace_id string, retrieval_mode string, question string, step string, "
    f"detail variant, ts_ms bigint, citations array<{CITATION}>, iterations int, total_ms bigint, message string"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions; blank lines hold no record and are skipped by the reader."""
    return spark.read.schema(GOLDEN).json(path).where(F.col("id").isNotNull())


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All trace events; every one names its run."""
    return spark.read.schema(TRACE).json(path).withColumn("run_id", F.col("trace_id"))


def trace_finals(traces: DataFrame) -> DataFrame:
    """The final event of each run (one per run)."""
    return (
        traces.where(F.col("event") == "final")
        .groupBy("run_id")
        .agg(F.first(F.struct("citations", "iterations", "total_ms")).alias("final"))
        .select("run_id", "final.*")
    )


def trace_final(traces: DataFrame, trace_id: str) -> dict:
    """The final event of one run, ``{}`` when there is none."""
    rows = trace_finals(traces.where(F.col("run_id") == trace_id)).collect()
    return rows[0].asDict(recursive=True) if rows else {}
