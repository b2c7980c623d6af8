"""Scoring answers against golden questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.loose_paths import check_paths

def score_citations(expected: DataFrame, citations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per expectation, whether a citation of the same run fulfils it, and the first one's section.

    expected: by, expectation, doc_title_contains, clause (NULL: any).
    citations: by, position, title, section, clause.
    """
    # A run cites the same place many times at most; one row per place is enough to find the first.
    cited = citations.groupBy(
        *by, F.col("title").alias("cited_title"), F.col("clause").alias("cited_clause")
    ).agg(F.min(F.struct("position", "section")).alias("cited"))
    titled = F.lower(F.coalesce("cited_title", F.lit(""))).contains(F.lower("doc_title_contains"))
    keys = (*by, "expectation")
    # An expectation with a clause meets that clause's places alone, one without meets each title once.
    on_clause = cited.withColumn("clause", F.coalesce("cited_clause", F.lit(""))).drop("cited_clause")
    titles = cited.groupBy(*by, "cited_title").agg(F.min("cited").alias("cited"))
    with_clause = expected.where(F.col("clause").isNotNull()).join(on_clause, [*by, "clause"]).where(titled)
    without = expected.where(F.col("clause").isNull()).join(titles, list(by)).where(titled)
    met = with_clause.select(*keys, "cited").unionByName(without.select(*keys, "cited"))
    first = met.groupBy(*keys).agg(F.min("cited").alias("cited"), F.lit(True).alias("hit"))
    return expected.join(first, list(keys), "left").select(
        *expected.columns,
        F.coalesce("hit", F.lit(False)).alias("hit"),
        F.coalesce("cited.section", F.lit("")).alias("matched_section"),
    )


def citation_hits(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """A4: hits and expectations per run."""
    return scored.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count("*").alias("expected"))


def evaluate(runs: DataFrame, golden: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The run table with citation hits and path results, by first hops and whole; the same for every mode."""
    expected = (
        golden.select("id", F.posexplode("expected_citations").alias("expectation", "e"))
        .select("id", "expectation", "e.*")
        .join(runs.select("id", "mode"), "id")
    )
    cited = runs.select("id", "mode", F.posexplode("citations").alias("position", "c")).select(
        "id", "mode", "position", "c.title", "c.section", "c.clause"
    )
    hits = citation_hits(score_citations(expected, cited, ("id", "mode")), ("id", "mode"))
    paths = golden.select("id", F.posexplode("expected_graph_paths").alias("n", "path")).select(
        "id", F.concat_ws("/", "id", "n").alias("path_id"), "path"
    )
    path_results = (
        check_paths(paths, nodes, edges)
        .join(paths.select("id", "path_id"), "path_id")
        .groupBy("id")
        .agg(F.count_if("ok").alias("paths_ok"), F.count_if("full_ok").alias("paths_full"), F.count("*").alias("paths_total"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        runs.join(hits, ["id", "mode"], "left")
        .join(path_results, "id", "left")
        .select(
            *runs.columns,
            F.size("citations").alias("n_citations"),
            *[zero(c) for c in ("hits", "expected", "paths_ok", "paths_full", "paths_total")],
        )
    )


def write_results(evaluated: DataFrame, path: str) -> None:
    """One JSON record per question and mode, and a summary that gives the answer's length only."""
    evaluated.write.mode("overwrite").partitionBy("mode").json(f"{path}/runs")
    summary = evaluated.withColumn("answer_chars", F.length("answer")).drop("answer")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
