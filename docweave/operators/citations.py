"""Chunk ids to citation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("doc_id", "title", "doc_type", "source_path", "section", "clause", "code_ref")


def build_citations(
    references: DataFrame, chunks: DataFrame, documents: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Citations of the referenced chunks, one per (document, section, clause, code reference).

    ``references`` has ``chunk_id`` and ``position`` (and the ``by`` columns
    that tell runs apart). Empty and ``graph:`` ids and unknown chunks drop
    out, repeated ids and places keep their first position. Both dedupes are
    pre-aggregated minima, so neither a busy run nor a popular chunk gathers
    anywhere.
    """
    wanted = (
        references.where((F.coalesce("chunk_id", F.lit("")) != "") & ~F.col("chunk_id").startswith("graph:"))
        .groupBy(*by, "chunk_id")
        .agg(F.min("position").alias("position"))
    )
    located = (
        wanted.join(
            chunks.select(F.col("id").alias("chunk_id"), "doc_id", "section", "clause", "code_ref"), "chunk_id"
        )
        .join(documents.select("doc_id", "title", "doc_type", "source_path"), "doc_id")
        .select(*by, "position", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS])
    )
    place = ("doc_id", "section", "clause", "code_ref")
    rest = [c for c in FIELDS if c not in place]
    first = located.groupBy(*by, *place).agg(F.min(F.struct("position", *rest)).alias("first"))
    return first.select(*by, "first.position", *[F.col(c) if c in place else F.col(f"first.{c}") for c in FIELDS])
