"""The property graph as tables, and what one ingest batch does to it.

A batch is a set of documents read in order. Every write carries its order
(document, chunk), so "the last writer wins" and "an endpoint must already be
there" become aggregates and join conditions instead of statement sequences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.joins import sorted_side

EDGE = ("rel_type", "source_label", "source_key", "target_label", "target_key")
PROVENANCE = ("source_chunk", "source_document")


def replace_documents(current: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """K1, K2, K5 for rows owned by a document: the batch's documents lose their old rows and get the new ones."""
    replaced = batch.select(key).distinct()
    return current.join(replaced, key, "left_anti").unionByName(batch, allowMissingColumns=True)


def attached_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document exists."""
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi")


def write_order() -> Column:
    """When a row was written. ``doc_order`` may be of any sortable type."""
    return F.struct(F.col("doc_order").alias("doc"), F.col("chunk_index").cast("long").alias("chunk"))


def before_batch(rows: DataFrame) -> Column:
    """A write order below all of the batch's: NULL fields sort first."""
    kind = rows.schema["doc_order"].dataType
    return F.struct(F.lit(None).cast(kind).alias("doc"), F.lit(None).cast("long").alias("chunk"))


def _last_value(prop: str) -> Column:
    return F.expr(f"max_by({prop}, written) FILTER (WHERE {prop} IS NOT NULL)").alias(prop)


def upsert_entities(current: DataFrame | None, mentions: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Entities by (label, key), per property the last non-empty write; plus first_seen.

    ``mentions`` has label, key, the properties, doc_order and chunk_index.
    Partial aggregation collapses a hot entity's mentions before the shuffle.
    """
    rows = mentions.select("label", "key", *properties, write_order().alias("written"))
    if current is not None:
        before = before_batch(mentions).alias("written")
        rows = current.select("label", "key", *properties, before).unionByName(rows)
    return rows.groupBy("label", "key").agg(
        *[_last_value(p) for p in properties], F.min("written").alias("first_seen")
    )


def _endpoint(entities: DataFrame, side: str) -> DataFrame:
    return entities.select(
        F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key"), F.col("first_seen").alias(f"{side}_seen")
    )


def last_assertions(relations: DataFrame) -> DataFrame:
    """The last statement of every edge, with its provenance (map-side combined per edge)."""
    return relations.groupBy(*EDGE).agg(
        F.max(F.struct(write_order().alias("written"), F.col("chunk_id"), F.col("doc_id"))).alias("last")
    ).select(
        *EDGE,
        F.col("last.written").alias("written"),
        F.col("last.chunk_id").alias("source_chunk"),
        F.col("last.doc_id").alias("source_document"),
    )


def judged_edges(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Every stated edge, ``is_written`` where both endpoints existed when it was stated.

    Visibility only grows with the write order, so the last statement of an
    edge decides for all of them and the joins see one row per edge. Entities
    are unique per key: a hot endpoint is a skewed probe side only, which
    adaptive execution splits.
    """
    seen = {s: F.coalesce(F.col(f"{s}_seen") <= F.col("written"), F.lit(False)) for s in ("source", "target")}
    sourced = assertions.join(_endpoint(entities, "source"), ["source_label", "source_key"], "left")
    sourced = sourced.select(*assertions.columns, seen["source"].alias("is_sourced"))
    found = sourced.join(_endpoint(entities, "target"), ["target_label", "target_key"], "left")
    return found.select(*assertions.columns, (F.col("is_sourced") & seen["target"]).alias("is_written"))


def resolve_edges(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose endpoints both existed when the edge was written."""
    return judged_edges(assertions, entities).where("is_written").select(*EDGE, *PROVENANCE)


def skipped_edges(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that were stated but not written, for want of an endpoint."""
    return judged_edges(assertions, entities).where("NOT is_written").drop("is_written")


def upsert_edges(
    current: DataFrame | None, assertions: DataFrame, entities: DataFrame, batch_documents: DataFrame
) -> DataFrame:
    """K4, K5: the edge table after a batch.

    New statements win. An older edge survives unless it was written again or
    its provenance document is part of the batch. Both meet in one join, so the
    batch's statements are resolved once.
    """
    written = resolve_edges(assertions, entities)
    if current is None:
        return written
    replaced = batch_documents.select(F.col("doc_id").alias("source_document")).distinct()
    kept = current.join(replaced, "source_document", "left_anti").select(*EDGE, *PROVENANCE)
    new = written.select(*EDGE, *[F.col(c).alias(f"new_{c}") for c in PROVENANCE], F.lit(True).alias("is_new"))
    last = [F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in PROVENANCE]
    return kept.join(new, list(EDGE), "full_outer").select(*EDGE, *last)


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    """K7: key values held by more than one row; empty when the uniqueness rule holds."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def entity_counts(entities: DataFrame) -> DataFrame:
    """A1: distinct entities per label."""
    return entities.select("label", "key").distinct().groupBy("label").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """A1: distinct edges per type."""
    return edges.select(*EDGE).distinct().groupBy("rel_type").agg(F.count("*").alias("n"))


def display_name(*columns: str) -> Column:
    """The first of name, id, path."""
    return F.coalesce(*[F.col(c) for c in columns])


def graph_inventory(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node and every edge triple as (kind, label, source, target) rows, duplicates removed.

    Edges meet names by key first: labels are few, and rows sorted by them would be told apart by whole comparisons.
    """
    names = entities.select("label", "key", display_name("name", "id", "path").alias("shown"))
    nodes = names.select(
        F.lit("node").alias("kind"), "label", F.col("shown").alias("source"), F.lit(None).cast("string").alias("target")
    )
    triples = (
        edges.join(
            sorted_side(names.select(F.col("label").alias("source_label"), F.col("key").alias("source_key"), F.col("shown").alias("source"))),
            ["source_key", "source_label"],
        )
        .join(
            sorted_side(names.select(F.col("label").alias("target_label"), F.col("key").alias("target_key"), F.col("shown").alias("target"))),
            ["target_key", "target_label"],
        )
        .select(F.lit("edge").alias("kind"), F.col("rel_type").alias("label"), "source", "target")
    )
    return nodes.unionByName(triples).distinct()
