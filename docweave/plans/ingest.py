"""Entry point A: a directory tree into the graph store.

scan -> chunk -> embed -> model calls -> validate -> apply -> text index. The steps that cost
the most or are not repeatable (embedding, model calls) are written to the
batch's staging tables and read back, which cuts the lineage: a lost executor
afterwards repeats reads, not calls. A batch name that is already staged is
picked up where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators import extraction as ex
from docweave.operators import graph as gr
from docweave.operators.chunking import chunk_documents
from docweave.operators.embedding import Embedder, check_dimension, embed_chunks
from docweave.plans.graph_schema import GraphSchema
from docweave.plans.store import GraphStore
from docweave.sources.corpus import load_documents



@dataclass
class Ingest:
    spark: SparkSession
    store: GraphStore
    schema: GraphSchema
    make_embedder: Callable[[], Embedder]
    make_llm: Callable[[], object]
    config: EngineConfig = EngineConfig()
    pdf_to_text: Callable[[bytes], str] | None = None

    def _stage(self, batch: str, name: str, make: Callable[[], DataFrame], timings: dict) -> DataFrame:
        """A staging table: made once per batch, then read."""
        table = f"staging/{batch}/{name}"
        stored = self.store.read(table)
        if stored is None:
            started = time.monotonic()
            # Only a finished write leaves the files a later read finds.
            writer = make().write.mode("overwrite")
            if name == "documents":
                # The chunkers read classes apart.
                writer = writer.partitionBy("doc_type")
            writer.parquet(f"{self.store.path}/{table}")
            timings[name] = time.monotonic() - started
            stored = self.spark.read.parquet(f"{self.store.path}/{table}")
        return stored

    def follow(self, root: str, checkpoint: str) -> None:
        """Ingests what has come to ``root`` since the last call, in batches, and returns.

        The stream's checkpoint knows the files that were seen; a call that is cut off takes its batch up again.
        """
        files = self.spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
        files = files.schema("path string, modificationTime timestamp, length long, content binary").load(root).select("path")

        def arrived(paths: DataFrame, number: int) -> None:
            self.run(root, f"arrived-{number}", paths)

        stream = files.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        stream.start().awaitTermination()

    def _wanted(self, documents: DataFrame, paths: DataFrame) -> DataFrame:
        """The documents of the given paths, and those the store does not hold under the id that the listing now gives them."""
        named = documents.join(paths.select(F.col("path").alias("abs_path")).distinct().withColumn("named", F.lit(True)), "abs_path", "left")
        known = self.store.read("documents")
        if known is not None:
            known = known.select("source_path", "doc_id").withColumn("known", F.lit(True))
            named = named.join(known, ["source_path", "doc_id"], "left").where("named OR known IS NULL").drop("known")
        return named.select(*documents.columns)

    def run(self, root: str, batch: str, paths: DataFrame | None = None) -> dict:
        """Ingest everything under ``root``, or only the files of ``paths`` (path), as one batch; returns the summary counters."""
        timings: dict[str, float] = {}
        check_dimension(self.make_embedder(), self.config.embedding_dim)
        listed = lambda: self._ordered_documents(root)
        documents = self._stage(batch, "documents", listed if paths is None else lambda: self._wanted(listed(), paths), timings)
        chunks = self._stage(batch, "chunks", lambda: self._embedded_chunks(documents), timings)
        replies = self._stage(batch, "replies", lambda: self._replies(chunks, documents), timings)
        keep = ("doc_id", "doc_order", "chunk_index", "chunk_id")
        mentions = self._stage(
            batch,
            "mentions",
            lambda: self.store.mark_new(
                ex.merge_mentions(ex.entity_verdicts(replies, self.schema, *keep), self.schema, *keep)
            ),
            timings,
        )
        relations = ex.kept_relations(ex.relation_verdicts(replies, self.schema, *keep), *keep)
        started = time.monotonic()
        self.store.apply(
            documents.select("doc_id", "title", "doc_type", "source_path"), chunks, mentions, relations
        )
        timings["apply"] = time.monotonic() - started
        started = time.monotonic()
        self.store.text_index().add(chunks.select("id", "doc_id", "text"), batch)
        timings["text_index"] = time.monotonic() - started
        return self.summary(chunks, replies, mentions, relations) | {"seconds": timings}

    def _ordered_documents(self, root: str) -> DataFrame:
        docs = load_documents(self.spark, root, self.pdf_to_text)
        return docs.withColumn("doc_order", reading_order()).drop("class_order", "parts")

    def _embedded_chunks(self, documents: DataFrame) -> DataFrame:
        return embed_chunks(chunk_documents(documents, self.config), self.make_embedder, self.config)

    def _replies(self, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        described = chunks.drop("embedding").join(
            documents.select("doc_id", "title", "source_path", "doc_order"), "doc_id"
        )
        called = ex.extract_payloads(
            described.withColumnRenamed("id", "chunk_id"), self.make_llm, self.schema, self.config
        )
        return called.select("doc_id", "doc_type", "doc_order", "chunk_index", "chunk_id", "payload", "error")

    def summary(self, chunks: DataFrame, replies: DataFrame, mentions: DataFrame, relations: DataFrame) -> dict:
        """Counters of the batch; edges as stated and as written."""
        counted = replies.agg(
            F.count_distinct("doc_id").alias("documents"),
            F.count("*").alias("chunks"),
            F.count_if(F.col("error") != "").alias("failed_chunks"),
        ).first()
        by_label = {r["label"]: r["n"] for r in gr.entity_counts(mentions).collect()}
        by_type = {r["rel_type"]: r["n"] for r in gr.edge_counts(relations).collect()}
        edges = self.store.read("edges")
        return counted.asDict() | {
            "entities": sum(by_label.values()),
            "entities_by_label": dict(sorted(by_label.items())),
            "edges_stated": sum(by_type.values()),
            "edges_by_type": dict(sorted(by_type.items())),
            "edges_stored": edges.count() if edges is not None else 0,
        }


def reading_order() -> Column:
    """A text that sorts as (class, path components) does, so no file needs to be numbered.

    The separator sorts below every character of a path.
    """
    return F.concat_ws("\0", F.col("class_order").cast("string"), F.col("parts"))
