"""K1-K8: the tables on disk, and applying an ingest batch to them.

Tables are Parquet, split into hash buckets. A batch writes the buckets its rows
fall into to folders of its own; which folder holds a bucket now is said, for all
tables together, by one version that is written last. A batch that ends half-way
leaves the old version of every table as it was, and files of an old version stay
for whoever still reads them. Running a batch again gives the same tables. One
writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators import graph as gr
from docweave.operators.text_segments import TextSegments
from docweave.plans.graph_schema import GraphSchema

BUCKET = "bucket"
TABLES = ("documents", "chunks", "entities", "edges")
#: Table to bucket to the folder that holds it.
State = dict[str, dict[int, str]]


@dataclass(frozen=True)
class GraphStore:
    spark: SparkSession
    path: str
    schema: GraphSchema
    config: EngineConfig = EngineConfig()

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.config.table_buckets)).cast("int")

    def _stored(self, *paths: str, base: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", base).parquet(*paths)
        except AnalysisException as exc:
            if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def versions(self) -> DataFrame | None:
        """version, table, bucket, folder: every state the tables were in, the largest version last."""
        return self._stored(f"{self.path}/versions", base=f"{self.path}/versions")

    def state(self) -> tuple[int, State]:
        """The current version and its folders: a row per table and bucket, whatever the tables hold."""
        known = self.versions()
        if known is None:
            return 0, {}
        version = known.agg(F.max("version")).first()[0]
        if version is None:
            return 0, {}
        state: State = {}
        for r in known.where(F.col("version") == version).collect():
            state.setdefault(r["table"], {})[r[BUCKET]] = r["folder"]
        return version, state

    def _commit(self, version: int, state: State) -> None:
        """Makes ``state`` the current one: a single file, which is there as a whole or not at all."""
        rows = [(t, b, folder) for t, buckets in sorted(state.items()) for b, folder in sorted(buckets.items())]
        frame = self.spark.createDataFrame(rows, f"table string, {BUCKET} int, folder string").coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")  # what a lost attempt left goes

    def read(self, table: str) -> DataFrame | None:
        """A table as the current version has it, or a staging table; None where there is none."""
        if table not in TABLES:
            return self._stored(f"{self.path}/{table}", base=f"{self.path}/{table}")
        return self._read(self.state()[1], table)

    def _read(self, state: State, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """``table`` in ``state``, or those of its buckets that are named; None where it has none of them."""
        held = {b: folder for b, folder in state.get(table, {}).items() if buckets is None or b in buckets}
        if not held:
            return None
        paths = [f"{folder}/{BUCKET}={b}" for b, folder in sorted(held.items())]
        return self._stored(*paths, base=f"{self.path}/{table}").drop("write")

    def text_index(self) -> TextSegments:
        """K6: the full-text index over the chunks, a segment per batch."""
        return TextSegments(self.spark, f"{self.path}/text_index")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets to rewrite: at most ``table_buckets`` small numbers."""
        return [r[BUCKET] for r in keys.distinct().collect()]

    def _write(self, state: State, rows: DataFrame, table: str, touched: list[int]) -> None:
        """Rows of the touched buckets to a new folder, which ``state`` names from then on; empty buckets are dropped.

        Rebalancing splits a bucket that outgrows one task instead of funnelling it through.
        """
        folder = f"{self.path}/{table}/write={uuid.uuid4().hex}"
        (
            rows.hint("rebalance", F.col(BUCKET))
            .write.partitionBy(BUCKET)
            .option("parquet.bloom.filter.enabled#id", "true" if "id" in rows.columns else "false")
            .parquet(folder)
        )
        written = self._stored(folder, base=folder)
        kept = {b: f for b, f in state.get(table, {}).items() if b not in touched}
        filled = self._touched(written.select(BUCKET)) if written is not None and BUCKET in written.columns else []
        state[table] = {**kept, **{b: folder for b in filled}}

    def _replace(self, state: State, table: str, batch: DataFrame) -> None:
        """K1, K2, K5 for the tables owned by documents."""
        batch = batch.withColumn(BUCKET, self._bucket("doc_id"))
        touched = self._touched(batch.select(BUCKET))
        if not touched:
            return
        current = self._read(state, table, touched)
        self._write(state, batch if current is None else gr.replace_documents(current, batch), table, touched)

    def apply(self, documents: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame) -> None:
        """Apply one batch: chunks and documents, then entities, then edges; all are visible together at the end.

        Inputs are read several times, so they should be stored tables.
        Documents without chunks change nothing, their old rows included.
        """
        version, state = self.state()
        batch = documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")
        self._replace(state, "documents", batch)
        self._replace(state, "chunks", gr.attached_chunks(chunks, batch))
        self._upsert_entities(state, mentions)
        self._upsert_edges(state, gr.last_assertions(relations), batch, mentions)
        self._commit(version + 1, state)

    def _upsert_entities(self, state: State, mentions: DataFrame) -> None:
        touched = self._touched(mentions.select(self._bucket("label", "key").alias(BUCKET)))
        if not touched:
            return
        merged = gr.upsert_entities(self._read(state, "entities", touched), mentions, self.schema.properties).drop("first_seen")
        self._write(state, merged.withColumn(BUCKET, self._bucket("label", "key")), "entities", touched)

    def _upsert_edges(self, state: State, assertions: DataFrame, batch: DataFrame, mentions: DataFrame) -> None:
        if self._read(state, "entities") is None:
            return
        current, touched = self._read(state, "edges"), assertions.select(self._bucket(*gr.EDGE).alias(BUCKET))
        if current is not None:
            owned = current.join(
                batch.select(F.col("doc_id").alias("source_document")), "source_document", "left_semi"
            )
            touched = touched.unionByName(owned.select(BUCKET))
        touched = self._touched(touched)
        if not touched:
            return
        edges = gr.upsert_edges(self._read(state, "edges", touched), assertions, self._seen_entities(state, mentions), batch)
        self._write(state, edges.withColumn(BUCKET, self._bucket(*gr.EDGE)), "edges", touched)

    def _seen_entities(self, state: State, mentions: DataFrame) -> DataFrame:
        """Stored entities with the write that first made them visible in this batch.

        An entity new to the batch counts from its first mention; one that was
        there before counts from the start.
        """
        seen = mentions.groupBy("label", "key").agg(
            F.min(gr.write_order()).alias("first_seen"), F.max("is_new").alias("is_new")
        )
        before = gr.before_batch(mentions)
        stored = self._read(state, "entities").select("label", "key")
        return stored.join(seen, ["label", "key"], "left").select(
            "label", "key", F.when(F.col("is_new"), F.col("first_seen")).otherwise(before).alias("first_seen")
        )

    def mark_new(self, mentions: DataFrame) -> DataFrame:
        """Flags mentions of entities the store does not hold yet. Store the result before applying it."""
        current = self.read("entities")
        if current is None:
            return mentions.withColumn("is_new", F.lit(True))
        known = current.select("label", "key").withColumn("known", F.lit(True))
        return mentions.join(known, ["label", "key"], "left").withColumn("is_new", F.col("known").isNull()).drop("known")

    def broken_keys(self) -> DataFrame:
        """K7 for all tables: (table, key, n) rows of violated uniqueness rules."""
        checks = {
            "documents": ("doc_id",),
            "chunks": ("id",),
            "entities": ("label", "key"),
            "edges": gr.EDGE,
        }
        out = None
        for table, key in checks.items():
            stored = self.read(table)
            if stored is None:
                continue
            rows = gr.duplicate_keys(stored, *key).select(
                F.lit(table).alias("table"), F.concat_ws(" | ", *key).alias("key"), "n"
            )
            out = rows if out is None else out.unionByName(rows)
        return out
