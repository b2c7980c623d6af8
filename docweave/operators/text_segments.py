"""K6, R2: a full-text index that grows by batches.

Every batch writes one immutable segment: its documents, dealt to ranges of similar length, and for each term and
range one row with the postings and their largest count and smallest length. From these an upper score of the
range follows for any query, whatever the corpus statistics have become, so a search reads whole ranges only
where the upper score reaches the k-th best score found so far. Documents that a batch replaces are marked dead,
with their terms counted, so that statistics are those of the living documents, exactly.

A row in the table of segments, appended last, makes a segment part of the index: a batch that was cut off leaves
nothing behind that a search would see, and a batch that is there already is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import retrieval as rt
from docweave.operators.joins import broadcast_if_small

RANGE_DOCS = 4_096
# Ranges with the largest upper scores that are searched first, for a score to beat.
FIRST_RANGES = 4
# Up to so many ranges are named in the filter of the scan; more are joined.
NAMED_RANGES = 500
_SEGMENTS = "segment string, batch string, n_docs long, n_words long, dead_docs long, dead_words long"


class TextSegments:
    """The index under ``path``; ``search`` answers as an index written afresh over the living documents would."""

    def __init__(self, spark: SparkSession, path: str, range_docs: int = RANGE_DOCS):
        self.spark, self.path, self.range_docs = spark, path.rstrip("/"), range_docs
        self.ranges_read = 0

    def _table(self, pattern: str, schema: str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read.option("basePath", f"{self.path}/data")
            return (reader.schema(schema) if schema else reader).parquet(pattern)
        except AnalysisException as exc:
            if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def segments(self) -> list:
        """One row per segment, in the order in which they were added: as many as batches."""
        try:
            rows = self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/segments")
            return rows.select("*", F.col("_metadata.file_modification_time").alias("added")).orderBy("added").collect()
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _read(self, kind: str, segments: Sequence) -> DataFrame | None:
        """A table of all given segments, with the column ``segment``; None without any."""
        if not segments:
            return None
        reader = self.spark.read.option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/segment={s['segment']}/{kind}" for s in segments])

    def add(self, chunks: DataFrame, batch: str, key: str = "doc_id") -> None:
        """Indexes ``chunks`` (id, text, ``key``) as one segment; earlier rows of the same keys are dead from then on.

        Null texts have no words but count as documents. A batch name that is there already changes nothing.
        """
        known = self.segments()
        if any(s["batch"] == batch for s in known):
            return
        segment = uuid.uuid4().hex
        folder = f"{self.path}/data/segment={segment}"
        counted = chunks.select("id", F.col(key).alias("owner"), tx.tokens(F.coalesce("text", F.lit(""))).alias("toks"))
        counted = counted.select("id", "owner", F.size("toks").alias("length"), rt.term_frequencies(F.col("toks")).alias("entries"))
        counted.write.parquet(f"{folder}/counted")
        stored = self.spark.read.schema(counted.schema).parquet(f"{folder}/counted")
        n_docs, n_words = stored.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        ranges = max(1, -(-n_docs // self.range_docs))
        by_length = stored.repartitionByRange(ranges, "length", "id").withColumn("range", F.spark_partition_id())
        by_length.write.parquet(f"{folder}/documents")  # ranges are what was written, not what a second run would deal
        placed = self.spark.read.schema(by_length.schema).parquet(f"{folder}/documents")
        entries = placed.select("range", "id", "length", F.explode("entries").alias("e"))
        posting = F.struct("id", F.col("e.tf").alias("tf"), "length")
        lists = entries.groupBy(F.col("e.term").alias("term"), "range").agg(
            F.collect_list(posting).alias("postings"), F.count("*").alias("n"), F.max("e.tf").alias("most"), F.min("length").alias("least")
        )
        lists.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.parquet(f"{folder}/postings")

        # What this batch replaces: living rows of its keys in the segments before it.
        earlier = self._read("documents", known)
        dead_docs = dead_words = 0
        if earlier is not None:
            owners = broadcast_if_small(placed.select("owner").distinct())
            dead = self._living(earlier, known, "id").join(owners, "owner", "left_semi")
            dead.select(F.col("segment").alias("of"), "id", "length", "entries").write.parquet(f"{folder}/dead")
            dead = self.spark.read.parquet(f"{folder}/dead")
            dead_docs, dead_words = dead.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            gone = dead.select(F.explode("entries").alias("e")).groupBy(F.col("e.term").alias("term")).agg(F.count("*").alias("n"))
            gone.sortWithinPartitions("term").write.parquet(f"{folder}/dead_terms")
        row = [(segment, batch, n_docs, n_words, dead_docs, dead_words)]
        self.spark.createDataFrame(row, _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _living(self, rows: DataFrame, segments: Sequence, id_column: str) -> DataFrame:
        marking = [s for s in segments if s["dead_docs"]]
        if not marking:
            return rows
        dead = self._read("dead", marking).select(F.col("of").alias("segment"), F.col("id").alias(id_column))
        return rows.join(broadcast_if_small(dead), ["segment", id_column], "left_anti")

    def search(self, query: str, k: int) -> DataFrame:
        """R2: id, score, rank of the ``k`` best living documents; a query without known terms finds nothing."""
        segments, terms = self.segments(), rt.query_terms(query)
        lists = self._read("postings", segments)
        if lists is None:
            return self.spark.createDataFrame([], "id string, score double, rank int")
        lists = lists.where(F.col("term").isin(*sorted(terms)))
        none = lists.select(F.col("postings.id")[0].alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        n_docs = sum(s["n_docs"] - s["dead_docs"] for s in segments)
        mean = sum(s["n_words"] - s["dead_words"] for s in segments) / max(1, n_docs) or 1.0
        df = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        marking = [s for s in segments if s["dead_docs"]]
        if marking and df:
            gone = self._read("dead_terms", marking).where(F.col("term").isin(*sorted(df)))
            for r in gone.groupBy("term").agg(F.sum("n").alias("n")).collect():
                df[r["term"]] -= r["n"]
        weights = {t: terms[t] * rt.idf(n_docs, n) for t, n in df.items() if n > 0}
        if not weights:
            return none
        weight = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])[F.col("term")]
        lists = lists.where(F.col("term").isin(*sorted(weights)))
        upper = F.sum(weight * rt.bm25_weight(F.col("most"), F.col("least"), mean)).alias("upper")
        bounds = lists.groupBy("segment", "range").agg(upper)

        def scored(chosen: DataFrame) -> DataFrame:
            """Exact scores of the living documents of the chosen (segment, range) rows."""
            few = chosen.limit(NAMED_RANGES + 1).collect()
            if len(few) <= NAMED_RANGES:
                self.ranges_read += len(few)
                # Named apart as well, so that the scan skips files and row groups.
                part = lists.where(F.col("segment").isin({r["segment"] for r in few}) & F.col("range").isin({r["range"] for r in few}))
                part = part.join(F.broadcast(self.spark.createDataFrame([(r["segment"], r["range"]) for r in few] or [("", -1)], "segment string, range int")), ["segment", "range"])
            else:
                part = lists.join(chosen, ["segment", "range"], "left_semi")
            postings = part.select("segment", weight.alias("weight"), F.explode("postings").alias("p")).select("segment", "weight", "p.*")
            value = F.col("weight") * rt.bm25_weight(F.col("tf"), F.col("length"), mean)
            sums = postings.groupBy("segment", "id").agg(F.sum(value).alias("score"))
            return self._living(sums, segments, "id").select("id", "score")

        digits = F.round("score", rt.SCORE_DIGITS)
        first = bounds.orderBy(F.desc("upper"), "segment", "range").limit(FIRST_RANGES).collect()
        begun = self.spark.createDataFrame([(r["segment"], r["range"]) for r in first], "segment string, range int")
        best = scored(begun).orderBy(F.desc(digits), "id").limit(k).collect()
        floor = min(r["score"] for r in best) if len(best) == k else 0.0
        seen = self.spark.createDataFrame([tuple(r) for r in best], scored(begun).schema)
        rest = bounds.where(F.col("upper") >= floor - 10.0**-rt.SCORE_DIGITS).join(F.broadcast(begun), ["segment", "range"], "left_anti")
        found = seen.unionByName(scored(rest.select("segment", "range")))
        return rt._ranked(found.orderBy(F.desc(digits), "id").limit(k))
