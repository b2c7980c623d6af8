"""A corpus from raw documents to token ids: toxicity, near copies, benchmark passages, personal data, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontamination, near_dedup, pii, piece_codec, toxicity
from docweave.llm.common import small_batches, table, work_folder, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, under a model of these documents and the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(docs, model) < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies: the one with the smallest id. Rows without an id stay."""
    classes = near_dedup.near_duplicates(docs)
    # A row stays if its id names its class; of rows that share that id, copies of one text stay once.
    named = classes.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = written(named, "kept")
    single = docs.join(kept.filter("n = 1"), "doc_id", "left_semi")
    repeated = docs.join(kept.filter("n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).unionByName(docs.filter("doc_id IS NULL"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id"), "text_key")
    found = written(found.distinct(), "contaminated").alias("found")
    same = F.col("docs.doc_id").eqNullSafe(F.col("found.found_id")) & (F.xxhash64("docs.text") == F.col("found.text_key"))
    return docs.alias("docs").join(found, same, "left_anti")


def clear_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with personal data and terms that disclose it generalised or removed."""
    marked = pii.private_spans(docs)
    clean = pii.sanitised(F.col("text"), F.concat("pii_base", "pii_terms"))
    return marked.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).drop("pii_base", "pii_terms")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining document and what they decode to, as digests."""
    return piece_codec.encode_decode(docs, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("pii", clear_personal_data),
    ("sentencepiece", to_pieces),
]

# Viterbi decoding, signatures and merges are not in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, f"stage-{name}")
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
