"""Corpora derived from the given tables, each by Spark and by the same SQL for the check.

The tables hold plain prose. Lines are given heading, clause or fence markers by
their length, so that every structural chunker has its structures to find in
whole, real texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Document class by language.
CLASS_OF_LANG = {"en": "architecture", "fr": "regulatory", "de": "security", "es": "code"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_type(lang=None):
    lang = F.col("lang") if lang is None else lang
    return F.create_map(*[F.lit(x) for pair in CLASS_OF_LANG.items() for x in pair])[lang]


DOC_TYPE_SQL = (
    "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_OF_LANG.items()) + " END"
)


def _mark_line(line, index):
    n = F.length(line)
    return (
        F.when((n >= 60) & (n < 66), F.concat(F.lit("```\n# "), line, F.lit("\n```")))
        .when((n >= 66) & (n < 70), F.concat(F.lit("~~~\n"), line, F.lit("\n~~~")))
        .when(
            F.col("doc_type").isin("regulatory", "security"),
            F.when(n < 20, F.concat(F.lit("## "), line))
            .when(n < 26, F.concat(F.lit("#### "), line))
            .when(n < 60, F.concat(F.lit("### Clause "), index.cast("string")))
            .otherwise(line),
        )
        .when(n < 16, F.concat(F.lit("# "), line))
        .when(n < 40, F.concat(F.lit("## "), line))
        .when(n < 60, F.concat(F.lit("### "), line))
        .otherwise(line)
    )


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as markdown: doc_id, doc_type, title, source_path, text."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_type", doc_type())
    marked = F.array_join(F.transform(F.split("text", "\n"), _mark_line), "\n\n")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "doc_type",
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("data/"), "doc_type", F.lit("/"), "source", F.lit("-"), "doc_id", F.lit(".md")).alias(
            "source_path"
        ),
        marked.alias("text"),
    )


MARKDOWN_SQL = f"""
typed AS (SELECT *, {DOC_TYPE_SQL} AS doc_type FROM documents),
markdown AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_type,
         'Document ' || doc_id AS title,
         'data/' || doc_type || '/' || source || '-' || doc_id || '.md' AS source_path,
         array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
           CASE WHEN length(line) >= 60 AND length(line) < 66
                THEN '```' || chr(10) || '# ' || line || chr(10) || '```'
                WHEN length(line) >= 66 AND length(line) < 70
                THEN '~~~' || chr(10) || line || chr(10) || '~~~'
                WHEN doc_type IN ('regulatory', 'security') THEN
                  CASE WHEN length(line) < 20 THEN '## ' || line
                       WHEN length(line) < 26 THEN '#### ' || line
                       WHEN length(line) < 60 THEN '### Clause ' || (i - 1)
                       ELSE line END
                WHEN length(line) < 16 THEN '# ' || line
                WHEN length(line) < 40 THEN '## ' || line
                WHEN length(line) < 60 THEN '### ' || line
                ELSE line END), chr(10) || chr(10)) AS text
  FROM typed)
"""
