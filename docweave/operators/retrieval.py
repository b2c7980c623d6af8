"""Dense and sparse top-k, reciprocal-rank fusion, context merging."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions import vector as vec
from docweave.session import stored

# BM25 saturation and length normalization.
BM25_K1 = 1.2
BM25_B = 0.75

# Scores that agree to this many digits are ties, however the sums were ordered.
SCORE_DIGITS = 9

RESULT_COLUMNS = ("section", "clause", "code_ref")


def _ranked(top: DataFrame) -> DataFrame:
    """Adds the rank by (score, id) to a list that is already cut to its top rows."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", SCORE_DIGITS)), "id")
    return top.withColumn("rank", F.row_number().over(order))


def dense_top_k(chunks: DataFrame, query: Sequence[float], k: int, vector: str = "embedding") -> DataFrame:
    """Exact cosine top-k: id, cosine, score (cosine mapped to 0..1), rank.

    Only ids and vectors are read, each task keeps its k best, and one task
    merges k rows per task.
    """
    scored = chunks.select("id", vec.cosine_to(query)(vector).alias("cosine"))
    # Rows without a usable vector sort last and are dropped behind the limit,
    # so the scoring function appears in the plan once.
    top = scored.orderBy(F.desc_nulls_last(F.round("cosine", SCORE_DIGITS)), "id").limit(k)
    return _ranked(top.where(F.col("cosine").isNotNull()).withColumn("score", vec.similarity_score(F.col("cosine"))))


# -------------------------------------------------------------------- sparse


def query_terms(query: str) -> Counter:
    """Index terms of a query with their multiplicity; operators words count as plain terms."""
    return Counter(re.findall(r"\w+", query.lower()))


def idf(n_docs: Column | float, df: Column | float):
    ratio = (n_docs - df + 0.5) / (df + 0.5)
    return F.log1p(ratio) if isinstance(ratio, Column) else math.log1p(ratio)


def bm25_weight(tf: Column, length: Column, mean_length: Column | float) -> Column:
    return tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))


def bm25_top_k(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """R2 straight from the texts: id, score, rank. An empty query finds nothing.

    Two scans and no shuffle but of one statistics row per task: the first
    counts documents, lengths and the document frequency of each query term;
    the second scores inside the row and keeps the best. See TextIndex for
    searching stored postings.
    """
    terms = query_terms(query)
    names = sorted(terms)
    if not names:
        return _ranked(chunks.select("id", F.lit(0.0).alias("score")).limit(0))
    hits = F.filter("toks", lambda t: t.isin(*names))
    counted = chunks.select("id", tx.tokens(F.col("text")).alias("toks")).select(
        "id", F.size("toks").alias("length"), hits.alias("hits")
    )
    stats = counted.agg(
        F.count("*").alias("n"),
        F.avg("length").alias("mean"),
        *[F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(names)],
    ).first()
    score = F.lit(0.0)
    for i, t in enumerate(names):
        tf = F.size("hits") - F.size(F.array_remove("hits", t))
        weight = terms[t] * idf(stats["n"], stats[f"df{i}"])
        score = score + F.lit(weight) * bm25_weight(tf, F.col("length"), stats["mean"] or 1.0)
    # Chunks without a hit sort last and are dropped behind the limit: a filter
    # before it would move below the tokenizer and repeat its work.
    scored = counted.select("id", F.when(F.size("hits") > 0, score).alias("score"))
    top = scored.orderBy(F.desc_nulls_last(F.round("score", SCORE_DIGITS)), "id").limit(k)
    return _ranked(top.where(F.col("score").isNotNull()))


def term_frequencies(toks: Column) -> Column:
    """Distinct terms of a token array with their counts, from one sort inside the row."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )
        return tx.let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, j: F.struct(
                    F.get(ordered, at - 1).alias("term"),
                    (F.coalesce(F.get(s, j + 1), n + 1) - at).alias("tf"),
                ),
            ),
        )

    return F.when(F.size(toks) > 0, tx.let(F.sort_array(toks), runs))


def postings(chunks: DataFrame) -> DataFrame:
    """K6 full-text index rows: term, id, tf, length. Narrow: counting happens inside the row."""
    toks = chunks.select("id", tx.tokens(F.col("text")).alias("toks"))
    entries = toks.select(
        "id", F.size("toks").alias("length"), F.explode(term_frequencies(F.col("toks"))).alias("e")
    )
    return entries.select("e.term", "id", "e.tf", "length")


class TextIndex:
    """A stored full-text index: postings clustered by term, plus one row of corpus statistics."""

    def __init__(self, entries: DataFrame, n_docs: int, mean_length: float):
        self.entries, self.n_docs, self.mean_length = entries, n_docs, mean_length

    @staticmethod
    def write(chunks: DataFrame, path: str) -> None:
        """Range-clusters by (term, id), so a search prunes to its terms' row groups and the
        postings of a frequent term spread over many files.

        Texts are tokenized once: the range bounds, the sort and the statistics read the
        postings back from a stored table.
        """
        entries = stored(postings(chunks), "postings")
        entries.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(
            f"{path}/postings"
        )
        n_docs = chunks.count()
        total = entries.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"))
        stats = total.select(
            F.lit(n_docs).cast("long").alias("n_docs"), (F.col("n") / F.lit(max(1, n_docs))).alias("mean_length")
        )
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark, path: str) -> "TextIndex":
        stats = spark.read.parquet(f"{path}/stats").first()
        return cls(spark.read.parquet(f"{path}/postings"), stats["n_docs"], stats["mean_length"] or 1.0)

    def search(self, query: str, k: int) -> DataFrame:
        """R2 over the index; reads only the postings of the query's terms."""
        terms = query_terms(query)
        found = self.entries.where(F.col("term").isin(*sorted(terms)))
        df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
        weights = {t: terms[t] * idf(self.n_docs, n) for t, n in df.items()}
        if not weights:
            return _ranked(found.select("id", F.lit(0.0).alias("score")).limit(0))
        weight = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])[F.col("term")]
        scored = found.groupBy("id").agg(
            F.sum(weight * bm25_weight(F.col("tf"), F.col("length"), self.mean_length)).alias("score")
        )
        return _ranked(scored.orderBy(F.desc(F.round("score", SCORE_DIGITS)), "id").limit(k))


# -------------------------------------------------------------------- fusion


def reciprocal_rank_fusion(*ranked: DataFrame, k: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Id, score of its first list, rrf_score, fused rank; ties keep first-seen order.

    Lists carry id, score and rank; rows without an id take up a rank but are
    dropped. ``by`` names the columns telling several queries apart.
    """
    lists = [
        r.select(*by, "id", "score", F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("seen"))
        for i, r in enumerate(ranked)
    ]
    rows = reduce(DataFrame.unionByName, lists).where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    fused = rows.groupBy(*by, "id").agg(
        F.sum(1.0 / (k + F.col("seen.rank"))).alias("rrf_score"),
        F.min_by("score", "seen").alias("score"),
        F.min("seen").alias("seen"),
    )
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(F.round("rrf_score", 12)), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def search(
    chunks: DataFrame,
    query: str,
    query_vector: Sequence[float],
    mode: str = "hybrid",
    k: int = 8,
    rrf_k: int = 60,
    index: TextIndex | None = None,
) -> DataFrame:
    """``vector`` is the dense list alone; any other mode fuses dense and sparse, then cuts to k."""
    dense = dense_top_k(chunks, query_vector, k)
    if mode == "vector":
        return dense.select("id", "score", F.lit(None).cast("double").alias("rrf_score"), "rank")
    sparse = index.search(query, k) if index else bm25_top_k(chunks, query, k)
    fused = reciprocal_rank_fusion(dense, sparse, k=rrf_k).where(F.col("rank") <= k)
    return fused.select("id", "score", "rrf_score", "rank")


def pin(top: DataFrame) -> DataFrame:
    """The k rows of a result as local rows, so that what is joined to them does not search again."""
    return top.sparkSession.createDataFrame(top.collect(), top.schema)


def fetch_chunks(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """result rows with text and location, NULLs as empty strings. ``top`` holds at most k rows.

    Their ids are named in the scan, so that row groups without any of them are skipped.
    """
    top = pin(top)
    chunks = chunks.where(F.col("id").isin(*[r["id"] for r in top.select("id").collect()]))
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", *RESULT_COLUMNS)]
    return chunks.join(F.broadcast(top), "id").select(
        "id",
        *text,
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        F.lit("chunk").alias("kind"),
        *[c for c in top.columns if c not in ("id", "score")],
    )


def merge_context(rows: DataFrame, order: str, cap: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """First occurrence of every id with its position in the context.

    With ``cap``, the first so many positions only; each task then sends no
    more of a context. First occurrences come from a pre-aggregated minimum.
    """
    named = rows.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    payload = [c for c in rows.columns if c not in (*by, "id", order)]
    first = named.groupBy(*by, "id").agg(
        F.min(F.struct(order, *payload)).alias("row")
    ).select(*by, "id", "row.*")
    window = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order, "id")
    placed = first.withColumn("position", F.row_number().over(window))
    return placed if cap is None else placed.where(F.col("position") <= cap)


def render_context(rows: DataFrame, limit: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """one text per context: "[position] (label) text", blank-line separated, texts in full without a limit."""
    text = F.coalesce("text", F.lit(""))
    label = tx.context_label(F.col("section"), F.col("code_ref"), F.col("id").cast("string"))
    line = F.concat(
        F.lit("["), F.col("position").cast("string"), F.lit("] ("), label, F.lit(") "),
        text if limit is None else F.substring(text, 1, limit),
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n\n").alias("context")
    )
