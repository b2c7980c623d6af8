"""Benchmark passages in documents: exact similarity of every item-sized window that can reach it, with SimHash distance.

A window that reaches the similarity has a least number of shingles in common with its item, wherever they stand in
either. So for each document and item the places of shared shingles are listed, and every window that holds that many
is compared, exactly, by the weighted shingles. Windows are as long as the item (the whole document where that is
shorter). The best window and its item get a 64-bit SimHash over their words; its distance is reported and settles
ties, but decides nothing else, as no radius is sure to hold all windows at the similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import let, table, written

WORDS = 5
SIMILARITY = 0.8
BITS = 64
# Up to so many shingles of all items (16 bytes each) go to all tasks; beyond it both sides are shuffled by shingle.
BROADCAST_SHINGLES = 500_000
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none for shorter texts."""

    def all_runs(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    return let(words, all_runs)


def simhash(words: Column) -> Column:
    """64 bits; each is the sign of the sum of that bit over the hashes of all words."""

    def bit(hashes: Column, place: int) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.shiftright(h, place).bitwiseAND(1) == 1))
        return F.when(2 * ones > F.size(hashes), F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint")

    def bits(hashes: Column) -> Column:
        return reduce(Column.bitwiseOR, [bit(hashes, place) for place in range(BITS)])

    return let(F.transform(words, lambda w: F.xxhash64(w)), bits)


def blocks(fingerprint: Column, radius: int) -> Column:
    """(block, value) structs: the fingerprint in ``radius + 1`` runs of bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    cut = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, low).bitwiseAND((1 << (high - low)) - 1).alias("value"))
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]
    return F.array(*cut)


def benchmark_items(benchmark: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """(item_id, words, n_words): one row per distinct word sequence of at least ``size`` words, with its smallest id."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("item_id"), words_of(F.col(text_column)).alias("words"))
    rows = rows.filter(F.col("item_id").isNotNull() & (F.size("words") >= size))
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id")).withColumn("n_words", F.size("words"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): the best window of each document for each item.

    ``start`` counts words. Documents are told apart by id and text; rows equal in both give one result row, a
    null id stays null. Null texts, and items or documents of fewer than ``words`` words, match nothing; equal
    items are reported under the smallest id. Other columns are not looked at.
    """
    items = written(benchmark_items(benchmark, item_id_column, item_text_column, words), "items")
    size = F.col("n_words") - words + 1
    seeds = items.select("item_id", "n_words", F.explode(shingle_hashes(F.col("words"), words)).alias("shingle"))
    seeds = written(seeds.groupBy("item_id", "n_words", "shingle").agg(F.count("*").cast("int").alias("m")), "seeds")
    shared = seeds.select("shingle").distinct()
    if seeds.count() <= BROADCAST_SHINGLES:
        shared, seeds = F.broadcast(shared), F.broadcast(seeds)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("text_key", F.xxhash64("text"))
    all_runs = rows.select("doc_id", "text_key", shingle_hashes(words_of(F.col("text")), words).alias("runs"))
    placed = all_runs.select("doc_id", "text_key", F.size("runs").alias("total"), F.posexplode("runs").alias("position", "shingle"))
    hits = written(placed.join(shared, "shingle", "left_semi"), "hits")
    # Of the places of a shingle that the item has m times, one counts in windows that begin behind the m-th place before it.
    pair = ["doc_id", "text_key", "total", "item_id", "n_words"]
    places = hits.join(seeds, "shingle").groupBy(*pair, "shingle", "m").agg(F.sort_array(F.collect_set("position")).alias("at"))
    behind = lambda p, i: F.struct(p.alias("position"), F.when(i >= F.col("m"), F.get("at", i - F.col("m"))).otherwise(-1).alias("before"))
    listed = places.select(*pair, F.transform("at", behind).alias("hits")).groupBy(*pair).agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    # So many shingles a window at the similarity has in common with the item.
    weight = F.least(size, F.col("total"))
    least = F.ceil(similarity * (weight + size) / (1 + similarity) - 1e-9).cast("int")
    listed = listed.select("*", size.alias("size"), weight.alias("weight"), least.alias("least")).filter(F.size("hits") >= F.col("least"))
    listed = written(listed, "places")

    def starting(i: Column) -> Column:
        """(both, start) of all windows whose first hit is the i-th and that hold at least ``least`` hits."""
        first, last = F.get("hits", i)["position"], F.get("hits", i + F.col("least") - 1)["position"]
        low = F.greatest(F.coalesce(F.get("hits", i - 1)["position"] + 1, F.lit(0)), last - F.col("size") + 1, F.lit(0))
        high = F.least(first, F.greatest(F.col("total") - F.col("size"), F.lit(0)))
        inside = lambda s: lambda h: (h["position"] < s + F.col("size")) & (h["before"] < s)
        count = lambda s: F.size(F.filter(F.slice("hits", i + 1, F.col("size")), inside(s)))
        counts = F.transform(F.sequence(low, high), lambda s: F.struct(count(s).alias("both"), s.alias("start")))
        return F.when(low <= high, counts).otherwise(F.array().cast("array<struct<both:int,start:int>>"))

    tried = listed.select(*pair, "size", "weight", "least", F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - F.col("least")), starting)).alias("tried"))
    most = F.array_max(F.transform("tried", lambda w: w["both"]))
    tried = tried.withColumn("both", most).filter(F.col("both") >= F.col("least"))
    value = F.col("both") / (F.col("weight") + F.col("size") - F.col("both"))
    best = F.explode(F.filter("tried", lambda w: w["both"] == F.col("both"))).alias("w")
    spots = tried.withColumn("similarity", value).filter(F.col("similarity") >= similarity)
    spots = spots.select("doc_id", "text_key", "item_id", "n_words", "similarity", best).withColumn("start", F.col("w.start")).drop("w")
    spots = written(spots, "spots")

    # The few documents with such windows are read again for their words.
    holders = spots.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "start", "n_words", "similarity")).alias("spots"))
    holders = holders.select(F.col("doc_id").alias("held_id"), F.col("text_key").alias("held_key"), "spots")
    if spots.count() <= BROADCAST_WINDOWS:
        holders = F.broadcast(holders)
    found = rows.join(holders, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key")))
    texts = found.select("doc_id", "text_key", words_of(F.col("text")).alias("words"), "spots").dropDuplicates(["doc_id", "text_key"])
    cut = let(
        F.struct("words", "spots"),
        lambda s: F.transform(s["spots"], lambda p: p.withField("words", F.slice(s["words"], p["start"] + 1, p["n_words"]))),
    )
    windows = texts.select("doc_id", "text_key", F.explode(cut).alias("w")).select("doc_id", "text_key", "w.*")
    windows = windows.select("doc_id", "text_key", "item_id", "start", "similarity", F.size("words").alias("length"), simhash(F.col("words")).alias("fingerprint"))
    prints = written(items.select("item_id", simhash(F.col("words")).alias("item_print")), "fingerprints")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    scored = windows.join(prints, "item_id").withColumn("distance", distance)
    closest = F.min(F.struct("distance", "start", "length")).alias("best")
    result = scored.groupBy("doc_id", "text_key", "item_id").agg(closest, F.first("similarity").alias("similarity"))
    return result.select(
        "doc_id", "item_id", F.col("best.start").cast("int").alias("start"), F.col("best.length").cast("int").alias("n_words"),
        F.col("best.distance").cast("int").alias("distance"), "similarity", "text_key",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")
