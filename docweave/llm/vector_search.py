"""Approximate nearest neighbours by cosine: balanced posting lists behind a graph of centroids.

Centroids are fitted on a bounded sample by k-means that charges crowded clusters. Every vector goes to the list
of its nearest centroid, and near a boundary to further lists as well: those not much farther away that no
chosen centroid lies closer to. Centroids are found by best-first search in a graph of near neighbours. A query
opens the lists whose centroids are at most ``ratio`` times as far as the nearest. Lists longer than a block are
cut into blocks that are searched alike, so that no list is ever one task's burden.

Equal vectors are one entry that carries its smallest ids, as many as an answer can use.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import table, written

SAMPLE_ROWS = 20_000
LIST_ROWS = 100
# Centroids and their graph go to every task: 16,384 of 1,000 dimensions are 64 MB.
MAX_CENTROIDS = 16_384
BLOCK_ROWS = 2_000
GRAPH_LINKS = 16
BEAM = 96
REPLICATE_RATIO = 1.15
MAX_REPLICAS = 6
SEARCH_RATIO = 1.25
LEAST_LISTS = 16


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def balanced_centroids(sample: np.ndarray, count: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of ``sample`` (unit vectors); a cluster's vectors pay for every one above its even share."""
    draw = np.random.default_rng(seed)
    count = min(count, len(sample))
    centroids = sample[draw.choice(len(sample), count, replace=False)].copy()
    charge = np.zeros(count)
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T - charge).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        sizes = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = sizes == 0
        sums[empty] = sample[draw.choice(len(sample), int(empty.sum()))]
        centroids = _unit(sums)
        charge += 0.02 * (sizes / max(1.0, len(sample) / count) - 1.0)
        charge = np.clip(charge, 0.0, 0.2)
    return centroids


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> "CentroidGraph":
        """Each centroid is linked to its nearest ones and to a few at random, which keep the graph connected."""
        k = min(GRAPH_LINKS, len(centroids) - 1)
        near = np.zeros((len(centroids), k), dtype=np.int64)
        for start in range(0, len(centroids), 1024):
            likeness = centroids[start : start + 1024] @ centroids.T
            likeness[np.arange(len(likeness)), np.arange(start, start + len(likeness))] = -np.inf
            if k:
                near[start : start + 1024] = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        ring = (np.arange(len(centroids)) + 1) % len(centroids)
        far = np.random.default_rng(3).integers(0, len(centroids), size=(len(centroids), 3))
        return cls(centroids, np.concatenate([near, ring[:, None], far], axis=1))

    def nearest(self, vector: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of about the ``beam`` nearest, nearest first."""
        n = len(self.centroids)
        if n <= beam:
            likeness = self.centroids @ vector
            order = np.argsort(-likeness, kind="stable")
        else:
            seen = np.zeros(n, dtype=bool)
            entries = np.linspace(0, n - 1, 8).astype(np.int64)
            seen[entries] = True
            found = self.centroids[entries] @ vector
            waiting = [(-s, e) for s, e in zip(found.tolist(), entries.tolist())]
            heapq.heapify(waiting)
            best = [(s, e) for s, e in zip(found.tolist(), entries.tolist())]
            heapq.heapify(best)
            while waiting:
                score, place = heapq.heappop(waiting)
                if len(best) >= beam and -score < best[0][0]:
                    break
                fresh = self.links[place]
                fresh = np.unique(fresh[~seen[fresh]])
                seen[fresh] = True
                for s, e in zip((self.centroids[fresh] @ vector).tolist(), fresh.tolist()):
                    if len(best) < beam or s > best[0][0]:
                        heapq.heappush(waiting, (-s, e))
                        heapq.heappush(best, (s, e))
                        if len(best) > beam:
                            heapq.heappop(best)
            order = np.array([e for _, e in sorted(best, reverse=True)], dtype=np.int64)
            likeness = None
        likeness = self.centroids[order] @ vector
        return order, np.sqrt(np.maximum(2.0 - 2.0 * likeness, 0.0))

    def lists_of(self, vector: np.ndarray) -> list[int]:
        """The lists that hold ``vector``: the nearest, and others near the boundary that no chosen centroid is closer to."""
        order, distance = self.nearest(vector, 32)
        chosen = [0]
        for i in range(1, len(order)):
            if len(chosen) >= MAX_REPLICAS or distance[i] > REPLICATE_RATIO * distance[0]:
                break
            between = 2.0 - 2.0 * self.centroids[order[chosen]] @ self.centroids[order[i]]
            if (between > distance[i] ** 2 * 0.5).all():
                chosen.append(i)
        return order[chosen].tolist()

    def probes(self, vector: np.ndarray) -> list[int]:
        """The lists to search: all within the ratio of the nearest one's distance, and the first few."""
        order, distance = self.nearest(vector)
        within = distance <= SEARCH_RATIO * distance[0]
        within[:LEAST_LISTS] = True
        return order[within].tolist()


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: all components finite, not all zero, of the commonest length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.filter(F.size("vector") == (lengths["length"] if lengths else 0)).distinct()


def _top(queries: np.ndarray, rows: np.ndarray, nodes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``k`` rows of largest cosine, ties to the smaller node, and their scores."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    for query in queries:
        rough = rows @ query / norms
        if len(rough) > k:
            picked = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, np.abs(query).max()))
        else:
            picked = np.arange(len(rough))
        # The same sum for the same two vectors, whatever block they meet in.
        exact = (rows[picked] * query).sum(axis=1) / (norms[picked] * np.sqrt((query * query).sum()))
        order = np.lexsort((nodes[picked], -exact))[:k]
        yield picked[order], exact[order]


def nearest_neighbours(
    vectors: DataFrame, is_query, neighbours: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", list_rows: int = LIST_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every query row, without itself.

    ``is_query`` maps the id column to a condition. Score is the cosine in double precision. Rows with a null
    id, or a vector that is null, zero, of a length other than the commonest, or holds a null or non-finite
    component, take no part; repeated rows count once. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    keep = neighbours + 1
    rows = written(usable(vectors, id_column, vector_column), "usable")
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= keep)
    entries = written(few.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vector").join(entries.select("vector", "node"), "vector")
    asked = written(asked.select("query_id", "node"), "asked")
    questions = entries.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vector")

    total = entries.count()
    sample = entries.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("vector").toPandas()
    matrix = _unit(np.array(sample.vector.tolist(), dtype=float)) if len(sample) else np.ones((1, 1))
    count = int(np.clip(total // list_rows, 1, min(MAX_CENTROIDS, max(1, len(matrix) // 8))))
    graph = spark.sparkContext.broadcast(CentroidGraph.build(balanced_centroids(matrix, count)))

    def lists(choose):
        @F.pandas_udf("array<long>")
        def run(column: pd.Series) -> pd.Series:
            units = _unit(np.array(column.tolist(), dtype=float))
            return pd.Series([choose(graph.value, v) for v in units])

        return run("vector")

    postings = written(entries.select("node", "vector", F.explode(lists(CentroidGraph.lists_of)).alias("list")), "postings")
    probes = written(questions.select("node", "vector", F.explode(lists(CentroidGraph.probes)).alias("list")), "probes")
    cuts = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # a row per centroid
    cuts = F.broadcast(written(cuts, "cuts"))
    placed = postings.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    opened = probes.join(cuts, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "node": [], "score": []}).astype({"query": "int64", "node": "int64"})
        nodes = right.node.to_numpy()
        found = list(_top(np.array(left.vector.tolist()), np.array(right.vector.tolist()), nodes, keep))
        return pd.DataFrame(
            {
                "query": np.repeat(left.node.to_numpy(), [len(p) for p, _ in found]),
                "node": nodes[np.concatenate([p for p, _ in found])],
                "score": np.concatenate([s for _, s in found]),
            }
        )

    met = opened.groupBy("list", "block").cogroup(placed.groupBy("list", "block")).applyInPandas(search, "query long, node long, score double")
    met = written(met, "met").distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    top = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep).drop("place")
    top = written(top.join(entries.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id")), "top")
    answers = asked.join(top, asked["node"] == top["query"]).filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
