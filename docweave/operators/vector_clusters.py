"""A stored layout of vectors for exact cosine top-k that reads few of them.

Rows are kept by cluster, and of every cluster its centre and radius among unit vectors. A vector is at least as far
from a question as the centre is, less the radius: a cluster whose nearest possible vector is farther than the k-th
best found so far is not read. The result is that of a full scan, whatever the clusters are; they decide only how
much is read. Centres are fitted on a bounded sample; every row is placed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import vector as vec
from docweave.operators import retrieval as rt

SAMPLE_ROWS = 10_000
# Centres of one batch go to every task and, when searching, to the driver: 1,024 of 4,096 dimensions are 32 MB.
MAX_CLUSTERS = 1_024
ROUNDS = 10
# Added to radii, against rounding.
SLACK = 1e-9
_CLUSTERS = "part string, width int, cluster int, center array<double>, radius double, n long"


def fitted_centers(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors: each round moves a centre to the direction of its vectors' sum."""
    draw = np.random.default_rng(5)
    centers = sample[draw.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        moved = np.linalg.norm(sums, axis=1) > 0
        centers = np.where(moved[:, None], vec.unit_rows(sums), centers)
    return centers


class VectorClusters:
    """The layout under ``path``: a part per batch, each with clusters of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.clusters_read = 0

    def add(self, chunks: DataFrame, vector: str = "embedding", clusters: int | None = None) -> None:
        """Places ``chunks`` (id, vector) as a part; rows without a vector are left out, widths are kept apart.

        Vectors of the commonest width are clustered, about a square root of their number together, or as many as
        ``clusters`` asks for; those of another width are one cluster that any question of that width reads.
        """
        part = uuid.uuid4().hex
        rows = chunks.select("id", F.col(vector).alias("embedding")).where(F.col("embedding").isNotNull())
        widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width")
        commonest = widths.first()
        if commonest is None:
            return
        width, n = commonest["width"], commonest["n"]
        count = max(1, min(MAX_CLUSTERS, clusters or math.isqrt(n)))
        same = rows.where(F.size("embedding") == width)
        sample = same.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("embedding").toPandas()
        values = np.array(sample.embedding.tolist(), dtype=np.float64).reshape(len(sample), width)
        values = vec.unit_rows(np.nan_to_num(values, posinf=0.0, neginf=0.0))
        centers = self.spark.sparkContext.broadcast(fitted_centers(values, count))

        @F.arrow_udf(T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]))
        def place(vectors: pa.Array) -> pa.Array:
            good, matrix = vec.dense_matrix(vectors, width)
            unit = vec.unit_rows(matrix)
            cluster, distance = np.full(len(vectors), -1, dtype=np.int32), np.full(len(vectors), np.inf)
            if len(good):
                nearest = (unit @ centers.value.T).argmax(axis=1)
                cluster[good] = nearest
                distance[good] = np.linalg.norm(unit - centers.value[nearest], axis=1)
            distance[np.isnan(distance)] = np.inf
            return pa.StructArray.from_arrays([pa.array(cluster), pa.array(distance)], names=["cluster", "distance"])

        placed = rows.withColumn("p", place("embedding")).select("id", "embedding", "p.cluster", "p.distance", F.size("embedding").alias("width"))
        folder = f"{self.path}/data/part={part}"
        # A cluster of many rows spreads over tasks by id.
        placed.repartitionByRange("width", "cluster", "id").sortWithinPartitions("width", "cluster").write.parquet(f"{folder}")
        stored = self.spark.read.schema(placed.schema).parquet(folder)
        measured = stored.groupBy("width", "cluster").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()  # a row per cluster
        table = [
            (part, r["width"], r["cluster"], centers.value[r["cluster"]].tolist() if r["cluster"] >= 0 else None, r["radius"], r["n"]) for r in measured
        ]
        self.spark.createDataFrame(table, _CLUSTERS).coalesce(1).write.mode("append").parquet(f"{self.path}/clusters")

    def clusters(self, width: int) -> list:
        try:
            stored = self.spark.read.schema(_CLUSTERS).parquet(f"{self.path}/clusters")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return stored.where(F.col("width") == width).collect()

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """Id, cosine, score, rank, as ``dense_top_k`` over all parts gives them."""
        found = self.clusters(len(query))
        data = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data") if found else None
        if data is None:
            return self.spark.createDataFrame([], "id string, cosine double, rank int, score double")
        unit = vec.unit_rows(np.asarray([query], dtype=np.float64))[0]
        upper = []
        for r in found:
            if r["center"] is None or not math.isfinite(r["radius"]):
                upper.append(1.0)
            else:
                nearest = max(0.0, float(np.linalg.norm(unit - np.array(r["center"]))) - r["radius"] - SLACK)
                upper.append(1.0 - nearest * nearest / 2)  # holds for a zero vector too, whose cosine is 0
        order = sorted(range(len(found)), key=lambda i: -upper[i])
        first, held = [], 0
        for i in order:
            first.append(i)
            held += found[i]["n"]
            if held >= k:
                break

        def read(chosen: list[int]) -> DataFrame:
            self.clusters_read += len(chosen)
            by_part: dict[str, list[int]] = {}
            for i in chosen:
                by_part.setdefault(found[i]["part"], []).append(found[i]["cluster"])
            wanted = F.lit(False)
            for part, numbers in by_part.items():
                wanted = wanted | ((F.col("part") == part) & F.col("cluster").isin(numbers))
            return data.where((F.col("width") == len(query)) & wanted)

        best = rt.dense_top_k(read(first), query, k).select("id", "cosine").collect()
        floor = min(r["cosine"] for r in best) if len(best) == k else -math.inf
        rest = [i for i in order if i not in set(first) and upper[i] >= floor - SLACK]
        # The first clusters are few; reading them again keeps the second pass one scan.
        return rt.dense_top_k(read(first + rest), query, k)
