"""Graph patterns as DataFrame joins over the entity and edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.graph import PROVENANCE


@dataclass(frozen=True)
class Graph:
    """entities: label, key, properties. edges: rel_type, both endpoints, provenance."""

    entities: DataFrame
    edges: DataFrame

    def view_of(self, label: str) -> DataFrame:
        return self.entities.where(F.col("label") == label)

    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views for the query channel: nodes, edges."""
        names = [f"{prefix}nodes", f"{prefix}edges"]
        self.entities.createOrReplaceTempView(names[0])
        self.edges.createOrReplaceTempView(names[1])
        return names


def _directed(edges: DataFrame, types: tuple[str, ...], direction: str) -> DataFrame:
    """Edges as (from, to) rows, read along, against or regardless of their direction."""
    if types:
        edges = edges.where(F.col("rel_type").isin(*types))

    def read(start: str, end: str) -> DataFrame:
        return edges.select(
            "rel_type",
            F.col(f"{start}_label").alias("from_label"),
            F.col(f"{start}_key").alias("from_key"),
            F.col(f"{end}_label").alias("to_label"),
            F.col(f"{end}_key").alias("to_key"),
            *PROVENANCE,
        )

    along, against = read("source", "target"), read("target", "source")
    if direction == "any":
        # A self-loop reads the same both ways and is one match.
        loops = (F.col("from_label") == F.col("to_label")) & (F.col("from_key") == F.col("to_key"))
        return along.unionByName(against.where(~loops))
    return {"out": along, "in": against}[direction]


class Match:
    """A path pattern: ``Match(g).node("a", "System").edge("r", "DEPENDS_ON").node("b")``.

    Columns are ``<alias>_label``/``<alias>_key`` for nodes, ``<alias>_type`` and
    ``<alias>_<provenance>`` for edges. Node properties are joined in only where
    ``properties`` names some: an edge already carries its endpoints' identity.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self.rows: DataFrame | None = None
        self._last = ""
        self._pending: tuple[str, tuple[str, ...], str] | None = None

    def node(
        self, alias: str, label: str | None = None, properties: tuple[str, ...] = (), where: Column | None = None
    ) -> "Match":
        key = (f"{alias}_label", f"{alias}_key")
        table = self.graph.entities if label is None else self.graph.view_of(label)
        if where is not None:
            table = table.where(where)
        table = table.select(
            F.col("label").alias(key[0]),
            F.col("key").alias(key[1]),
            *[F.col(p).alias(f"{alias}_{p}") for p in properties],
        )
        if self.rows is None:
            self.rows = table
        else:
            edge, types, direction = self._pending
            hops = _directed(self.graph.edges, types, direction)
            if label is not None:
                hops = hops.where(F.col("to_label") == label)
            hops = hops.select(
                F.col("from_label").alias(f"{self._last}_label"),
                F.col("from_key").alias(f"{self._last}_key"),
                F.col("to_label").alias(key[0]),
                F.col("to_key").alias(key[1]),
                F.col("rel_type").alias(f"{edge}_type"),
                *[F.col(p).alias(f"{edge}_{p}") for p in PROVENANCE],
            )
            self.rows = self.rows.join(hops, [f"{self._last}_label", f"{self._last}_key"])
            if properties or where is not None:
                self.rows = self.rows.join(table, list(key))
        self._last = alias
        return self

    def edge(self, alias: str, *types: str, direction: str = "out") -> "Match":
        self._pending = (alias, types, direction)
        return self

    def where(self, condition: Column) -> "Match":
        self.rows = self.rows.where(condition)
        return self

    def select(self, *columns, limit: int | None = None) -> DataFrame:
        """The row limit is part of the plan, not applied after collecting."""
        out = self.rows.select(*columns)
        return out if limit is None else out.limit(limit)


def path_counts(graph: Graph, start_label: str, *hops: tuple[str, str, str]) -> DataFrame:
    """How many paths lead to each end node.

    Hops are (type, direction, label). Counts are summed per node after every
    hop, so a hub with many edges in and out costs their sum, never their
    product, and its rows are combined before each shuffle.
    """
    here = graph.view_of(start_label).select("key", F.lit(1).cast("long").alias("paths"))
    label = start_label
    for rel_type, direction, next_label in hops:
        step = _directed(graph.edges, (rel_type,), direction).where(
            (F.col("from_label") == label) & (F.col("to_label") == next_label)
        )
        # One row per node on the left, so the join yields each edge at most once.
        here = (
            here.join(step.select("from_key", "to_key"), F.col("key") == F.col("from_key"))
            .groupBy(F.col("to_key").alias("key"))
            .agg(F.sum("paths").alias("paths"))
        )
        label = next_label
    return here
