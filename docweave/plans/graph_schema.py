"""The declared graph schema, for validation and for prompts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import product
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

DEFAULT_FILE = Path(__file__).parent.parent / "schema" / "graph_schema.yaml"


@dataclass(frozen=True)
class GraphSchema:
    content: dict

    @classmethod
    def load(cls, path: str | Path | None = None) -> "GraphSchema":
        with open(path or DEFAULT_FILE, encoding="utf-8") as handle:
            return cls(yaml.safe_load(handle))

    @property
    def labels(self) -> dict[str, dict]:
        return self.content["knowledge_layer"]["node_labels"]

    @property
    def relationships(self) -> dict[str, dict]:
        return self.content["knowledge_layer"]["relationships"]

    @property
    def classes(self) -> dict[str, dict]:
        return self.content["extraction"]["per_class"]

    @cached_property
    def properties(self) -> list[str]:
        """All declared property names, in order of first mention."""
        return list(dict.fromkeys(p for spec in self.labels.values() for p in spec["properties"]))

    @property
    def merge_keys(self) -> dict[str, str]:
        return {label: spec["key"] for label, spec in self.labels.items()}

    def declared_triples(self) -> list[tuple[str, str, str]]:
        """Every (source label, type, target label) the endpoint lists span."""
        return [
            (s, rel, t) for rel, spec in self.relationships.items() for s, t in product(spec["source"], spec["target"])
        ]

    def extractable_triples(self) -> list[tuple[str, str, str, str]]:
        """(class, source label, type, target label) that a class may actually produce."""
        return [
            (name, s, rel, t)
            for name, spec in self.classes.items()
            for s, rel, t in self.declared_triples()
            if rel in spec["allowed_relationships"] and {s, t} <= set(spec["allowed_labels"])
        ]

    def triples_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.extractable_triples(), "doc_type string, source_label string, rel_type string, target_label string"
        )

    def describe(self) -> dict:
        """The knowledge layer as data for a prompt: labels, and for every type the label pairs it links."""
        pairs: dict[str, list[str]] = {}
        for source, rel, target in self.declared_triples():
            pairs.setdefault(rel, []).append(f"{source} to {target}")
        return {
            "labels": {n: {"is": s["description"], "key": s["key"], "has": s["properties"]} for n, s in self.labels.items()},
            "links": {rel: {"is": self.relationships[rel]["description"], "between": pairs[rel]} for rel in pairs},
            "on_every_link": self.content["knowledge_layer"].get("edge_provenance", {}),
        }
