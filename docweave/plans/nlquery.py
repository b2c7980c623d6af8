"""A question as a guarded, read-only query over the graph views."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.plans import guard
from docweave.plans.graph_schema import GraphSchema

EDGE_COLUMNS = "rel_type, source_label, source_key, target_label, target_key, source_chunk, source_document"
NO_STATEMENT = "there was no statement in the reply"


@dataclass(frozen=True)
class Answer:
    """A query that ran: its rows as a table, the references in its first page, and that page as text."""

    statement: str
    rows: DataFrame
    chunk_refs: list[str]
    text: str


def build_prompt(question: str, schema: GraphSchema, views: Iterable[str], failures: list[dict] = ()) -> str:
    """One JSON object: the tables, the schema as data, what the statement must be, and earlier failures."""
    columns = {"nodes": ", ".join(["label", "key", *schema.properties]), "edges": EDGE_COLUMNS}
    body = {
        "question": question,
        "reply": "one Spark SQL SELECT, bare",
        "tables": {view: columns.get(view, "") for view in views},
        "schema": schema.describe(),
        "limits": {
            "links": "a link exists only between label pairs listed for its type; longer ways are chains of listed links",
            "output": "every column under a name of its own, with edges.source_chunk where edges are used",
        },
    }
    if failures:
        body["failures"] = list(failures)
    return json.dumps(body, ensure_ascii=False, indent=1)


def run_statement(spark: SparkSession, statement: str, views: Iterable[str]) -> DataFrame:
    """The checked statement's rows, repeated column names numbered."""
    df = guard.checked(spark, statement, views)
    return df.toDF(*guard.unique_columns(df.columns))


def page(rows: DataFrame, size: int, number: int = 0) -> DataFrame:
    """One page of a result, in the result's order; all pages together are the result."""
    return rows.offset(size * number).limit(size)


def chunk_references(rows: DataFrame) -> list[str]:
    """The values of ``source_chunk`` in a page of rows, plain or inside a struct, in order, once each."""
    named = [
        F.col(f"`{f.name}`.source_chunk") if hasattr(f.dataType, "names") else F.col(f"`{f.name}`")
        for f in rows.schema.fields
        if "source_chunk" in getattr(f.dataType, "names", ()) or f.name == "source_chunk"
    ]
    if not named:
        return []
    values = rows.select(F.filter(F.array(*[c.cast("string") for c in named]), lambda v: v.isNotNull() & (v != "")).alias("refs")).collect()
    return list(dict.fromkeys(ref for row in values for ref in row["refs"]))


def row_text(*columns: str, limit: int | None = None) -> Column:
    """F16 over a table: the row as JSON, with a limit cut to so many characters."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return line if limit is None else F.substring(line, 1, limit)


def page_text(rows: DataFrame, config: EngineConfig) -> str:
    """The first page as one JSON line per row, and whether more follow."""
    size = config.query_page_rows
    lines = [r["line"] for r in rows.limit(size + 1).select(row_text(*[f"`{c}`" for c in rows.columns], limit=config.query_row_chars).alias("line")).collect()]
    more = [f"(more rows follow these {size})"] if len(lines) > size else []
    return "\n".join(lines[:size] + more) or "(no rows)"


def answer(
    spark: SparkSession, question: str, schema: GraphSchema, views: Iterable[str], ask: Callable[[str], str], config: EngineConfig = EngineConfig()
) -> Answer | None:
    """The first statement that passes the guard and runs; every failure goes into the next prompt. None without one."""
    views, failures = list(views), []
    while len(failures) < config.query_attempts:
        reply = ask(build_prompt(question, schema, views, failures))
        statement = guard.bare(reply)
        try:
            if not statement:
                raise ValueError(NO_STATEMENT)
            rows = run_statement(spark, statement, views)
            first = page(rows, config.query_page_rows)
            return Answer(statement, rows, chunk_references(first), page_text(rows, config))
        except Exception as exc:  # noqa: BLE001 - what analysis, guard or execution say is fed back
            failures.append({"statement": statement, "error": str(exc)})
    return None
