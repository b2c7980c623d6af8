"""Token and step streams as server-sent event lines, on the driver and as tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(event: dict) -> str:
    return f"data: {json.dumps(event, ensure_ascii=False, default=str)}\n\n"


def decode(lines: Iterable[str]) -> Iterator[dict]:
    """Events of a stream up to its done or error event; other lines and bad JSON are passed over."""
    for line in lines:
        if not line.startswith("data: "):
            continue
        try:
            event = json.loads(line[len("data: ") :])
        except json.JSONDecodeError:
            continue
        yield event
        if event.get("type") in ("done", "error"):
            return


def event_line(*fields: Column) -> Column:
    """K13 over a table: one event per row."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\n\n"))


def event_payload(line: Column) -> Column:
    """S12 over a table: the event of a line as VARIANT, NULL for other lines and bad JSON."""
    return F.when(line.startswith("data: "), F.try_parse_json(F.substr(line, F.lit(7))))


def answers(tokens: DataFrame, stream: Sequence[str], position: str, text: str = "text") -> DataFrame:
    """A10: each stream's tokens joined in order, with token and character counts.

    A stream is one answer, however many tokens it has.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(text).alias("token"))))
    return tokens.groupBy(*stream).agg(
        F.array_join(F.transform(ordered, lambda t: t["token"]), "").alias("answer"),
        F.count("*").alias("tokens"),
        F.sum(F.length(text)).alias("chars"),
    )
