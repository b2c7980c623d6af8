"""The registered queries: a Spark callable per name, and where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.functions.text import WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# SQL fragments shared by the checks.
WS = f"'{WHITESPACE}'"


def hard_split_sql(text: str, size: int = 900, overlap: int = 150) -> str:
    step = size - overlap
    return (
        f"list_filter(list_transform(range(CASE WHEN length({text}) <= {size} THEN 1 "
        f"ELSE CAST(ceil((length({text}) - {size}) / {step}.0) AS BIGINT) + 1 END), "
        f"lambda k: trim(substring({text}, CAST(k * {step} + 1 AS BIGINT), {size}), {WS})), lambda w: w <> '')"
    )


def group_paragraphs_sql(paragraphs: str, size: int = 900, overlap: int = 150) -> str:
    """Chunks of a list of paragraphs, as one fold over {done, open} pairs."""
    close = f"CASE WHEN a.open <> '' THEN list_append(a.done, trim(a.open, {WS})) ELSE a.done END"
    start = "{'done': CAST([] AS VARCHAR[]), 'open': ''}"
    fold = f"""list_reduce(list_prepend({start}, list_transform(
        list_filter(list_transform({paragraphs}, lambda p: trim(p, {WS})), lambda p: p <> ''),
        lambda p: {{'done': CAST([] AS VARCHAR[]), 'open': p}})),
      lambda a, x: {{
        'done': CASE WHEN length(x.open) > {size} THEN list_concat({close}, {hard_split_sql('x.open', size, overlap)})
                     WHEN a.open <> '' AND length(a.open) + 2 + length(x.open) > {size} THEN {close}
                     ELSE a.done END,
        'open': CASE WHEN length(x.open) > {size} THEN ''
                     WHEN a.open <> '' AND length(a.open) + 2 + length(x.open) > {size}
                     THEN trim(right(trim(a.open, {WS}), {overlap}), {WS}) || chr(10) || chr(10) || x.open
                     WHEN a.open = '' THEN x.open
                     ELSE a.open || chr(10) || chr(10) || x.open END}})"""
    return f"list_transform([{fold}], lambda a: {close})[1]"
