"""The markdown of one section, addressed by its heading path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunking as ck


def extract_section(text: Column, path: Column) -> Column:
    """From the first heading whose chain ends in ``path`` to the next heading of its level or above.

    NULL when no heading matches. Only backtick fences hide headings here, and
    they may be indented.
    """
    parts = F.filter(F.transform(F.split(path, ">"), tx.strip), lambda p: p != "")
    start = F.struct(
        F.array().cast(ck.EMPTY_CHAIN).alias("chain"),
        F.lit(0).alias("level"),
        F.lit(False).alias("closed"),
        F.array().cast("array<string>").alias("out"),
    )

    def lookup(wanted: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            level = ck.heading_level(s)
            chain = ck.push_heading(acc["chain"], level, ck.heading_title(s))
            titles = F.transform(chain, lambda h: h["title"])
            n = F.size(wanted)
            hit = (F.size(titles) >= n) & (
                F.slice(titles, F.greatest(F.size(titles) - n + 1, F.lit(1)), n) == wanted
            )
            opens = (acc["level"] == 0) & hit
            closes = (acc["level"] > 0) & (level <= acc["level"])
            inside = opens | ((acc["level"] > 0) & ~acc["closed"] & ~closes)
            return F.struct(
                F.when(acc["level"] == 0, chain).otherwise(acc["chain"]).alias("chain"),
                F.when(opens, level).otherwise(acc["level"]).alias("level"),
                (acc["closed"] | closes).alias("closed"),
                F.when(inside, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
            )

        sections = F.slice(ck.split_sections(text, ck.INDENTED_BACKTICK_FENCE), 2, 2147483646)
        found = F.aggregate(sections, start, step, lambda acc: acc["out"])
        return tx.let(
            found, lambda out: F.when(F.size(out) > 0, F.rtrim(F.array_join(out, ""), F.lit(tx.WHITESPACE)))
        )

    return tx.let(parts, lambda p: F.when(F.size(p) > 0, lookup(p)))


def lookup_sections(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """S11 over a table of requests (source_path, section): content, or NULL where nothing matches.

    An empty section asks for the whole file. Requests for one document are
    answered from the one row that holds its text.
    """
    joined = requests.join(documents.select("source_path", "text"), "source_path", "left")
    section = F.coalesce(F.col("section"), F.lit(""))
    content = F.when(section == "", F.col("text")).otherwise(extract_section(F.col("text"), section))
    return joined.select(*requests.columns, content.alias("content"))
