"""Class-specific chunkers as narrow, in-row expressions.

A document is one row and every chunker works inside it with array functions,
so chunking a corpus needs no shuffle: a hot source or a huge document costs
its own task only, and ``posexplode`` yields the chunk index for free. Regular
expressions do the line scanning in one linear pass per document. Only Python
sources leave the JVM, for the interpreter's own grammar.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import EngineConfig
from docweave.functions import text as tx

# Heading, clause and fence line shapes (Java regex, Unicode classes on).
HEADING = r"#{1,6}" + tx.BLANK
CLAUSE = r"(?i)(?U)^#{3,4}[\s\x1f]+Clause[\s\x1f]+(\d+)[\s\x1f]*\z"
FENCE = r"(?:```|~~~)"
INDENTED_BACKTICK_FENCE = tx.BLANK + r"*```"

PARAGRAPH_BREAK = r"(?U)\n[\s\x1c-\x1f]*\n"
# Line-break characters are unified to "\n" first, so this one is free to mark sections.
MARK = "\x1e"

PIECE = "array<struct<section:string,clause:string,code_ref:string,text:string>>"


def hard_split(c: Column, size: int, overlap: int) -> Column:
    """Array of stripped ``size``-character windows, ``overlap`` shared with the next.

    The lookahead captures a window while the match itself consumes one stride,
    so all windows come out of a single pass over the text.
    """
    step = max(1, size - overlap)
    windows = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    extra = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(step)).cast("int"))
    kept = F.slice(windows, F.lit(1), extra + 1)
    return F.filter(F.transform(kept, tx.strip), lambda w: w != "")


def group_paragraphs(paragraphs: Column, size: int, overlap: int) -> Column:
    """Greedy grouping of paragraphs into chunks of about ``size`` characters.

    A chunk that overflows hands its last ``overlap`` characters on to the next
    one; a paragraph beyond ``size`` is split into windows and hands on nothing.
    """
    clean = F.filter(F.transform(paragraphs, tx.strip), lambda p: p != "")
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open")
    )

    def close(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.concat(acc["done"], F.array(tx.strip(acc["open"])))).otherwise(
            acc["done"]
        )

    def add(acc: Column, p: Column) -> Column:
        oversize = F.length(p) > size
        overflow = (acc["open"] != "") & (F.length(acc["open"]) + 2 + F.length(p) > size)
        carried = tx.strip(F.right(tx.strip(acc["open"]), F.lit(overlap)))
        reopened = F.concat(carried, F.lit("\n\n"), p) if overlap > 0 else p
        return F.struct(
            F.when(oversize, F.concat(close(acc), hard_split(p, size, overlap)))
            .when(overflow, close(acc))
            .otherwise(acc["done"])
            .alias("done"),
            F.when(oversize, F.lit(""))
            .when(overflow, reopened)
            .when(acc["open"] == "", p)
            .otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
            .alias("open"),
        )

    return F.filter(F.aggregate(clean, start, add, close), lambda c: c != "")


def split_sections(text: Column, fence: str = FENCE) -> Column:
    """Array of the text before the first heading, then one element per heading with its body.

    Fenced blocks match as a whole, so a heading-like line inside one starts no section.
    """
    # A mark lands before every heading and behind every fenced block; only the
    # former has a heading right after it. Starting the pattern with a plain
    # line break keeps the scan to one cheap test per character.
    fenced = rf"({fence}(?s:.*?)(?:\n{fence}[^\n]*|\z))"
    marked = F.regexp_replace(
        F.concat(F.lit("\n"), tx.unify_newlines(text)),
        f"(?U)\\n(?:{fenced}|(?={HEADING}))",
        "\n$1" + MARK,
    )
    return F.transform(F.split(marked, MARK + "(?=#)"), lambda s: F.replace(s, F.lit(MARK), F.lit("")))


def heading_line(section: Column) -> Column:
    return F.substring_index(section, "\n", 1)


def section_body(section: Column) -> Column:
    """Lines below the heading."""
    cut = F.locate("\n", section)
    return F.when(cut > 0, F.substr(section, cut + 1)).otherwise(F.lit(""))


def heading_level(section: Column) -> Column:
    return F.length(F.regexp_extract(section, "^(#{1,6})", 1))


def heading_title(section: Column) -> Column:
    return tx.strip(F.regexp_replace(heading_line(section), "^#{1,6}", ""))


def push_heading(chain: Column, level: Column, title: Column) -> Column:
    """The heading chain after a heading: deeper and equal levels leave it."""
    return F.concat(
        F.filter(chain, lambda h: h["level"] < level),
        F.array(F.struct(level.alias("level"), title.alias("title"))),
    )


EMPTY_CHAIN = "array<struct<level:int,title:string>>"


def _piece(section: Column, clause: Column, code_ref: Column, text: Column) -> Column:
    return F.struct(
        section.alias("section"), clause.alias("clause"), code_ref.alias("code_ref"), text.alias("text")
    )


def _or_whole(found: Column, windows: Column, ref: Column) -> Column:
    """The pieces found, or the windows of the whole text when there are none."""
    return tx.let(
        found,
        lambda f: F.when(
            F.size(f) == 0, F.transform(windows, lambda w: _piece(ref, F.lit(""), ref, w)).cast(PIECE)
        ).otherwise(f.cast(PIECE)),
    )


def _headed(sections: Column) -> Column:
    return F.slice(sections, F.lit(2), F.greatest(F.size(sections), F.lit(1)))


def heading_chunks(text: Column, size: int, overlap: int) -> Column:
    """C4: pieces of a markdown text under their heading path (levels two and below)."""
    start = F.struct(
        F.array().cast(EMPTY_CHAIN).alias("chain"), F.array().cast("array<string>").alias("paths")
    )

    def step(acc: Column, s: Column) -> Column:
        chain = push_heading(acc["chain"], heading_level(s), heading_title(s))
        deep = F.transform(F.filter(chain, lambda h: h["level"] >= 2), lambda h: h["title"])
        return F.struct(
            chain.alias("chain"),
            F.concat(acc["paths"], F.array(F.array_join(deep, " > "))).alias("paths"),
        )

    def pieces(z: Column) -> Column:
        def texts(grouped: Column) -> Column:
            bare = (F.size(grouped) == 0) & (z["path"] != "")
            return F.transform(
                F.when(bare, F.array(z["path"])).otherwise(grouped),
                lambda t: _piece(z["path"], F.lit(""), F.lit(""), t),
            )

        return tx.let(group_paragraphs(F.split(tx.strip(z["body"]), PARAGRAPH_BREAK), size, overlap), texts)

    def found(sections: Column) -> Column:
        paths = F.aggregate(_headed(sections), start, step, lambda acc: acc["paths"])
        bodies = F.transform(sections, lambda s, i: F.when(i == 0, s).otherwise(section_body(s)))
        zipped = F.arrays_zip(F.concat(F.array(F.lit("")), paths).alias("path"), bodies.alias("body"))
        return F.flatten(F.transform(zipped, pieces))

    windows = hard_split(tx.strip(text), size, overlap)
    return _or_whole(tx.let(split_sections(text), found), windows, F.lit(""))


def clause_chunks(text: Column, size: int, overlap: int) -> Column:
    """Preamble pieces first, then each numbered clause under its part heading."""
    start = F.struct(
        F.lit("").alias("part"),
        F.array().cast("array<struct<number:string,heading:string,body:string,part:string>>").alias("clauses"),
    )

    def number_of(s: Column) -> Column:
        return F.regexp_extract(heading_line(s), CLAUSE, 1)

    def step(acc: Column, s: Column) -> Column:
        number = number_of(s)
        body = tx.strip(F.replace(section_body(s), F.lit("\n"), F.lit("\n\n")))
        clause = F.struct(
            number.alias("number"),
            tx.strip(heading_line(s)).alias("heading"),
            body.alias("body"),
            acc["part"].alias("part"),
        )
        return F.struct(
            F.when((number == "") & (heading_level(s) <= 2), heading_title(s)).otherwise(acc["part"]).alias("part"),
            F.when(number != "", F.concat(acc["clauses"], F.array(clause))).otherwise(acc["clauses"]).alias("clauses"),
        )

    def pieces(c: Column) -> Column:
        section = F.btrim(F.concat(c["part"], F.lit(" > Clause "), c["number"]), F.lit(" >"))
        texts = F.when(c["body"] == "", F.array(c["heading"])).when(
            F.length(c["body"]) <= size, F.array(c["body"])
        ).otherwise(hard_split(c["body"], size, overlap))
        return F.transform(
            texts,
            lambda t: _piece(
                section,
                c["number"],
                F.lit(""),
                F.when(t == c["heading"], t).otherwise(F.concat(c["heading"], F.lit("\n\n"), t)),
            ),
        )

    def found(sections: Column) -> Column:
        clauses = F.aggregate(_headed(sections), start, step, lambda acc: acc["clauses"])
        outside = F.filter(sections, lambda s, i: (i == 0) | (number_of(s) == ""))
        preamble = group_paragraphs(F.split(F.array_join(outside, "\n"), "\n"), size, overlap)
        return F.concat(
            F.transform(preamble, lambda t: _piece(F.lit(""), F.lit(""), F.lit(""), t)).cast(PIECE),
            F.flatten(F.transform(clauses, pieces)).cast(PIECE),
        )

    return tx.let(split_sections(text), found)


# --------------------------------------------------------------------- code

SEGMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("symbol", T.StringType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
            T.StructField("body", T.StringType()),
        ]
    )
)
MODULE = "module"
# Sources that a task takes up at a time.
SOURCES_AT_ONCE = 128


def _top_level(source: str, lines: list[str]) -> list[tuple[str, int, int, str]]:
    """(symbol or "", first line, last line, text) of the top-level statements, comments and semicolons.

    Symbols take whole lines; what is not a symbol ends where it ends, so a
    comment behind a statement is a piece of its own.
    """

    def at(line: int, byte: int) -> tuple[int, int]:
        return line, len(lines[line - 1].encode("utf-8")[:byte].decode("utf-8", "ignore"))

    pieces = []
    for node in ast.parse(source).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            pieces.append((node.name, (first, 0), (node.end_lineno, len(lines[node.end_lineno - 1]))))
        else:
            pieces.append(("", at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)))
    starts = [start for _, start, _ in pieces]
    for tok in tokenize.generate_tokens(io.StringIO(source).readline):
        if tok.type == tokenize.COMMENT or (tok.type == tokenize.OP and tok.string == ";"):
            before = bisect.bisect_right(starts, tok.start) - 1
            if before < 0 or pieces[before][2] <= tok.start:
                pieces.append(("", tok.start, tok.end))
    out = []
    for symbol, (first, left), (last, right) in sorted(pieces, key=lambda p: p[1]):
        body = lines[first - 1 : last]
        body[-1] = body[-1][:right]
        body[0] = body[0][left:]
        out.append((symbol, first, last, "\n".join(body)))
    return out


def _column_zero(lines: list[str]) -> list[tuple[str, int, int]]:
    """The same for source that does not parse: an unindented line opens a statement."""
    spans: list[tuple[str, int, int]] = []
    decorated = False
    for number, line in enumerate(lines, start=1):
        if not line.strip():
            continue
        if line[0].isspace() or line[0] in ")]}":
            if spans:
                spans[-1] = (spans[-1][0], spans[-1][1], number)
            continue
        head = line.removeprefix("async ").split("(")[0].split(":")[0].split()
        symbol = head[1] if len(head) > 1 and head[0] in ("def", "class") else ""
        if decorated:
            spans[-1] = (symbol, spans[-1][1], number)
        else:
            spans.append((symbol, number, number))
        decorated = line.startswith("@")
    return spans


def _segments(source: str | None) -> list[tuple[str, int, int, str]]:
    """Top-level symbols in order, the statements between them joined into module segments."""
    if not source or not source.strip():
        return []
    # The parser's own line ends.
    source = re.sub("\r\n?", "\n", source)
    lines = source.split("\n")
    try:
        pieces = _top_level(source, lines)
    except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError, tokenize.TokenError):
        pieces = [(*span, "\n".join(lines[span[1] - 1 : span[2]])) for span in _column_zero(lines)]
    out: list[tuple[str, int, int, str]] = []
    for symbol, first, last, body in pieces:
        if symbol:
            out.append((symbol, first, last, body))
        elif out and not out[-1][0]:
            out[-1] = ("", out[-1][1], last, out[-1][3] + "\n" + body.strip())
        else:
            out.append(("", first, last, body.strip()))
    return out


@F.arrow_udf(SEGMENTS)
def python_segments(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("symbol", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("body", pa.string())]))
    for batch in batches:
        # A task holds the sources and segments of a few rows in Python, however many arrive at once.
        for start in range(0, len(batch), SOURCES_AT_ONCE):
            few = batch.slice(start, SOURCES_AT_ONCE).to_pylist()
            yield pa.array([[dict(zip(("symbol", "first", "last", "body"), s)) for s in _segments(source)] for source in few], kind)


def code_chunks(segments: Column, text: Column, path: Column, size: int, overlap: int) -> Column:
    """One chunk per top-level function or class; what lies between forms module chunks."""
    module_ref = F.concat(path, F.lit("#" + MODULE))

    def pieces(s: Column) -> Column:
        is_module = s["symbol"] == ""
        module_text = tx.strip(s["body"])
        section = F.when(is_module, module_ref).otherwise(F.concat(path, F.lit("#"), s["symbol"]))
        code_ref = F.when(is_module, module_ref).otherwise(
            F.concat(section, F.lit(":"), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))
        )
        texts = F.when(is_module, group_paragraphs(F.split(module_text, PARAGRAPH_BREAK), size, overlap)).when(
            F.length(s["body"]) > size, group_paragraphs(F.array(s["body"]), size, overlap)
        ).otherwise(F.array(s["body"]))
        return F.transform(texts, lambda t: _piece(section, F.lit(""), code_ref, t))

    windows = hard_split(tx.strip(text), size, overlap)
    return _or_whole(F.flatten(F.transform(segments, pieces)), windows, module_ref)


# ----------------------------------------------------------------- dispatch


def chunk_id(doc_id: Column, index: Column) -> Column:
    """sha256 of "<doc_id>:<index>"."""
    return F.sha2(F.concat(doc_id.cast("string"), F.lit(":"), index.cast("string")), 256)


def explode_chunks(docs: DataFrame, pieces: Column, *keep: str) -> DataFrame:
    """One row per piece with its index in the document and its chunk id."""
    rows = docs.select(*keep, F.posexplode(pieces).alias("chunk_index", "piece"))
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), *keep, "chunk_index", "piece.*"
    )


def chunk_documents(docs: DataFrame, config: EngineConfig = EngineConfig(), *keep: str) -> DataFrame:
    """Chunk every document with the chunker of its class.

    ``docs`` needs doc_id, doc_type, source_path and text. Python sources take
    their own branch, so other documents never pass through a Python worker.
    """
    size, overlap = config.chunk_size, config.chunk_overlap
    keep = ("doc_id", "doc_type", *keep)
    is_python = (F.col("doc_type") == "code") & F.col("source_path").rlike(r"[^/]\.py\z")
    prose = explode_chunks(
        docs.where(~F.coalesce(is_python, F.lit(False))),
        F.when(
            F.col("doc_type").isin("regulatory", "security"), clause_chunks(F.col("text"), size, overlap)
        ).otherwise(heading_chunks(F.col("text"), size, overlap)),
        *keep,
    )
    parsed = docs.where(is_python).withColumn("segments", python_segments("text"))
    code = explode_chunks(
        parsed,
        code_chunks(F.col("segments"), F.col("text"), F.col("source_path"), size, overlap),
        *keep,
    )
    return prose.unionByName(code)
