"""Registered queries of the chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.catalog.corpora import MARKDOWN_SQL, markdown_documents, table
from docweave.catalog.registry import WS, group_paragraphs_sql, hard_split_sql, query
from docweave.operators import chunking as ck
from docweave.operators.sections import lookup_sections

SIZE, OVERLAP = 900, 150


@query(
    f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS window_no, CAST(length(w) AS BIGINT) AS n_chars, sha256(w) AS digest
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT doc_id, {hard_split_sql('text')} AS ws FROM documents))"""
)
def hard_split_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    windows = docs.select("doc_id", F.posexplode(ck.hard_split(F.col("text"), SIZE, OVERLAP)).alias("n", "w"))
    return windows.select(
        "doc_id",
        F.col("n").cast("long").alias("window_no"),
        F.length("w").cast("long").alias("n_chars"),
        F.sha2("w", 256).alias("digest"),
    )


@query(
    f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS digest
        FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i
              FROM (SELECT doc_id, {group_paragraphs_sql("string_split(text, chr(10))")} AS cs FROM documents))"""
)
def paragraph_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = ck.group_paragraphs(F.split("text", "\n"), SIZE, OVERLAP)
    return docs.select("doc_id", F.posexplode(chunks).alias("n", "c")).select(
        "doc_id",
        F.col("n").cast("long").alias("chunk_index"),
        F.length("c").cast("long").alias("n_chars"),
        F.sha2("c", 256).alias("digest"),
    )


# Lines of the markdown corpus with fence state and headings. ``fence`` tells
# which lines toggle a fence.
def _lines_sql(fence: str, source: str = "markdown") -> str:
    return f"""
raw_lines AS (SELECT doc_id, doc_type, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {source}),
fenced AS (SELECT *, ({fence}) AS is_fence,
             coalesce(sum(CAST({fence} AS INT)) OVER (PARTITION BY doc_id ORDER BY n
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM raw_lines),
lines AS (SELECT *, NOT is_fence AND NOT inside AND regexp_matches(line, '^#{{1,6}}\\s') AS is_heading,
            length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level,
            trim(regexp_replace(line, '^#{{1,6}}', ''), {WS}) AS title FROM fenced),
numbered AS (SELECT *, sum(CAST(is_heading AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM lines),
heads AS (SELECT doc_id, sec, n, level, title, line FROM numbered WHERE is_heading)"""


def _paths_sql(min_level: int) -> str:
    """Heading path per section: headings that no later one of their level or above has closed."""
    return f"""
paths AS (SELECT h.doc_id, h.sec, string_agg(g.title, ' > ' ORDER BY g.sec) AS path
          FROM heads h JOIN heads g ON g.doc_id = h.doc_id AND g.sec <= h.sec AND g.level >= {min_level}
          WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.doc_id = h.doc_id AND k.sec > g.sec
                            AND k.sec <= h.sec AND k.level <= g.level)
          GROUP BY h.doc_id, h.sec)"""


ANY_FENCE = "line LIKE '```%' OR line LIKE '~~~%'"
PARAGRAPHS = "string_split_regex(trim(body, " + WS + "), '\\n\\s*\\n')"
CHUNK_COLUMNS = """CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS BIGINT) AS chunk_index"""

HEADING_CHUNKS_SQL = f"""
{_lines_sql(ANY_FENCE)},{_paths_sql(2)},
bodies AS (SELECT doc_id, sec, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT is_heading), '') AS body
           FROM numbered GROUP BY doc_id, sec),
grouped AS (SELECT b.doc_id, b.sec, coalesce(hp.path, '') AS section, {group_paragraphs_sql(PARAGRAPHS)} AS cs
            FROM bodies b LEFT JOIN paths hp ON hp.doc_id = b.doc_id AND hp.sec = b.sec),
pieces AS (SELECT doc_id, sec, section,
             unnest(CASE WHEN len(cs) = 0 AND section <> '' THEN [section] ELSE cs END) AS text,
             generate_subscripts(CASE WHEN len(cs) = 0 AND section <> '' THEN [section] ELSE cs END, 1) AS i
           FROM grouped),
heading_pieces AS (
  SELECT doc_id, {CHUNK_COLUMNS}, section, '' AS clause, text FROM pieces
  UNION ALL
  SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT), '', '', unnest(ws)
  FROM (SELECT doc_id, {hard_split_sql(f"trim(text, {WS})")} AS ws FROM markdown WHERE doc_id NOT IN (SELECT doc_id FROM pieces)))"""


def _chunk_rows(docs, pieces):
    return ck.explode_chunks(docs, pieces, "doc_id").select(
        "id",
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "section",
        "clause",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("digest"),
    )


ROW_SQL = """sha256(doc_id || ':' || chunk_index) AS id, doc_id, chunk_index, section, clause,
             CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest"""


@query(f"WITH {MARKDOWN_SQL},{HEADING_CHUNKS_SQL} SELECT {ROW_SQL} FROM heading_pieces")
def heading_chunks(spark, sf_dir):
    docs = markdown_documents(spark, sf_dir)
    return _chunk_rows(docs, ck.heading_chunks(F.col("text"), SIZE, OVERLAP))


CLAUSE_CHUNKS_SQL = f"""
{_lines_sql(ANY_FENCE)},
marked AS (SELECT *, CASE WHEN is_heading THEN regexp_extract(line, '(?i)^#{{3,4}}\\s+Clause\\s+(\\d+)\\s*$', 1) ELSE '' END AS number
           FROM numbered),
parted AS (SELECT *, last_value(CASE WHEN is_heading AND number = '' AND level <= 2 THEN title END IGNORE NULLS)
             OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part,
             max(number) OVER (PARTITION BY doc_id, sec) AS clause FROM marked),
preamble AS (SELECT doc_id, list(line ORDER BY n) FILTER (clause = '') AS ls FROM parted GROUP BY doc_id),
first_pieces AS (SELECT doc_id, -1 AS sec, '' AS section, '' AS clause, '' AS heading,
                   {group_paragraphs_sql('coalesce(ls, [])')} AS cs FROM preamble),
clauses AS (SELECT doc_id, sec, max(clause) AS clause, max(CASE WHEN is_heading THEN trim(line, {WS}) END) AS heading,
              coalesce(max(CASE WHEN is_heading THEN part END), '') AS part,
              trim(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY n) FILTER (NOT is_heading), ''), {WS}) AS body
            FROM parted WHERE clause <> '' GROUP BY doc_id, sec),
clause_pieces AS (SELECT doc_id, sec, trim(part || ' > Clause ' || clause, ' >') AS section, clause, heading,
                    CASE WHEN body = '' THEN [heading] WHEN length(body) <= 900 THEN [body]
                         ELSE {hard_split_sql('body')} END AS cs FROM clauses),
every AS (SELECT * FROM first_pieces UNION ALL SELECT * FROM clause_pieces),
split AS (SELECT doc_id, sec, section, clause, heading, unnest(cs) AS piece, generate_subscripts(cs, 1) AS i FROM every),
clause_rows AS (SELECT doc_id, {CHUNK_COLUMNS}, section, clause,
                  CASE WHEN heading = '' OR piece = heading THEN piece
                       ELSE heading || chr(10) || chr(10) || piece END AS text FROM split)"""


@query(f"WITH {MARKDOWN_SQL},{CLAUSE_CHUNKS_SQL} SELECT {ROW_SQL} FROM clause_rows")
def clause_chunks(spark, sf_dir):
    docs = markdown_documents(spark, sf_dir)
    return _chunk_rows(docs, ck.clause_chunks(F.col("text"), SIZE, OVERLAP))


def _subset(sql: str, where: str, names: str, suffix: str) -> str:
    """The same chunk SQL under other names, over the documents of some classes."""
    out = sql.replace(" FROM markdown", f" FROM md_{suffix}")
    for name in names.split():
        out = out.replace(f"{name} AS (", f"{name}_{suffix} AS (")
        for lead in ("FROM ", "JOIN "):
            out = out.replace(f"{lead}{name} ", f"{lead}{name}_{suffix} ").replace(f"{lead}{name})", f"{lead}{name}_{suffix})")
            out = out.replace(f"{lead}{name}\n", f"{lead}{name}_{suffix}\n").replace(f"{lead}{name},", f"{lead}{name}_{suffix},")
    return f"md_{suffix} AS (SELECT * FROM markdown WHERE {where}),{out}"


_HEADING_NAMES = "raw_lines fenced lines numbered heads paths bodies grouped pieces heading_pieces"
_CLAUSE_NAMES = "raw_lines fenced lines numbered heads marked parted preamble first_pieces clauses clause_pieces every split clause_rows"
DISPATCH_SQL = f"""WITH {MARKDOWN_SQL},
{_subset(HEADING_CHUNKS_SQL, "doc_type IN ('architecture', 'code')", _HEADING_NAMES, 'h')},
{_subset(CLAUSE_CHUNKS_SQL, "doc_type IN ('regulatory', 'security')", _CLAUSE_NAMES, 'c')},
both_kinds AS (SELECT * FROM heading_pieces_h UNION ALL SELECT * FROM clause_rows_c)
SELECT doc_type, source_path, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(b.text)) AS BIGINT) AS chars,
       CAST(count(DISTINCT section) AS BIGINT) AS sections
FROM both_kinds b JOIN markdown m ON m.doc_id = b.doc_id GROUP BY doc_type, source_path"""


@query(DISPATCH_SQL)
def chunked_documents(spark, sf_dir):
    """C1 over the whole corpus, summed up per document."""
    from docweave.config import EngineConfig

    chunks = ck.chunk_documents(markdown_documents(spark, sf_dir), EngineConfig(), "source_path")
    return chunks.groupBy("doc_type", "source_path").agg(
        F.count("*").alias("chunks"),
        F.sum(F.length("text")).alias("chars"),
        F.count_distinct("section").alias("sections"),
    )


# Python sources, one definition per line of a document.
def _python_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda l: F.translate(l, '\\"', "  "))

    def definition(line, i):
        doc = F.concat(F.lit('    """'), line, F.lit('"""\n'))
        n = F.length(line).cast("string")
        return F.when(
            F.length(line) % 2 == 0,
            F.concat(F.lit("class Line"), i.cast("string"), F.lit(":\n"), doc, F.lit("    size = "), n),
        ).otherwise(F.concat(F.lit("def line_"), i.cast("string"), F.lit("(x):\n"), doc, F.lit("    return "), n))

    source = F.concat(
        F.lit('"""Module '), F.col("doc_id").cast("string"), F.lit('."""\nimport os\n\n'),
        F.array_join(F.transform(lines, definition), "\n\n"),
        F.lit("\n\nTOTAL = "), F.size(F.split("text", "\n")).cast("string"), F.lit("\n"),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit("code").alias("doc_type"),
        F.concat(F.lit("data/code/m"), "doc_id", F.lit(".py")).alias("source_path"),
        source.alias("text"),
    )


@query(
    f"""WITH ls AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'data/code/m' || doc_id || '.py' AS path,
                     len(string_split(text, chr(10))) AS total,
                     unnest(string_split(translate(text, '\\"', '  '), chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    defs AS (SELECT doc_id, path, i, CASE WHEN length(line) % 2 = 0 THEN 'Line' || i ELSE 'line_' || i END AS symbol,
               CASE WHEN length(line) % 2 = 0
                    THEN 'class Line' || i || ':' || chr(10) || '    \"\"\"' || line || '\"\"\"' || chr(10) || '    size = ' || length(line)
                    ELSE 'def line_' || i || '(x):' || chr(10) || '    \"\"\"' || line || '\"\"\"' || chr(10) || '    return ' || length(line)
               END AS body FROM ls),
    parts AS (SELECT doc_id, i AS sec, path || '#' || symbol AS section,
                path || '#' || symbol || ':' || (4 + 4 * i) || '-' || (6 + 4 * i) AS code_ref,
                CASE WHEN length(body) > 900 THEN {hard_split_sql('body')} ELSE [body] END AS cs FROM defs
              UNION ALL
              SELECT DISTINCT doc_id, -1, path || '#module', path || '#module',
                ['\"\"\"Module ' || doc_id || '.\"\"\"' || chr(10) || 'import os'] FROM ls
              UNION ALL
              SELECT DISTINCT doc_id, total, path || '#module', path || '#module', ['TOTAL = ' || total] FROM ls),
    split AS (SELECT doc_id, sec, section, code_ref, unnest(cs) AS text, generate_subscripts(cs, 1) AS i FROM parts)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS BIGINT) AS chunk_index,
           section, code_ref, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest FROM split"""
)
def code_chunks(spark, sf_dir):
    chunks = ck.chunk_documents(_python_documents(spark, sf_dir))
    return chunks.select(
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "section",
        "code_ref",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("digest"),
    )


# The viewer knows backtick fences only.
BACKTICK_FENCE = "line LIKE '```%'"


@query(
    f"""WITH {MARKDOWN_SQL},{_lines_sql(BACKTICK_FENCE)},{_paths_sql(1)},
    asked AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest([ls[1], ls[1] || ' > ' || coalesce(ls[2], '')]) AS section
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    target AS (SELECT a.doc_id, a.section, min(p.sec) AS sec
               FROM asked a JOIN paths p ON p.doc_id = a.doc_id
                AND (p.path = trim(a.section, ' >') OR ends_with(p.path, ' > ' || trim(a.section, ' >')))
               GROUP BY a.doc_id, a.section),
    start AS (SELECT t.*, h.level FROM target t JOIN heads h ON h.doc_id = t.doc_id AND h.sec = t.sec),
    stop AS (SELECT s.doc_id, s.section, min(h.sec) AS sec FROM start s JOIN heads h
               ON h.doc_id = s.doc_id AND h.sec > s.sec AND h.level <= s.level GROUP BY s.doc_id, s.section),
    content AS (SELECT s.doc_id, s.section, rtrim(string_agg(n.line, chr(10) ORDER BY n.n), {WS}) AS content
                FROM start s LEFT JOIN stop e ON e.doc_id = s.doc_id AND e.section = s.section
                JOIN numbered n ON n.doc_id = s.doc_id AND n.sec >= s.sec AND n.sec < coalesce(e.sec, 1000000000)
                GROUP BY s.doc_id, s.section)
    SELECT m.source_path, a.section, CAST(length(c.content) AS BIGINT) AS n_chars, sha256(c.content) AS digest
    FROM asked a JOIN markdown m ON m.doc_id = a.doc_id
    LEFT JOIN content c ON c.doc_id = a.doc_id AND c.section = a.section"""
)
def section_lookup(spark, sf_dir):
    """Two requests per document: the section its first line names, and its second line's below that."""
    documents = markdown_documents(spark, sf_dir)
    lines = F.split("text", "\n")
    asked = (
        table(spark, sf_dir, "documents")
        .select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.explode(
                F.array(
                    F.get(lines, F.lit(0)),
                    F.concat(F.get(lines, F.lit(0)), F.lit(" > "), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))),
                )
            ).alias("section"),
        )
        .join(documents.select("doc_id", "source_path"), "doc_id")
        .select("source_path", "section")
    )
    found = lookup_sections(asked, documents)
    return found.select(
        "source_path", "section", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("digest")
    )
