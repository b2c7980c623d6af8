"""Registered queries of the text functions, sources and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.catalog.corpora import table
from docweave.catalog.registry import WS, query
from docweave.functions import text as tx
from docweave.plans import guard
from docweave.plans.nlquery import row_text
from docweave.sources import corpus
from docweave.streaming import events as ev

NAMES = (
    ("part", "p_name"),
    ("part", "p_type"),
    ("part", "p_brand"),
    ("customer", "c_name"),
    ("customer", "c_mktsegment"),
    ("orders", "o_orderpriority"),
    ("supplier", "s_name"),
)
NAMES_SQL = " UNION ALL ".join(f"SELECT {c} AS name FROM {t}" for t, c in NAMES)


def _names(spark, sf_dir):
    out = None
    for name, column in NAMES:
        rows = table(spark, sf_dir, name).select(F.col(column).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""SELECT trim(regexp_replace(lower(name), '[-_\\s]+', ' ', 'g')) AS key, CAST(count(*) AS BIGINT) AS n
        FROM ({NAMES_SQL}) GROUP BY 1"""
)
def normalized_names(spark, sf_dir):
    return _names(spark, sf_dir).groupBy(tx.normalize_name(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, CAST(count(*) AS BIGINT) AS n
        FROM ({NAMES_SQL}) GROUP BY 1"""
)
def alnum_names(spark, sf_dir):
    return _names(spark, sf_dir).groupBy(tx.alnum_name(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CAST(length(q) AS BIGINT) AS n_chars, sha256(q) AS digest
       FROM (SELECT doc_id, trim(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS q FROM documents)"""
)
def sanitized_text(spark, sf_dir):
    q = tx.sanitize_query(F.col("text"))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", q.alias("q"))
        .select("doc_id", F.length("q").cast("long").alias("n_chars"), F.sha2("q", 256).alias("digest"))
    )


@query(
    """WITH refs AS (SELECT o_orderkey, CASE o_orderpriority
          WHEN '1-URGENT' THEN 'CPS ' || (100 + o_custkey % 900) || ':' || o_orderkey
          WHEN '2-HIGH' THEN 'see CPS' || (100 + o_custkey % 900) || ' clause ' || o_orderkey
          WHEN '3-MEDIUM' THEN ' CPS   ' || (100 + o_custkey % 900)
          WHEN '4-NOT SPECIFIED' THEN 'clause ' || o_orderkey ELSE '  ' END AS reference,
          CASE o_orderstatus WHEN 'F' THEN o_orderstatus || ':' || o_custkey WHEN 'O' THEN '' ELSE 'bad id' END AS given
        FROM orders)
       SELECT o_orderkey, reference,
         CASE WHEN regexp_full_match(trim(reference), '[^:]+:[0-9]+') THEN trim(reference)
              WHEN regexp_matches(reference, '^[^:]*?CPS\\s*\\d{3}') AND regexp_matches(reference, '\\d\\s*$')
              THEN regexp_replace(regexp_extract(trim(reference), '^[^:]*?(CPS\\s*\\d{3})', 1), '\\s+', ' ', 'g')
                   || ':' || regexp_extract(trim(reference), '(\\d+)\\s*$', 1) END AS endpoint,
         CASE WHEN given = 'bad id' THEN NULL WHEN given <> '' THEN given
              ELSE 'CPS 234:' || o_orderkey END AS identity
       FROM refs"""
)
def clause_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    number, doc = F.col("o_orderkey").cast("string"), (100 + F.col("o_custkey") % 900).cast("string")
    reference = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("CPS "), doc, F.lit(":"), number))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("see CPS"), doc, F.lit(" clause "), number))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit(" CPS   "), doc))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("clause "), number))
        .otherwise("  ")
    )
    given = F.when(
        F.col("o_orderstatus") == "F", F.concat("o_orderstatus", F.lit(":"), F.col("o_custkey").cast("string"))
    ).when(F.col("o_orderstatus") == "O", "").otherwise("bad id")
    return orders.select(
        "o_orderkey",
        reference.alias("reference"),
        tx.endpoint_key(F.lit("CpsClause"), reference).alias("endpoint"),
        tx.clause_identity(given, F.lit("CPS 234"), number).alias("identity"),
    )


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN text WHEN 'system' THEN 'Relationship: ' || text
                     ELSE 'compliance-mapping, ' || text END AS reply FROM conversations),
        w AS (SELECT *, list_filter(string_split_regex(reply, '\\s+'), lambda x: x <> '') AS ws FROM t),
        f AS (SELECT *, trim(lower(ws[1]), '.,:;!?"''') AS tok FROM w)
       SELECT conv_id, turn, coalesce(nullif(tok, ''), 'none') AS token,
              CASE WHEN tok IN ('lookup', 'relationship', 'compliance-mapping') THEN tok ELSE 'lookup' END AS route,
              array_to_string(ws[2:], ' ') AS rationale, array_to_string(ws, ' ') AS purpose,
              substring(array_to_string(ws, ' '), 1, 48) AS short_purpose FROM f"""
)
def route_replies(spark, sf_dir):
    reply = (
        F.when(F.col("role") == "user", F.col("text"))
        .when(F.col("role") == "system", F.concat(F.lit("Relationship: "), "text"))
        .otherwise(F.concat(F.lit("compliance-mapping, "), "text"))
    )
    replies = table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return replies.select(
        "conv_id",
        "turn",
        tx.first_token(F.col("reply"), "none").alias("token"),
        tx.route(F.col("reply")).alias("route"),
        tx.route_rationale(F.col("reply")).alias("rationale"),
        tx.purpose_label(F.col("reply")).alias("purpose"),
        tx.purpose_label(F.col("reply"), 48).alias("short_purpose"),
    )


# Statements of many shapes, one per customer, with the customer's name as a literal.
def _statement():
    name, quoted = F.col("c_name"), F.concat(F.lit("'"), F.col("c_name"), F.lit("'"))
    nation = F.col("c_nationkey")
    shapes = [
        F.concat(F.lit("MATCH (n) WHERE n.name = "), quoted, F.lit(" RETURN n;")),
        F.concat(F.lit("match (n) set n.name = "), quoted),
        F.concat(F.lit("```cypher\nMATCH (n {name: "), quoted, F.lit("}) RETURN n.settings\n```")),
        F.concat(F.lit("MATCH (n) WHERE n.note = 'please CALL "), name, F.lit("' RETURN n")),
        F.concat(F.lit("MATCH (n) RETURN 'HTTPS://x.example/"), name, F.lit("'")),
        F.concat(F.lit('MATCH (n) WHERE n.x = "it\\"s DELETE" MERGE (m {name: '), quoted, F.lit("})")),
        F.lit(" ;; "),
    ]
    out = F.lit("").cast("string")
    for i, shape in enumerate(shapes):
        out = F.when(nation % len(shapes) == i, shape).otherwise(out)
    return out


@query(
    """WITH s AS (SELECT c_custkey, CASE c_nationkey % 7
          WHEN 0 THEN 'MATCH (n) WHERE n.name = ''' || c_name || ''' RETURN n;'
          WHEN 1 THEN 'match (n) set n.name = ''' || c_name || ''''
          WHEN 2 THEN '```cypher' || chr(10) || 'MATCH (n {name: ''' || c_name || '''}) RETURN n.settings' || chr(10) || '```'
          WHEN 3 THEN 'MATCH (n) WHERE n.note = ''please CALL ' || c_name || ''' RETURN n'
          WHEN 4 THEN 'MATCH (n) RETURN ''HTTPS://x.example/' || c_name || ''''
          WHEN 5 THEN 'MATCH (n) WHERE n.x = "it\\"s DELETE" MERGE (m {name: ''' || c_name || '''})'
          ELSE ' ;; ' END AS raw FROM customer),
       c AS (SELECT c_custkey, trim(rtrim(trim(CASE WHEN raw LIKE '```%' THEN regexp_extract(raw, '(?s)```(?:cypher)?\\s*(.*?)```', 1)
                                     ELSE raw END, ' ' || chr(10)), ';'), ' ' || chr(10)) AS statement FROM s)
       SELECT c_custkey, statement, CASE WHEN statement = '' THEN 'empty'
          WHEN regexp_matches(statement, '(?i)https?://') THEN 'url'
          WHEN regexp_matches(regexp_replace(statement, '''(?:[^''\\\\]|\\\\.)*''|"(?:[^"\\\\]|\\\\.)*"', '''''', 'g'),
               '(?i)\\b(CREATE|MERGE|DELETE|SET|DETACH|DROP|REMOVE|CALL|LOAD|FOREACH)\\b') THEN 'write_keyword'
          ELSE 'ok' END AS verdict FROM c"""
)
def guard_verdicts(spark, sf_dir):
    statements = table(spark, sf_dir, "customer").select("c_custkey", _statement().alias("raw"))
    return statements.select(
        "c_custkey", guard.cleaned(F.col("raw")).alias("statement"), guard.verdict(F.col("raw")).alias("verdict")
    )


@query(
    """WITH r AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","text":' || to_json(text) || '}' AS line,
                    text FROM documents)
       SELECT doc_id, sha256(line) AS row_digest, sha256(text) AS message_digest,
              CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || ' [truncated]' ELSE text END AS short_message,
              CASE WHEN length(text) > 180 THEN substring(text, 1, 180) || '…' ELSE text END AS short_summary FROM r"""
)
def row_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(row_text("doc_id", "lang", "text"), 256).alias("row_digest"),
        F.sha2(tx.trim_message(F.col("text")), 256).alias("message_digest"),
        tx.trim_message(F.col("text"), 400).alias("short_message"),
        tx.summarize(F.col("text"), 180).alias("short_summary"),
    )


@query(
    """SELECT label, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT p_name || CASE WHEN l_returnflag = 'A' THEN ' — ¶' || l_linenumber
                               WHEN l_returnflag = 'R' THEN ' — src/' || l_suppkey || '.py#load'
                               WHEN l_linestatus = 'F' THEN ' — Line ' || l_linestatus ELSE '' END AS label
         FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY label"""
)
def citation_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    flag = F.col("l_returnflag")
    label = tx.citation_label(
        F.col("p_name"),
        F.when(flag == "A", F.col("l_linenumber").cast("string")).otherwise(""),
        F.when(flag == "R", F.concat(F.lit("src/"), F.col("l_suppkey").cast("string"), F.lit(".py#load"))).otherwise(""),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Line "), "l_linestatus")).otherwise(""),
    )
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


# Pages as files: the host's first label is the folder, the path the file.
PAGE_FILES_SQL = """files AS (SELECT page_id, ['regulatory', 'security', 'architecture', 'code'][page_id % 4 + 1] AS doc_type,
    page_id % 4 + 1 AS class_order, regexp_extract(url, '://([^/]+)/', 1) AS host,
    regexp_extract(url, '://[^/]+/[a-z]+/([0-9]+)', 1) AS stem, html FROM pages)"""


def _page_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = F.get(F.array(*map(F.lit, corpus.DOC_TYPES)), (F.col("page_id") % 4).cast("int"))
    path = F.concat(
        F.lit("file:/corpus/data/"), kind, F.lit("/"), F.regexp_extract("url", "://([^/]+)/", 1), F.lit("/"),
        F.regexp_extract("url", "://[^/]+/[a-z]+/([0-9]+)", 1), F.lit("."), F.col("page_id").cast("string"), F.lit(".md"),
    )
    return pages.select("page_id", path.alias("path"), "html")


@query(
    f"""WITH {PAGE_FILES_SQL}, named AS (SELECT *, stem || '.' || page_id || '.md' AS file FROM files),
        stems AS (SELECT *, stem AS doc_stem, 'data/' || doc_type || '/' || host || '/' || file AS source_path,
                    row_number() OVER (PARTITION BY stem ORDER BY class_order, host, file) AS rn FROM named)
       SELECT page_id, doc_type, source_path,
              CASE WHEN rn = 1 THEN stem ELSE stem || '-' || substring(sha256(source_path), 1, 8) END AS doc_id
       FROM stems"""
)
def document_ids(spark, sf_dir):
    """S1, S6 over a listing; the page number is cut from the name so that stems collide."""
    files = corpus.walk(_page_files(spark, sf_dir).drop("html"), "file:/corpus/data")
    files = files.withColumn("stem", F.substring_index("stem", ".", 1))
    return corpus.with_doc_ids(files, corpus.later_namesakes(files)).select("page_id", "doc_type", "source_path", "doc_id")


@query(
    f"""WITH m AS (SELECT page_id, 'Page ' || page_id AS fallback, string_split(
                regexp_replace(regexp_replace(html, '<h1[^>]*>', chr(10) || CASE WHEN page_id % 3 = 0 THEN '## ' ELSE ' #' END, 'g'),
                               '</h1>|<p>', chr(10), 'g'), chr(10)) AS ls FROM pages),
        t AS (SELECT page_id, fallback, list_filter(list_transform(ls, lambda l: trim(l, {WS})),
                 lambda l: l LIKE '#%' AND l NOT LIKE '##%' AND trim(ltrim(l, '#'), {WS}) <> '') AS hs FROM m)
       SELECT page_id, CASE WHEN len(hs) > 0 THEN trim(ltrim(hs[1], '#'), {WS}) ELSE fallback END AS title FROM t"""
)
def document_titles(spark, sf_dir):
    marker = F.when(F.col("page_id") % 3 == 0, "\n## ").otherwise("\n #")
    text = F.regexp_replace(
        F.regexp_replace(F.col("html"), F.lit("<h1[^>]*>"), marker), "</h1>|<p>", "\n"
    )
    fallback = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", tx.markdown_title(text, fallback).alias("title"))


@query(
    """WITH r AS (SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, page_id % 5 AS shape FROM pages)
       SELECT page_id, CASE shape WHEN 0 THEN host || '/x.md' WHEN 1 THEN NULL WHEN 2 THEN 'x.md'
                            WHEN 3 THEN NULL ELSE host || '/b.md' END AS resolved FROM r"""
)
def source_paths(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/]+)/", 1)
    shapes = [
        F.concat(F.lit("data/"), host, F.lit("/x.md")),
        F.concat(F.lit("../"), host),
        F.concat(F.lit("data/"), host, F.lit("/../x.md")),
        F.concat(F.lit("/etc/"), host),
        F.concat(F.lit("../data/./"), host, F.lit("//a/../b.md")),
    ]
    asked = F.get(F.array(*shapes), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", corpus.resolve_source(asked, "/app/data").alias("resolved"))


@query(
    """SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS answer_digest,
              CAST(count(*) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars
       FROM conversations GROUP BY conv_id"""
)
def token_streams(spark, sf_dir):
    joined = ev.answers(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return joined.select("conv_id", F.sha2("answer", 256).alias("answer_digest"), "tokens", "chars")


@query(
    """SELECT conv_id, turn, sha256('data: {"type":"token","conv":' || conv_id || ',"text":' || to_json(text) || '}'
                                     || chr(10) || chr(10)) AS line_digest,
              CASE WHEN role <> 'system' THEN text END AS token
       FROM conversations"""
)
def event_lines(spark, sf_dir):
    """Encodes every turn as an event line, then reads it back; system turns get a foreign prefix."""
    line = ev.event_line(F.lit("token").alias("type"), F.col("conv_id").alias("conv"), F.col("text").alias("text"))
    sent = table(spark, sf_dir, "conversations").withColumn("line", line)
    received = F.when(F.col("role") == "system", F.concat(F.lit(": "), "line")).otherwise(F.col("line"))
    return sent.select(
        "conv_id",
        "turn",
        F.sha2("line", 256).alias("line_digest"),
        F.variant_get(ev.event_payload(F.rtrim(received, F.lit("\n"))), "$.text", "string").alias("token"),
    )
