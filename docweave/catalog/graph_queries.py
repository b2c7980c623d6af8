"""Registered queries of the property graph.

The trade tables are the graph: tables are labels, primary keys are merge keys,
foreign keys are edges, and an order line is the chunk that states its edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.catalog.corpora import table
from docweave.catalog.registry import query
from docweave.operators import graph as gr
from docweave.operators.joins import sorted_side
from docweave.operators.loose_paths import check_paths
from docweave.plans import guard
from docweave.plans.patterns import Graph, Match, path_counts

# label, table, key column, name column
NODES = (
    ("Region", "region", "r_regionkey", "r_name"),
    ("Nation", "nation", "n_nationkey", "n_name"),
    ("Customer", "customer", "c_custkey", "c_name"),
    ("Supplier", "supplier", "s_suppkey", "s_name"),
    ("Order", "orders", "o_orderkey", "o_orderkey"),
    ("Part", "part", "p_partkey", "p_name"),
)
# type, table, source label, source column, target label, target column
EDGES = (
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    ("IN_NATION", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    ("IN_NATION", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey"),
    ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    ("SUPPLIED_BY", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey"),
)

NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{label}' AS label, CAST({key} AS VARCHAR) AS key, CAST({name} AS VARCHAR) AS name FROM {t}"
    for label, t, key, name in NODES
) + ")"
EDGES_SQL = "edges AS (" + " UNION ALL ".join(
    f"SELECT '{rel}' AS rel_type, '{sl}' AS source_label, CAST({sc} AS VARCHAR) AS source_key, "
    f"'{tl}' AS target_label, CAST({tc} AS VARCHAR) AS target_key FROM {t}"
    for rel, t, sl, sc, tl, tc in EDGES
) + ")"


def _string(column: str):
    return F.col(column).cast("string")


def trade_graph(spark, sf_dir) -> Graph:
    nodes = [
        table(spark, sf_dir, t).select(
            F.lit(label).alias("label"), _string(key).alias("key"), _string(name).alias("name"),
            F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("path"),
        )
        for label, t, key, name in NODES
    ]
    edges = []
    for rel, t, source_label, source, target_label, target in EDGES:
        chunk = (
            F.concat(_string("l_orderkey"), F.lit(":"), _string("l_linenumber")) if t == "lineitem" else _string(source)
        )
        edges.append(
            table(spark, sf_dir, t).select(
                F.lit(rel).alias("rel_type"),
                F.lit(source_label).alias("source_label"), _string(source).alias("source_key"),
                F.lit(target_label).alias("target_label"), _string(target).alias("target_key"),
                chunk.alias("source_chunk"), F.lit(t).alias("source_document"),
            )
        )
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


# Order lines as a batch: the line states an edge part -> supplier. A part is
# mentioned by the lines that were returned, a supplier by those delivered.
def _line_batch(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    order = (F.col("l_orderkey").alias("doc_order"), F.col("l_linenumber").alias("chunk_index"))

    def mention(label, key, where):
        return lines.where(where).select(F.lit(label).alias("label"), _string(key).alias("key"), *order, _string("l_quantity").alias("name"))

    mentions = mention("Part", "l_partkey", F.col("l_returnflag") != "N").unionByName(
        mention("Supplier", "l_suppkey", F.col("l_linestatus") == "F")
    )
    relations = lines.select(
        F.lit("SUPPLIED_BY").alias("rel_type"),
        F.lit("Part").alias("source_label"), _string("l_partkey").alias("source_key"),
        F.lit("Supplier").alias("target_label"), _string("l_suppkey").alias("target_key"),
        F.concat(_string("l_orderkey"), F.lit(":"), _string("l_linenumber")).alias("chunk_id"),
        _string("l_orderkey").alias("doc_id"), *order,
    )
    return mentions, relations


LINES_SQL = """
seen AS (SELECT 'Part' AS label, l_partkey AS key, min(l_orderkey * 100 + l_linenumber) AS first FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 2
         UNION ALL SELECT 'Supplier', l_suppkey, min(l_orderkey * 100 + l_linenumber) FROM lineitem WHERE l_linestatus = 'F' GROUP BY 2),
stated AS (SELECT l_partkey, l_suppkey, max(l_orderkey * 100 + l_linenumber) AS last FROM lineitem GROUP BY ALL),
judged AS (SELECT s.*, coalesce(p.first <= last AND u.first <= last, false) AS visible FROM stated s
           LEFT JOIN seen p ON p.label = 'Part' AND p.key = l_partkey
           LEFT JOIN seen u ON u.label = 'Supplier' AND u.key = l_suppkey)"""


@query(
    f"""WITH {LINES_SQL} SELECT CAST(l_partkey AS VARCHAR) AS source_key, CAST(l_suppkey AS VARCHAR) AS target_key,
          (last // 100) || ':' || (last % 100) AS source_chunk, CAST(last // 100 AS VARCHAR) AS source_document
        FROM judged WHERE visible"""
)
def resolved_edges(spark, sf_dir):
    mentions, relations = _line_batch(spark, sf_dir)
    entities = gr.upsert_entities(None, mentions, ["name"])
    edges = gr.resolve_edges(gr.last_assertions(relations), entities)
    return edges.select("source_key", "target_key", "source_chunk", "source_document")


@query(
    f"""WITH {LINES_SQL} SELECT CAST(l_partkey AS VARCHAR) AS source_key, CAST(l_suppkey AS VARCHAR) AS target_key
        FROM judged WHERE NOT visible"""
)
def skipped_edges(spark, sf_dir):
    mentions, relations = _line_batch(spark, sf_dir)
    entities = gr.upsert_entities(None, mentions, ["name"])
    return gr.skipped_edges(gr.last_assertions(relations), entities).select("source_key", "target_key")


# A second batch: the lines of the urgent orders are stated again, by their order.
@query(
    """WITH lines AS (SELECT l.*, o_orderpriority = '1-URGENT' AS again, o_orderdate FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
       before AS (SELECT l_partkey, l_suppkey, max(l_orderkey * 100 + l_linenumber) AS last FROM lines GROUP BY ALL),
       kept AS (SELECT b.* FROM before b JOIN orders ON o_orderkey = last // 100 WHERE o_orderpriority <> '1-URGENT'),
       new AS (SELECT l_suppkey AS l_partkey, l_suppkey, max(l_orderkey * 100 + l_linenumber) AS last FROM lines WHERE again GROUP BY ALL),
       after AS (SELECT * FROM new UNION ALL SELECT k.* FROM kept k ANTI JOIN new n ON n.l_partkey = k.l_partkey AND n.l_suppkey = k.l_suppkey)
       SELECT CAST(l_partkey AS VARCHAR) AS source_key, CAST(l_suppkey AS VARCHAR) AS target_key,
              (last // 100) || ':' || (last % 100) AS source_chunk FROM after"""
)
def replaced_edges(spark, sf_dir):
    """K5 on edges: urgent orders are ingested again and now link every supplier to itself."""
    _, relations = _line_batch(spark, sf_dir)
    before_all = gr.before_batch(relations)
    ends = lambda s: relations.select(F.col(f"{s}_label").alias("label"), F.col(f"{s}_key").alias("key"))
    entities = (
        ends("source").unionByName(ends("target"))
        .unionByName(ends("target").withColumn("label", F.lit("Part")))
        .distinct().withColumn("first_seen", before_all)
    )
    before = gr.upsert_edges(None, gr.last_assertions(relations), entities, None)
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(_string("o_orderkey").alias("doc_id"))
    again = relations.join(urgent, "doc_id", "left_semi").withColumn("source_key", F.col("target_key"))
    after = gr.upsert_edges(before, gr.last_assertions(again), entities, urgent)
    return after.select("source_key", "target_key", "source_chunk")


@query(
    """WITH w AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS name,
                    CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END AS path FROM orders)
       SELECT CAST(c_custkey AS VARCHAR) AS key,
              coalesce(arg_max(w.name, o_orderkey) FILTER (WHERE w.name IS NOT NULL), max(c_name)) AS name,
              CAST(arg_max(w.path, o_orderkey) FILTER (WHERE w.path IS NOT NULL) AS VARCHAR) AS path
       FROM customer LEFT JOIN w ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def last_writer_properties(spark, sf_dir):
    """Customers are stored, then every order writes one of their properties."""
    stored = table(spark, sf_dir, "customer").select(
        F.lit("Customer").alias("label"), _string("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("path"),
    )
    status = F.col("o_orderstatus")
    writes = table(spark, sf_dir, "orders").select(
        F.lit("Customer").alias("label"), _string("o_custkey").alias("key"),
        F.when(status == "F", F.col("o_orderpriority")).alias("name"),
        F.when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("path"),
        F.col("o_orderkey").alias("doc_order"), F.lit(0).alias("chunk_index"),
    )
    return gr.upsert_entities(stored, writes, ["name", "path"]).select("key", "name", "path")


@query(
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
       again AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
       SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, sha256(line) AS digest FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM again)
       UNION ALL SELECT doc_id, CAST(0 AS BIGINT), sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM again)"""
)
def replaced_documents(spark, sf_dir):
    """K5 on chunks: documents of low quality are ingested again, now as one chunk each."""
    docs = table(spark, sf_dir, "documents")
    row = lambda df: df.select("doc_id", F.col("n").cast("long").alias("chunk_index"), F.sha2("c", 256).alias("digest"))
    current = row(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "c")))
    low = table(spark, sf_dir, "labels").where(F.col("quality") == 0).select("doc_id")
    batch = row(docs.join(low, "doc_id", "left_semi").select("doc_id", F.lit(0).alias("n"), F.col("text").alias("c")))
    return gr.replace_documents(current, batch)


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(count(*) AS BIGINT) AS n
       FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
)
def broken_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        _string("l_orderkey").alias("l_orderkey"), _string("l_linenumber").alias("l_linenumber")
    )
    return gr.duplicate_keys(lines, "l_orderkey", "l_linenumber")


@query(
    f"""WITH {NODES_SQL},{EDGES_SQL} SELECT 'node' AS kind, label AS name, CAST(count(DISTINCT key) AS BIGINT) AS n FROM nodes GROUP BY label
        UNION ALL SELECT 'edge', rel_type, CAST(count(DISTINCT (source_label, source_key, target_label, target_key)) AS BIGINT)
        FROM edges GROUP BY rel_type"""
)
def graph_counts(spark, sf_dir):
    graph = trade_graph(spark, sf_dir)
    nodes = gr.entity_counts(graph.entities).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    edges = gr.edge_counts(graph.edges).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("name"), "n")
    return nodes.unionByName(edges)


@query(
    f"""WITH {NODES_SQL},{EDGES_SQL}, every AS (
          SELECT DISTINCT 'node' AS kind, label, name AS source, NULL AS target FROM nodes
          UNION SELECT DISTINCT 'edge', rel_type, a.name, b.name FROM edges
            JOIN nodes a ON a.label = source_label AND a.key = source_key
            JOIN nodes b ON b.label = target_label AND b.key = target_key)
        SELECT kind, label, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(source)) AS BIGINT) AS chars FROM every GROUP BY kind, label"""
)
def graph_inventory(spark, sf_dir):
    graph = trade_graph(spark, sf_dir)
    return gr.graph_inventory(graph.entities, graph.edges).groupBy("kind", "label").agg(
        F.count("*").alias("n"), F.sum(F.length("source")).alias("chars")
    )


@query(
    """SELECT n_name, CAST(count(*) AS BIGINT) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey
       JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""
)
def suppliers_by_nation(spark, sf_dir):
    """(s:Supplier)-[IN_NATION]->(n:Nation)-[IN_REGION]->(r:Region {name: ASIA})."""
    found = (
        Match(trade_graph(spark, sf_dir))
        .node("s", "Supplier")
        .edge("a", "IN_NATION")
        .node("n", "Nation", ("name",))
        .edge("b", "IN_REGION")
        .node("r", "Region", where=F.col("name") == "ASIA")
        .rows
    )
    return found.groupBy(F.col("n_name")).agg(F.count("*").alias("suppliers"))


@query(
    """SELECT CAST(l_partkey AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS paths
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY l_partkey"""
)
def paths_from_regions(spark, sf_dir):
    """J5 with count(): five labels, four hops, summed hop by hop."""
    return path_counts(
        trade_graph(spark, sf_dir),
        "Region",
        ("IN_REGION", "in", "Nation"),
        ("IN_NATION", "in", "Customer"),
        ("PLACED", "out", "Order"),
        ("CONTAINS", "out", "Part"),
    )


@query(
    f"""WITH {EDGES_SQL}, ends AS (SELECT target_key AS nation, source_label AS other FROM edges WHERE target_label = 'Nation'
          UNION ALL SELECT source_key, target_label FROM edges WHERE source_label = 'Nation')
        SELECT nation, other, CAST(count(*) AS BIGINT) AS n FROM ends GROUP BY nation, other"""
)
def nation_neighbours(spark, sf_dir):
    """J5 without direction: (n:Nation)-[r]-(x)."""
    found = Match(trade_graph(spark, sf_dir)).node("n", "Nation").edge("r", direction="any").node("x").rows
    return found.groupBy(F.col("n_key").alias("nation"), F.col("x_label").alias("other")).agg(F.count("*").alias("n"))


_ALNUM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def _loose(e: str, a: str) -> str:
    return f"({e} <> '' AND {a} <> '' AND (contains({a}, {e}) OR contains({e}, {a})))"


_LONG_PATHS_SQL = f"""WITH {NODES_SQL},{EDGES_SQL},
        names AS (SELECT DISTINCT {_ALNUM.format('name')} AS name FROM nodes),
        triples AS (SELECT DISTINCT rel_type, {_ALNUM.format('a.name')} AS source, {_ALNUM.format('b.name')} AS target FROM edges
            JOIN nodes a ON a.label = source_label AND a.key = source_key
            JOIN nodes b ON b.label = target_label AND b.key = target_key),
        supplied AS (SELECT l_partkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_partkey),
        wanted AS (SELECT 'hop-' || n_nationkey AS path_id, [replace(n_name, '_', ' '),
              CASE n_nationkey % 3 WHEN 0 THEN 'in_region' WHEN 1 THEN 'PLACED' ELSE 'OWNS' END, r_name || '!'] AS path
            FROM nation JOIN region ON r_regionkey = (n_nationkey * 2) % 5
          UNION ALL SELECT 'node-' || r_regionkey, ['the ' || r_name || ' market'] FROM region
          UNION ALL SELECT 'none-' || r_regionkey, ['zz', 'IN_REGION', ''] FROM region
          UNION ALL SELECT 'two-' || c_custkey, [c_name, 'In_Nation', n_name, CASE WHEN c_custkey % 2 = 0 THEN 'IN_REGION' ELSE 'PLACED' END, r_name]
            FROM customer JOIN nation ON n_nationkey = c_nationkey
            JOIN region ON r_regionkey = CASE WHEN c_custkey % 3 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END
          UNION ALL SELECT 'three-' || p_partkey, ['a ' || p_name, 'SUPPLIED_BY', s_name, 'IN_NATION', n_name, CASE WHEN p_partkey % 4 = 0 THEN 'OWNS' ELSE 'IN_REGION' END, r_name]
            FROM part JOIN supplied ON l_partkey = p_partkey JOIN supplier ON s_suppkey = suppkey
            JOIN nation ON n_nationkey = CASE WHEN p_partkey % 5 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END
            JOIN region ON r_regionkey = n_regionkey),
        norm AS (SELECT path_id, len(path) // 2 AS hops, path[2] AS r1, path[4] AS r2, path[6] AS r3, {_ALNUM.format("path[1]")} AS n0,
            {_ALNUM.format("coalesce(path[3], '')")} AS n1, {_ALNUM.format("coalesce(path[5], '')")} AS n2, {_ALNUM.format("coalesce(path[7], '')")} AS n3 FROM wanted),
        pairs AS (SELECT n, name FROM (SELECT n0 AS n FROM norm UNION SELECT n1 FROM norm) JOIN names ON {_loose('n', 'name')}),
        begun AS (SELECT path_id, source, target, rel_type FROM norm JOIN pairs ON n = n0 JOIN triples ON source = name WHERE {_loose('n1', 'target')}),
        linked AS (SELECT path_id, string_agg(DISTINCT rel_type, ', ' ORDER BY rel_type) AS types FROM begun GROUP BY path_id),
        f1 AS (SELECT DISTINCT path_id, target AS node FROM begun JOIN norm USING (path_id) WHERE rel_type = upper(r1)),
        f2 AS (SELECT DISTINCT path_id, target AS node FROM f1 JOIN norm USING (path_id)
            JOIN triples ON source = node AND rel_type = upper(r2) WHERE {_loose('n2', 'target')}),
        f3 AS (SELECT DISTINCT path_id FROM f2 JOIN norm USING (path_id)
            JOIN triples ON source = node AND rel_type = upper(r3) WHERE {_loose('n3', 'target')}),
        found AS (SELECT *, n0 IN (SELECT n FROM pairs) AS s_ok, n1 IN (SELECT n FROM pairs) AS t_ok,
            CASE WHEN path_id IN (SELECT path_id FROM f3) THEN 3 WHEN path_id IN (SELECT path_id FROM f2) THEN 2
                WHEN path_id IN (SELECT path_id FROM f1) THEN 1 ELSE 0 END AS hops_ok
            FROM norm LEFT JOIN linked USING (path_id)),
        judged AS (SELECT *, CASE WHEN r1 IS NULL THEN s_ok ELSE hops_ok > 0 END AS ok FROM found)
        SELECT path_id, ok, CASE WHEN ok THEN '' WHEN r1 IS NULL THEN 'node missing'
           WHEN NOT s_ok AND NOT t_ok THEN 'both nodes missing' WHEN types IS NOT NULL THEN 'connected via ' || types
           WHEN upper(r1) NOT IN (SELECT rel_type FROM edges) THEN 'type missing'
           ELSE 'no edge; start=' || s_ok || ' end=' || t_ok END AS near_miss, CAST(hops AS INTEGER) AS hops, hops_ok,
           CASE WHEN r1 IS NULL THEN s_ok ELSE hops_ok = hops END AS full_ok FROM judged"""


@query(_LONG_PATHS_SQL)
def path_checks(spark, sf_dir):
    """Loosely named paths of none to three hops, looked for among all names and edges; some break at a later hop."""
    graph = trade_graph(spark, sf_dir)
    listed = gr.graph_inventory(graph.entities, graph.edges)
    nodes = listed.where(F.col("kind") == "node").select(F.col("source").alias("name"))
    edges = listed.where(F.col("kind") == "edge").select("source", F.col("label").alias("type"), "target")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    rel = F.when(key % 3 == 0, "in_region").when(key % 3 == 1, "PLACED").otherwise("OWNS")
    hops = nation.join(region, F.col("r_regionkey") == (key * 2) % 5).select(
        F.concat(F.lit("hop-"), key.cast("string")).alias("path_id"),
        F.array(F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")), rel, F.concat("r_name", F.lit("!"))).alias("path"),
    )
    single = region.select(
        F.concat(F.lit("node-"), _string("r_regionkey")).alias("path_id"),
        F.array(F.concat(F.lit("the "), "r_name", F.lit(" market"))).alias("path"),
    )
    none = region.select(
        F.concat(F.lit("none-"), _string("r_regionkey")).alias("path_id"),
        F.array(F.lit("zz"), F.lit("IN_REGION"), F.lit("")).alias("path"),
    )
    customer, supplier, part = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    two = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    moved = F.when(F.col("c_custkey") % 3 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    two = two.join(region, F.col("r_regionkey") == moved).select(
        F.concat(F.lit("two-"), _string("c_custkey")).alias("path_id"),
        F.array("c_name", F.lit("In_Nation"), "n_name", F.when(F.col("c_custkey") % 2 == 0, "IN_REGION").otherwise("PLACED"), "r_name").alias("path"),
    )
    supplied = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    three = part.join(sorted_side(supplied), F.col("l_partkey") == F.col("p_partkey")).join(sorted_side(supplier), "s_suppkey")
    next_door = F.when(F.col("p_partkey") % 5 == 0, (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey"))
    last = F.when(F.col("p_partkey") % 4 == 0, "OWNS").otherwise("IN_REGION")
    three = three.join(nation, F.col("n_nationkey") == next_door).join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.concat(F.lit("three-"), _string("p_partkey")).alias("path_id"),
        F.array(F.concat(F.lit("a "), "p_name"), F.lit("SUPPLIED_BY"), "s_name", F.lit("IN_NATION"), "n_name", last, "r_name").alias("path"),
    )
    return check_paths(reduce(DataFrame.unionByName, [hops, single, none, two, three]), nodes, edges)


# Statements as a model may write them over the graph's views, with the rows they give; None: the guard refuses them.
_READS = {
    "label": "SELECT name FROM nodes WHERE label = 'Nation'",
    "link": "SELECT n.name FROM nodes n JOIN edges e ON n.label = e.source_label AND n.key = e.source_key WHERE e.rel_type = 'IN_REGION'",
    "with": "WITH s AS (SELECT key FROM nodes WHERE label = 'Supplier') SELECT * FROM s JOIN edges ON target_key = s.key WHERE target_label = 'Supplier'",
    "not in": "SELECT name FROM nodes WHERE label = 'Customer' AND key NOT IN (SELECT source_key FROM edges WHERE rel_type = 'PLACED')",
    "exists": "SELECT key FROM nodes p WHERE label = 'Part' AND EXISTS (SELECT 1 FROM edges e WHERE e.target_label = 'Part' AND e.target_key = p.key)",
    "groups": "SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type HAVING count(*) > 5",
    "shadow": "WITH nodes AS (SELECT key FROM nodes WHERE label = 'Region') SELECT * FROM nodes",
    "near": "SELECT * FROM nodes a JOIN nodes b ON a.label = b.label AND a.key < b.key WHERE a.label = 'Region' AND b.label = 'Region'",
}
_REFUSED = {
    "hidden": "SELECT * FROM hidden_documents",
    "hidden with": "WITH hidden_documents AS (SELECT * FROM hidden_documents) SELECT * FROM hidden_documents",
    "hidden name": "SELECT * FROM IDENTIFIER('hidden_documents')",
    "hidden inside": "SELECT name FROM nodes WHERE key IN (SELECT source FROM hidden_documents)",
    "all pairs": "SELECT * FROM nodes a JOIN nodes b ON a.key < b.key",
    "cross": "SELECT * FROM nodes, edges",
    "write": "CREATE TEMPORARY VIEW copied AS SELECT * FROM nodes",
}


@query(
    f"WITH {NODES_SQL},{EDGES_SQL} "
    + " UNION ALL ".join(f"SELECT '{name}' AS statement, 'ok' AS verdict, (SELECT count(*) FROM ({sql})) AS n" for name, sql in _READS.items())
    + "".join(f" UNION ALL SELECT '{name}', 'refused', NULL" for name in _REFUSED)
)
def guarded_statements(spark, sf_dir):
    """What the guard says of statements over the graph, and how many rows those that may run give."""
    trade_graph(spark, sf_dir).register_views()
    table(spark, sf_dir, "documents").createOrReplaceTempView("hidden_documents")
    results = []
    for name, statement in {**_READS, **_REFUSED}.items():
        try:
            counted = guard.checked(spark, statement, ("nodes", "edges")).agg(F.count("*").alias("n"))
            results.append(counted.select(F.lit(name).alias("statement"), F.lit("ok").alias("verdict"), "n"))
        except guard.Refused:
            results.append(spark.range(1).select(F.lit(name).alias("statement"), F.lit("refused").alias("verdict"), F.lit(None).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, results)
