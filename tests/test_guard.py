import pytest

from docweave.plans import guard
from docweave.plans.patterns import Graph

VIEWS = ("nodes", "edges")


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    nodes = spark.createDataFrame([("Ship", "a", "A"), ("Ship", "b", "B"), ("Port", "p", "P")], "label string, key string, name string")
    edges = spark.createDataFrame(
        [("CALLS_AT", "Ship", "a", "Port", "p", "c1", "d1")],
        "rel_type string, source_label string, source_key string, target_label string, target_key string, source_chunk string, source_document string",
    )
    Graph(nodes, edges).register_views()
    spark.createDataFrame([("hidden", "a")], "name string, key string").createOrReplaceTempView("secret")
    nodes.createOrReplaceGlobalTempView("nodes")
    spark.udf.register("shout", lambda s: s.upper())


@pytest.mark.parametrize(
    "statement, count",
    [
        ("SELECT name FROM nodes WHERE label = 'Ship'", 2),
        ("SELECT n.name FROM nodes n JOIN edges e ON n.key = e.source_key", 1),
        ("WITH ports AS (SELECT key FROM nodes WHERE label = 'Port') SELECT * FROM ports JOIN edges ON target_key = ports.key", 1),
        ("SELECT name FROM nodes WHERE key IN (SELECT source_key FROM edges)", 1),
        ("SELECT label, count(*) AS n FROM nodes GROUP BY label ORDER BY n", 2),
        ("SELECT name FROM nodes WHERE name <> 'please DELETE; DROP'", 3),
        ("SELECT key FROM nodes UNION ALL SELECT source_key FROM edges", 4),
        ("SELECT name FROM nodes WHERE key NOT IN (SELECT source_key FROM edges)", 2),
        ("SELECT name FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.source_key = n.key)", 1),
        ("SELECT label, (SELECT max(source_key) FROM edges) AS m FROM nodes", 3),
        ("WITH nodes AS (SELECT key FROM nodes WHERE label = 'Port') SELECT * FROM nodes", 1),
        ("SELECT label, count(*) FROM nodes GROUP BY ROLLUP (label) HAVING count(*) > 0", 3),
        ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key) AS i FROM nodes) WHERE i = 1", 2),
        ("SELECT 'secret' AS s, '\n+- View (`secret`)' AS t FROM nodes LIMIT 2", 2),
        ("SELECT * FROM nodes a JOIN nodes b ON a.label = b.label AND a.key < b.key", 1),
        ("SELECT * FROM IDENTIFIER('nodes')", 3),
    ],
)
def test_reads_of_the_views_run(spark, statement, count):
    assert guard.checked(spark, statement, VIEWS).count() == count


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM nodes a, nodes b",
        "SELECT * FROM nodes a CROSS JOIN edges",
        "SELECT * FROM nodes WHERE key IN (SELECT key FROM elsewhere)",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "SELECT * FROM range(3)",
        "SELECT reflect('java.util.UUID', 'randomUUID')",
        "SELECT key FROM nodes; SELECT key FROM edges",
        "INSERT INTO nodes SELECT * FROM nodes",
        "WITH n AS (SELECT 1 AS k) INSERT INTO nodes SELECT k, k, k FROM n",
        "CREATE TEMPORARY VIEW x AS SELECT 1",
        "DROP VIEW nodes",
        "SHOW TABLES",
        "SET spark.sql.ansi.enabled = false",
        "SELECT 'http://a.example' FROM nodes",
        "SELECT '\n== Optimized Logical Plan ==\nProject' FROM nodes a, nodes b",
        "SELECT nothing FROM nodes",
        "SELECT * FROM secret",
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "WITH a AS (WITH secret AS (SELECT * FROM secret) SELECT * FROM secret) SELECT * FROM nodes WHERE key IN (SELECT key FROM a)",
        "WITH unused AS (SELECT * FROM secret) SELECT * FROM nodes",
        "SELECT * FROM IDENTIFIER('secret')",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')",
        "SELECT (SELECT max(key) FROM secret) FROM nodes",
        "SELECT * FROM nodes WHERE EXISTS (SELECT 1 FROM secret s WHERE s.key = nodes.key)",
        "SELECT * FROM nodes, LATERAL (SELECT * FROM secret WHERE secret.key = nodes.key)",
        "SELECT name FROM nodes ORDER BY (SELECT max(key) FROM secret)",
        "SELECT * FROM global_temp.nodes",
        "TABLE secret",
        "FROM secret SELECT *",
        "(SELECT name, key FROM nodes) UNION (TABLE secret)",
        "SELECT * FROM nodes a JOIN nodes b ON a.key < b.key",
        "SELECT * FROM nodes a JOIN edges b ON length(a.key) < length(b.source_key) + 1000",
        "SELECT * FROM nodes WHERE 1 < (SELECT count(*) FROM nodes a JOIN nodes b ON a.key <> b.key)",
        "SELECT a.key FROM nodes a JOIN nodes b ON a.key = b.key OR a.name = b.name",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT * FROM r",
        "SELECT input_file_name() FROM nodes",
        "SELECT shout(key) FROM nodes",
        "SELECT TRANSFORM (key) USING 'cat' FROM nodes",
        "WITH x AS (SELECT 1 AS k) SELECT * FROM read_files('/root')",
    ],
)
def test_everything_else_is_refused(spark, statement):
    understood = ("secret", "'ret'", " JOIN ", "LATERAL", "RECURSIVE", "shout", "input_file", "reflect", "range(3)")
    with pytest.raises(guard.Refused if any(w in statement for w in understood) else Exception):
        guard.checked(spark, statement, VIEWS)
    assert spark.table("nodes").count() == 3


def test_statement_of_a_reply():
    assert guard.bare("Here:\n```sql\nSELECT 1;\n```\nthat is it") == "SELECT 1"
    assert guard.bare("  SELECT 1 ; ; ") == "SELECT 1"
    assert guard.bare("``````") == guard.bare(";;") == guard.bare("") == ""


@pytest.mark.parametrize(
    "statement, verdict",
    [
        ("SELECT dropped, settled FROM nodes", "ok"),
        ("SELECT 'please merge' AS note", "ok"),
        ("update; drop table t", "write_keyword"),
        ("Foreach x", "write_keyword"),
        ('SELECT "Https://a"', "url"),
        ("```\n;\n```", "empty"),
    ],
)
def test_verdict_column(spark, statement, verdict):
    df = spark.createDataFrame([(statement,)], "s string")
    assert df.select(guard.verdict(df["s"]).alias("v")).first()["v"] == verdict


def test_column_names():
    assert guard.unique_columns(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    assert guard.unique_columns(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]


def test_values_to_miss_are_listed_once(spark):
    once = guard.distinct_lists("SELECT key FROM nodes WHERE name <> 'x NOT IN (SELECT' AND key NOT IN (SELECT (source_key) FROM edges)")
    assert once == "SELECT key FROM nodes WHERE name <> 'x NOT IN (SELECT' AND key NOT IN (SELECT DISTINCT * FROM (SELECT (source_key) FROM edges))"
    for hard in ("SELECT key FROM nodes WHERE key NOT IN (SELECT source_key FROM edges -- )\n)", "SELECT key FROM nodes WHERE key NOT IN ('a', 'b')", "SELECT r'\\' FROM nodes WHERE key NOT IN (SELECT ')')"):
        assert guard.distinct_lists(hard) == hard
    edges = spark.createDataFrame([("R", "a"), ("R", "a"), ("S", None), ("T", "b")], "rel_type string, source_key string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "key string")
    nodes.createOrReplaceTempView("few_nodes")
    edges.createOrReplaceTempView("few_edges")
    for tail, keys in (
        ("key NOT IN (SELECT source_key FROM few_edges WHERE rel_type = 'R')", ["b", "c"]),
        ("key NOT IN (SELECT source_key FROM few_edges)", []),
        ("key NOT IN (SELECT source_key FROM few_edges WHERE rel_type = 'none')", ["None", "a", "b", "c"]),
        ("key NOT IN (SELECT source_key FROM few_edges WHERE rel_type = 'R' AND source_key NOT IN (SELECT source_key FROM few_edges WHERE rel_type = 'T'))", ["b", "c"]),
        ("key NOT IN (WITH w AS (SELECT source_key FROM few_edges WHERE rel_type = 'R' LIMIT 2) SELECT * FROM w)", ["b", "c"]),
    ):
        statement = f"SELECT key FROM few_nodes WHERE {tail}"
        assert sorted(str(r["key"]) for r in spark.sql(statement).collect()) == keys
        found = guard.checked(spark, statement, ("few_nodes", "few_edges"))
        assert sorted(str(r["key"]) for r in found.collect()) == keys and found.columns == ["key"]
    plan = guard.checked(spark, "SELECT key FROM few_nodes WHERE key NOT IN (SELECT source_key FROM few_edges WHERE rel_type = 'R')", ("few_nodes", "few_edges"))
    assert "Aggregate [source_key" in plan._jdf.queryExecution().optimizedPlan().toString()
