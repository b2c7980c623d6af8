import json
import re

import pytest
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.functions import payload as pl
from docweave.functions import text as tx
from docweave.operators import extraction as ex
from docweave.plans.graph_schema import GraphSchema
from docweave.plans.llm import Reply, ScriptedModel

SCHEMA = GraphSchema.load()


def judged(spark, doc_type, entities=(), relations=()):
    reply = json.dumps({"entities": list(entities), "relations": list(relations)})
    df = spark.createDataFrame([("c", doc_type, reply)], "chunk_id string, doc_type string, payload string")
    e = ex.entity_verdicts(df, SCHEMA, "chunk_id").orderBy("item").collect()
    r = ex.mark_duplicates(ex.relation_verdicts(df, SCHEMA, "chunk_id"), "chunk_id").orderBy("item").collect()
    return e, r


def test_schema_triples():
    assert len(SCHEMA.declared_triples()) == 14
    assert len(SCHEMA.extractable_triples()) == 19
    assert ("System", "IMPLEMENTS", "Obligation") in SCHEMA.declared_triples()
    assert not any((s, t) == ("System", "Obligation") for _, s, _, t in SCHEMA.extractable_triples())
    described = SCHEMA.describe()
    assert described["links"]["DEPENDS_ON"]["between"] == ["System to System"]
    assert set(described["labels"]) == set(SCHEMA.labels) and described["on_every_link"]


def test_entities(spark):
    rows, _ = judged(
        spark,
        "regulatory",
        [
            {"label": "Control", "name": " Multi_Factor-auth ", "standard": "S", "bogus": "x", "id": "ignored"},
            {"label": "CpsClause", "doc": "CPS 234", "number": 27},
            {"label": "CpsClause", "id": "CPS 234:28", "title": "Title"},
            {"label": "CpsClause", "id": "no clause"},
            {"label": "System", "name": "not for this class"},
            {"label": "Planet", "name": "x"},
            {"label": "Risk", "key": "By Key"},
            {"label": "Risk", "name": "", "key": "not used"},
            "text",
            {"label": "Obligation", "name": True, "regulator": {"a": 1}},
        ],
    )
    assert [r["reason"] for r in rows] == [
        "kept", "kept", "kept", "no usable key", "label not allowed", "unknown label", "kept", "no usable key",
        "not an object", "kept",
    ]
    assert rows[0]["key"] == "multi factor auth" and rows[0]["name"] == "Multi_Factor-auth"
    assert rows[0]["standard"] == "S" and rows[0]["id"] is None
    assert (rows[1]["key"], rows[1]["doc"], rows[1]["number"]) == ("CPS 234:27", "CPS 234", "27")
    assert (rows[2]["doc"], rows[2]["number"], rows[2]["title"]) == ("CPS 234", "28", "Title")
    assert rows[6]["key"] == "by key"
    assert rows[9]["name"] == "True" and rows[9]["regulator"] is None


def test_relations(spark):
    system = {"source_label": "System", "target_label": "System"}
    _, rows = judged(
        spark,
        "architecture",
        relations=[
            {"type": "depends_on", "source": "A_b", "target": "C", **system},
            {"relationship_type": "DEPENDS_ON", "source_type": "System", "source_name": "a B", "target_type": "System", "target_key": "c"},
            {"type": "HATES", **system},
            {"type": "PART_OF", **system},
            {"type": "DEPENDS_ON", "source_label": "System", "source": "a", "target_label": "Risk", "target": "r"},
            {"type": "IMPLEMENTS", "source_label": "Control", "source": "c", "target_label": "Obligation", "target": "o"},
            {"type": "DEPENDS_ON", "source": " ", "target": "b", **system},
            {"type": "GOVERNED_BY", "source_label": "Risk", "source": "r", "target_label": "CpsClause", "target": "see CPS 234 clause 27"},
            {"type": "GOVERNED_BY", "source_label": "Risk", "source": "r", "target_label": "CpsClause", "target": "27"},
            4,
        ],
    )
    assert [r["reason"] for r in rows] == [
        "kept", "duplicate", "unknown type", "type not allowed", "endpoints not declared",
        "endpoint label not allowed", "missing endpoint", "kept", "missing endpoint", "not an object",
    ]
    assert (rows[0]["source_key"], rows[0]["target_key"]) == ("a b", "c")
    assert rows[7]["target_key"] == "CPS 234:27"


@pytest.mark.parametrize(
    "raw, key",
    [
        ("CPS 234:27", "CPS 234:27"),
        ("CPS 234", "CPS 234:234"),
        ("CPS234 clause 27", "CPS234:27"),
        ("CPS   230 clause 18 ", "CPS 230:18"),
        ("clause 27", None),
        ("  ", None),
    ],
)
def test_clause_endpoints(spark, raw, key):
    assert spark.range(1).select(tx.endpoint_key(F.lit("CpsClause"), F.lit(raw)).alias("k")).first()["k"] == key


@pytest.mark.parametrize(
    "reply, counts",
    [
        ('{"entities": [1], "relations": []}', (1, 0)),
        ('```json\n{"entities": [1, 2]}\n```', (2, 0)),
        ('Sure: {"relations": [{}]} bye', (0, 1)),
        ("{}", (0, 0)),
        ("[1]", None),
        ("not json", None),
        ('{"entities": 3}', (None, 0)),
        ("", None),
    ],
)
def test_tolerant_parse(spark, reply, counts):
    row = (
        spark.createDataFrame([(reply,)], "r string")
        .withColumn("o", pl.parse_object(F.col("r")))
        .select("o", pl.items(F.col("o"), "entities").alias("e"), pl.items(F.col("o"), "relations").alias("l"))
        .first()
    )
    if counts is None:
        assert row["o"] is None
    else:
        assert tuple(None if x is None else len(x) for x in (row["e"], row["l"])) == counts


def test_first_mention_wins_per_property(spark):
    reply = {"entities": [{"label": "Control", "name": "MFA"}, {"label": "Control", "name": "mfa", "standard": "S"}, {"label": "Control", "name": "M-F-A"}]}
    df = spark.createDataFrame([("c", "security", json.dumps(reply))], "chunk_id string, doc_type string, payload string")
    rows = {r["key"]: r for r in ex.merge_mentions(ex.entity_verdicts(df, SCHEMA, "chunk_id"), SCHEMA, "chunk_id").collect()}
    assert (rows["mfa"]["name"], rows["mfa"]["standard"]) == ("MFA", "S")
    assert set(rows) == {"mfa", "m f a"}


def test_model_retries_with_a_doubled_budget():
    model = ScriptedModel([Reply("", "length"), "no json here", '{"entities": []}'])
    assert ex.call_model(model, "p", EngineConfig()) == ('{"entities": []}', "")
    assert model.budgets == [8192, 16384, 32768]
    assert ex.RETRY_NOTE not in model.prompts[0] and ex.RETRY_NOTE in model.prompts[1]
    model = ScriptedModel([RuntimeError("down"), "x", Reply("", "length")])
    payload, error = ex.call_model(model, "p", EngineConfig())
    assert payload == "" and "3 attempts" in error


def test_failed_and_blank_chunks_are_rows(spark):
    chunks = spark.createDataFrame(
        [("1", "code", "t", "p", "s", "", "words"), ("2", "code", "t", "p", "s", "", "  ")],
        "chunk_id string, doc_type string, title string, source_path string, section string, clause string, text string",
    )
    out = {r["chunk_id"]: r for r in ex.extract_payloads(chunks, lambda: ScriptedModel(["a", "b", "c"] * 2), SCHEMA).collect()}
    assert out["1"]["error"].startswith("extraction failed") and out["2"]["error"] == ""


def test_prompt_is_filled_per_row(spark):
    row = spark.createDataFrame(
        [("security", "T {x}", "data/p.md", "S", None, "w" * 5000)],
        "doc_type string, title string, source_path string, section string, clause string, text string",
    )
    prompt = row.select(ex.extraction_prompt(SCHEMA, EngineConfig()).alias("p")).first()["p"]
    sent = json.loads(prompt)
    assert sent["piece"] == {"title": "T {x}", "source_path": "data/p.md", "section": "S", "clause": "", "text": "w" * 5000}
    assert list(sent["class"]["labels"]) == ["Control", "Risk", "Obligation", "CpsClause"]
    assert set(sent["instructions"]["reply"]) == {"entities", "relations"}


def test_accepted_replies_are_strict_json(spark):
    raw = 'So: {"entities": [{"label": "Control", "name": "a", "name": "MFA", "n": NaN}], "entities": [{"label": "Control", "name": "b", "name": "MFA"}]}'
    payload, error = ex.call_model(ScriptedModel([raw]), "p", EngineConfig())
    assert error == "" and json.loads(payload) == {"entities": [{"label": "Control", "name": "MFA"}]}
    payload, _ = ex.call_model(ScriptedModel(['{"entities": [{"label": "Control", "name": "x", "standard": NaN}]}']), "p", EngineConfig())
    df = spark.createDataFrame([("c", "security", payload)], "chunk_id string, doc_type string, payload string")
    assert [r["key"] for r in ex.merge_mentions(ex.entity_verdicts(df, SCHEMA, "chunk_id"), SCHEMA, "chunk_id").collect()] == ["x"]


def test_relation_steps_are_short_enough_to_be_compiled(spark, capsys):
    replies = spark.createDataFrame([(1, "architecture", "{}")], "n long, doc_type string, payload string")
    ex.relation_verdicts(replies, GraphSchema.load(), "n").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM compiles no longer method


def test_items_are_read_like_their_fields_one_by_one(spark):
    texts = [
        '{"a": [{"x": "t", "y": 1}, 7, "loose", null, {"x": null}, {"z": 0}]}',
        '{"a": [{"x": true, "y": "true"}, {"x": [1], "y": "[1]"}, {"x": {"b": 1}, "y": "{"}, [], {"x": 1.5}]}',
        '{"a": 3}', '{"a": null}', "{}", "prose", None, " ```json\n{\"a\": [{\"x\": \"}\"}]}\n``` ", "} {", '```\n{"a"```',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, payload string")
    parsed = pl.parse_object(F.col("payload"))
    at_once = rows.select("n", F.posexplode(pl.read_items(parsed, "a", ["x", "y"])).alias("i", "r")).select("n", "i", "r.x", "r.y", F.col("r").isNotNull())
    single = rows.select("n", F.posexplode(pl.items(parsed, "a")).alias("i", "v")).withColumn("t", pl.texts(F.col("v"), ["x", "y"]))
    single = single.select("n", "i", *[pl.scalar(F.col("v"), F.col("t"), c).alias(c) for c in ("x", "y")], pl.is_object(F.col("v")))
    found = sorted(map(tuple, at_once.collect()), key=str)
    assert len(found) == 12 and found == sorted(map(tuple, single.collect()), key=str)
