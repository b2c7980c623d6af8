"""Registered queries of reply parsing and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.catalog.corpora import table
from docweave.catalog.registry import query
from docweave.functions import payload as pl
from docweave.operators import extraction as ex
from docweave.plans.graph_schema import GraphSchema

SCHEMA = GraphSchema.load()

# One model reply per event. {u}: user, {k}: the event's property, {label}: by user.
BODY = (
    '{"entities": [{"label": "{label}", "name": " User_{u}", "path": "p{k}", "regulator": "R{k}"}, '
    '{"label": "{label}", "name": "user-{u} ", "path": "later", "bogus": "x"}, '
    '{"label": "CpsClause", "doc": "CPS {k}", "number": {u}, "title": "T{k}"}, '
    '{"label": "CpsClause", "id": "bad id", "doc": "CPS {k}"}, '
    '{"label": "Control", "key": "MFA {k}", "standard": "S{u}"}, '
    '{"label": "Risk", "name": "  "}, "loose", {u}, {"label": "Gadget", "name": "g"}], '
    '"relations": [{"type": "depends_on", "source_label": "System", "source": "User_{u}", "target_label": "System", "target": "Hub {k}"}, '
    '{"relationship_type": "DEPENDS_ON", "source_type": "System", "source_name": "user {u}", "target_type": "System", "target_key": "hub-{k}"}, '
    '{"type": "MITIGATES", "source_label": "Control", "source": "MFA {k}", "target_label": "Risk", "target": "Risk_{u}"}, '
    '{"type": "GOVERNED_BY", "source_label": "Risk", "source": "Risk {u}", "target_label": "CpsClause", "target": "see CPS 1{k} clause {u}"}, '
    '{"type": "GOVERNED_BY", "source_label": "Obligation", "source": "ob {u}", "target_label": "CpsClause", "target": "none"}, '
    '{"type": "PART_OF", "source_label": "CodeComponent", "source": "c{u}", "target_label": "Risk", "target": "r"}, '
    '{"type": "IMPLEMENTS", "source_label": "System", "source": "s{u}", "target_label": "Obligation", "target": "o{k}"}, '
    '{"type": "LIKES"}, 7]}'
)
LABELS = ("System", "Risk", "Pattern", "CodeComponent", "Obligation")
CLASSES = ("architecture", "regulatory", "security", "code")


def _replies(spark, sf_dir):
    """Replies as a model gives them: plain, fenced, wrapped in prose, cut off, or with a wrong list."""
    events = table(spark, sf_dir, "events")
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("user_id") % len(LABELS)).cast("int"))
    body = F.lit(BODY)
    for mark, value in (("{u}", user), ("{k}", k), ("{label}", label)):
        body = F.replace(body, F.lit(mark), value)
    kind = F.col("event_type")
    payload = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == "signup", F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .when(kind == "error", F.substring(body, 1, 300))
        .when(kind == "purchase", F.replace(body, F.lit('"relations": ['), F.lit('"relations": 3, "rest": [')))
        .otherwise(body)
    )
    return events.select(
        "event_id",
        F.get(F.array(*map(F.lit, CLASSES)), (F.col("user_id") % 4).cast("int")).alias("doc_type"),
        payload.alias("payload"),
    )


_BODY_SQL = BODY.replace("'", "''")
REPLIES_SQL = f"""
bodies AS (SELECT event_id, event_type, user_id,
    replace(replace(replace('{_BODY_SQL}', '{{u}}', CAST(user_id AS VARCHAR)), '{{k}}', json_extract_string(props, '$.k')),
            '{{label}}', ['System', 'Risk', 'Pattern', 'CodeComponent', 'Obligation'][user_id % 5 + 1]) AS body FROM events),
replies AS (SELECT event_id, ['architecture', 'regulatory', 'security', 'code'][user_id % 4 + 1] AS doc_type,
    CASE event_type WHEN 'click' THEN '```json' || chr(10) || body || chr(10) || '```'
                    WHEN 'signup' THEN 'Here it is: ' || body || ' Done.'
                    WHEN 'error' THEN substring(body, 1, 300)
                    WHEN 'purchase' THEN replace(body, '"relations": [', '"relations": 3, "rest": [')
                    ELSE body END AS payload FROM bodies),
objects AS (SELECT *, CASE WHEN json_valid(regexp_extract(payload, '(?s)(\\{{.*\\}})', 1))
                           THEN CAST(regexp_extract(payload, '(?s)(\\{{.*\\}})', 1) AS JSON) END AS obj FROM replies)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


SCHEMA_SQL = f"""
labels(label, prop) AS (VALUES {_values([(n, p) for n, s in SCHEMA.labels.items() for p in s["properties"]])}),
class_labels(doc_type, label) AS (VALUES {_values([(c, x) for c, s in SCHEMA.classes.items() for x in s["allowed_labels"]])}),
class_types(doc_type, rel_type) AS (VALUES {_values([(c, x) for c, s in SCHEMA.classes.items() for x in s["allowed_relationships"]])}),
triples(s_label, rel_type, t_label) AS (VALUES {_values(SCHEMA.declared_triples())})"""

NORM = "trim(regexp_replace(lower({0}), '[-_\\s]+', ' ', 'g'))"
ENTITIES_SQL = f"""{REPLIES_SQL},{SCHEMA_SQL},
items AS (SELECT event_id, doc_type, unnest(json_extract(obj, '$.entities[*]')) AS e,
            generate_subscripts(json_extract(obj, '$.entities[*]'), 1) - 1 AS item FROM objects WHERE obj IS NOT NULL),
fields AS (SELECT *, json_type(e) = 'OBJECT' AS is_object, coalesce(json_extract_string(e, '$.label'), '') AS label,
             trim(coalesce(json_extract_string(e, '$.name'), json_extract_string(e, '$.key'), '')) AS name,
             CASE WHEN json_extract_string(e, '$.id') IS NOT NULL THEN json_extract_string(e, '$.id')
                  ELSE json_extract_string(e, '$.doc') || ':' || json_extract_string(e, '$.number') END AS cid FROM items),
keyed AS (SELECT *, CASE WHEN label = 'CpsClause' THEN CASE WHEN regexp_full_match(cid, '[^:]+:\\d+') THEN cid END
                         ELSE nullif({NORM.format('name')}, '') END AS key FROM fields),
entities AS (SELECT *, CASE WHEN NOT is_object THEN 'not an object'
    WHEN label NOT IN (SELECT label FROM labels) THEN 'unknown label'
    WHEN (doc_type, label) NOT IN (SELECT doc_type, label FROM class_labels) THEN 'label not allowed'
    WHEN key IS NULL THEN 'no usable key' ELSE 'kept' END AS reason FROM keyed)"""


@query(
    f"""WITH {ENTITIES_SQL} SELECT doc_type, CASE WHEN is_object THEN label ELSE '' END AS label, reason,
          CAST(count(*) AS BIGINT) AS n FROM entities GROUP BY ALL"""
)
def entity_reasons(spark, sf_dir):
    judged = ex.entity_verdicts(_replies(spark, sf_dir), SCHEMA, "doc_type")
    return judged.groupBy("doc_type", "label", "reason").agg(F.count("*").alias("n"))


def _prop_sql(name: str) -> str:
    value = {
        "name": "name",
        "id": "CASE WHEN label = 'CpsClause' THEN cid END",
    }.get(name, f"json_extract_string(e, '$.{name}')")
    return (
        f"arg_min(nullif({value}, ''), item) FILTER (WHERE nullif({value}, '') IS NOT NULL "
        f"AND (label, '{name}') IN (SELECT label, prop FROM labels)) AS {name}"
    )


@query(
    f"""WITH {ENTITIES_SQL} SELECT event_id, label, key, {', '.join(_prop_sql(p) for p in SCHEMA.properties)}
        FROM entities WHERE reason = 'kept' GROUP BY event_id, label, key"""
)
def first_mention_properties(spark, sf_dir):
    judged = ex.entity_verdicts(_replies(spark, sf_dir), SCHEMA, "event_id")
    return ex.merge_mentions(judged, SCHEMA, "event_id")


def _endpoint_sql(side: str) -> str:
    label = f"{side}_label"
    raw = f"{side}_raw"
    return f"""CASE WHEN {label} = 'CpsClause' THEN
        CASE WHEN regexp_full_match({raw}, '[^:]+:\\d+') THEN {raw}
             WHEN regexp_matches({raw}, '^[^:]*?CPS\\s*\\d{{3}}') AND regexp_matches({raw}, '\\d\\s*$')
             THEN regexp_replace(regexp_extract({raw}, '^[^:]*?(CPS\\s*\\d{{3}})', 1), '\\s+', ' ', 'g') || ':'
                  || regexp_extract({raw}, '(\\d+)\\s*$', 1) END
      ELSE nullif({NORM.format(raw)}, '') END AS {side}_key"""


RELATIONS_SQL = f"""{REPLIES_SQL},{SCHEMA_SQL},
items AS (SELECT event_id, doc_type, unnest(json_extract(obj, '$.relations[*]')) AS e,
            generate_subscripts(json_extract(obj, '$.relations[*]'), 1) - 1 AS item FROM objects
          WHERE obj IS NOT NULL AND json_type(obj, '$.relations') = 'ARRAY'),
fields AS (SELECT *, json_type(e) = 'OBJECT' AS is_object,
    upper(coalesce(json_extract_string(e, '$.type'), json_extract_string(e, '$.relationship_type'), '')) AS rel_type,
    coalesce(json_extract_string(e, '$.source_label'), json_extract_string(e, '$.source_type'), '') AS source_label,
    coalesce(json_extract_string(e, '$.target_label'), json_extract_string(e, '$.target_type'), '') AS target_label,
    coalesce(json_extract_string(e, '$.source'), json_extract_string(e, '$.source_key'), json_extract_string(e, '$.source_name'), '') AS source_raw,
    coalesce(json_extract_string(e, '$.target'), json_extract_string(e, '$.target_key'), json_extract_string(e, '$.target_name'), '') AS target_raw
  FROM items),
keyed AS (SELECT *, {_endpoint_sql('source')}, {_endpoint_sql('target')} FROM fields),
judged AS (SELECT *, CASE WHEN NOT is_object THEN 'not an object'
    WHEN rel_type NOT IN (SELECT rel_type FROM triples) THEN 'unknown type'
    WHEN (doc_type, rel_type) NOT IN (SELECT doc_type, rel_type FROM class_types) THEN 'type not allowed'
    WHEN (source_label, rel_type, target_label) NOT IN (SELECT s_label, rel_type, t_label FROM triples) THEN 'endpoints not declared'
    WHEN (doc_type, source_label) NOT IN (SELECT doc_type, label FROM class_labels)
      OR (doc_type, target_label) NOT IN (SELECT doc_type, label FROM class_labels) THEN 'endpoint label not allowed'
    WHEN source_key IS NULL OR target_key IS NULL THEN 'missing endpoint' ELSE 'kept' END AS verdict FROM keyed),
relations AS (SELECT *, CASE WHEN verdict = 'kept' AND row_number() OVER (
      PARTITION BY event_id, verdict, rel_type, source_label, source_key, target_label, target_key ORDER BY item) > 1
    THEN 'duplicate' ELSE verdict END AS reason FROM judged)"""


@query(
    f"""WITH {RELATIONS_SQL} SELECT doc_type, rel_type, reason, CAST(count(*) AS BIGINT) AS n FROM relations GROUP BY ALL"""
)
def relation_reasons(spark, sf_dir):
    judged = ex.mark_duplicates(ex.relation_verdicts(_replies(spark, sf_dir), SCHEMA, "event_id", "doc_type"), "event_id")
    return judged.groupBy("doc_type", "rel_type", "reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {RELATIONS_SQL} SELECT event_id, rel_type, source_label, source_key, target_label, target_key
        FROM relations WHERE reason = 'kept'"""
)
def kept_relations(spark, sf_dir):
    judged = ex.relation_verdicts(_replies(spark, sf_dir), SCHEMA, "event_id")
    return ex.kept_relations(judged, "event_id").select("event_id", *ex.EDGE)


@query(
    f"""WITH {REPLIES_SQL} SELECT event_id, obj IS NOT NULL AS readable,
          CAST(CASE WHEN obj IS NULL THEN NULL ELSE json_array_length(obj, '$.entities') END AS BIGINT) AS entities,
          CAST(CASE WHEN json_type(obj, '$.relations') = 'ARRAY' THEN json_array_length(obj, '$.relations') END AS BIGINT) AS relations
        FROM objects"""
)
def parsed_replies(spark, sf_dir):
    parsed = _replies(spark, sf_dir).withColumn("object", pl.parse_object(F.col("payload")))
    count = lambda name: F.when(F.col("object").isNotNull(), F.size(pl.items(F.col("object"), name)))
    known = lambda c: F.when(c >= 0, c.cast("long"))
    return parsed.select(
        "event_id",
        F.col("object").isNotNull().alias("readable"),
        known(count("entities")).alias("entities"),
        known(count("relations")).alias("relations"),
    )
