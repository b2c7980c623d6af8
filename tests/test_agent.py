import json

import pytest
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators.embedding import HashingEmbedder
from docweave.plans import agent as ag
from docweave.plans import nlquery
from docweave.plans.evaluation import evaluate, write_results
from docweave.plans.graph_schema import GraphSchema
from docweave.plans.llm import ChatCompletionsModel, Reply, ScriptedModel, complete
from docweave.plans.patterns import Graph
from docweave.plans.question_runs import QuestionRuns, by_mode
from docweave.sources.jsonl import read_golden, read_traces, trace_final, trace_finals
from docweave.streaming import events as ev

SCHEMA = GraphSchema.load()
QUERY = "SELECT rel_type, source_chunk FROM edges WHERE source_key = 'pay hub'"


@pytest.fixture(scope="module")
def world(spark):
    embedder = HashingEmbedder(16)
    texts = {"c1": "clause about backup", "c2": "pay hub depends on core", "c3": "the saga pattern"}
    chunks = spark.createDataFrame(
        [(i, f"d{i[1]}", t, f"S{i[1]}", "", "", embedder.embed_query(t)) for i, t in texts.items()],
        "id string, doc_id string, text string, section string, clause string, code_ref string, embedding array<float>",
    ).cache()
    documents = spark.createDataFrame(
        [(f"d{n}", f"Title {n}", "architecture", f"data/{n}.md") for n in "123"],
        "doc_id string, title string, doc_type string, source_path string",
    ).cache()
    entities = spark.createDataFrame([("System", "pay hub", "Pay Hub"), ("System", "core", "Core")], "label string, key string, name string")
    edges = spark.createDataFrame(
        [("DEPENDS_ON", "System", "pay hub", "System", "core", "c2", "d2")],
        "rel_type string, source_label string, source_key string, target_label string, target_key string, source_chunk string, source_document string",
    )
    return chunks, documents, Graph(entities, edges), embedder


def make(spark, world, replies, tokens=("An ", "answer."), **config):
    chunks, documents, graph, embedder = world
    model = ScriptedModel(list(replies), list(tokens))
    settings = EngineConfig(embedding_dim=16, top_k=2, **config)
    return ag.Agent(spark, chunks, documents, graph, SCHEMA, model, embedder.embed_query, settings), model


def steps(events):
    return [e["step"] if e["type"] == "step" else e["type"] for e in events]


def test_relationship_question(spark, world, tmp_path):
    agent, model = make(spark, world, ["Relationship: asks for links", '"pay hub core"', QUERY, "sufficient"], trace_dir=str(tmp_path))
    events = list(agent.ask("How does the pay hub reach core?"))
    assert steps(events) == ["route", "rewrite", "retrieve", "traverse", "sufficiency", "token", "token", "synthesize", "done"]
    assert events[0]["detail"] == {"route": "relationship", "rationale": "asks for links"}
    assert events[1]["detail"] == {"rewritten": "pay hub core"}
    found = events[2]["detail"]
    assert found["chunks"] == 2 and found["chunk_ids"][0] == "c2" and len(found["scores"]) == 2 and found["iteration"] == 1
    assert events[-1]["answer"] == "An answer." and "c2" == found["chunk_ids"][0]
    assert [c["doc_id"] for c in events[-1]["citations"]][0] == "d2"
    assert "pay hub core" in model.prompts[2] and "graph:traversal" in model.prompts[3].replace("\\u003a", ":")
    traces = read_traces(spark, str(tmp_path))
    assert trace_final(traces, events[-1]["trace_id"])["iterations"] == 1
    assert trace_final(traces, "absent") == {} and trace_finals(traces).count() == 1
    assert traces.where("event = 'run_start'").first()["question"].startswith("How does")


def test_lookup_loops_once(spark, world):
    agent, model = make(spark, world, ["lookup fact", "clause 15", "insufficient: need clause 15", "Sufficient!"])
    events = list(agent.ask("What does clause 15 say?", "VECTOR"))
    assert steps(events)[:6] == ["route", "rewrite", "retrieve", "sufficiency", "retrieve", "sufficiency"]
    assert events[3]["detail"]["note"] == "insufficient: need clause 15"
    assert json.loads(model.prompts[-1])["notes"] == ["insufficient: need clause 15"]


def test_iteration_cap_and_failed_traversal(spark, world):
    bad = ["DROP TABLE x", "", "SELECT nothing FROM nodes"]
    agent, model = make(spark, world, ["compliance-mapping x", ""] + bad + ["insufficient: a"] + bad + ["insufficient: b"] + bad)
    events = list(agent.ask("Which clause?"))
    assert steps(events).count("retrieve") == 3 and events[-1]["type"] == "done"
    last = [e for e in events if e.get("step") == "sufficiency"][-1]
    assert last["detail"] == {"sufficient": False, "capped": True, "iterations": 3, "note": "hard cap of 3 iterations reached"}
    assert "No graph query ran in 3 attempts" in model.prompts[-1]
    assert json.loads(model.prompts[4])["failures"][1] == {"statement": "", "error": nlquery.NO_STATEMENT}


def test_errors_are_events(spark, world, tmp_path):
    agent, _ = make(spark, world, ["lookup", RuntimeError("no such model"), "lookup"], trace_dir=str(tmp_path))
    assert list(agent.ask("q"))[1:] == [{"type": "error", "message": "no such model"}]
    left = agent.ask("left")
    next(left)
    left.close()
    traces = read_traces(spark, str(tmp_path))
    ends = {r["message"]: r["trace_id"] for r in traces.where("event = 'error'").collect()}
    assert set(ends) == {"no such model", "left by its reader"}
    for trace_id in ends.values():  # the steps before the end are there too
        assert [r["step"] for r in traces.where((F.col("trace_id") == trace_id) & (F.col("event") == "step")).collect()] == ["route"]
    assert list(agent.ask("  "))[0]["message"] == "empty message"
    assert "unknown retrieval mode" in list(agent.ask("q", "both"))[0]["message"]


def test_references_and_pages(spark):
    rows = spark.createDataFrame(
        [("c1", ("c2",), "c9"), ("c2", ("",), "c9"), (None, None, "c9")], "source_chunk string, a struct<source_chunk:string>, source_chunk_2 string"
    )
    assert nlquery.chunk_references(rows) == ["c1", "c2"]
    many = spark.range(60).select("id", F.lit("y" * 2000).alias("t")).orderBy("id")
    pages = [[r["id"] for r in nlquery.page(many, 25, n).collect()] for n in range(4)]
    assert [len(p) for p in pages] == [25, 25, 10, 0] and sum(pages, []) == list(range(60))
    text = nlquery.page_text(many, EngineConfig()).split("\n")
    assert len(text) == 26 and len(json.loads(text[0])["t"]) == 2000 and text[25].startswith("(more rows")
    assert nlquery.page_text(many.limit(0), EngineConfig()) == "(no rows)"


def test_repeated_columns_are_numbered(spark, world):
    views = world[2].register_views()
    rows = nlquery.run_statement(spark, "SELECT key AS k, name AS k FROM nodes ORDER BY 1", views)
    assert rows.first().asDict() == {"k": "core", "k_2": "Core"}


def test_prompt_holds_schema_and_failures():
    prompt = json.loads(nlquery.build_prompt("q?", SCHEMA, ["nodes", "edges"], [{"statement": "SELECT x", "error": "no column x"}]))
    assert prompt["question"] == "q?" and prompt["failures"][0]["error"] == "no column x"
    assert "Pattern to Risk" in prompt["schema"]["links"]["MITIGATES"]["between"]


def test_completion_and_events(caplog):
    assert complete(ScriptedModel([Reply(" cut ", "length")]), "some prompt", "test") == "cut"
    assert "limit of 4096 tokens" in caplog.text
    with pytest.raises(ValueError):
        ChatCompletionsModel()
    sent = [{"type": "token", "text": "é"}, {"type": "done", "answer": "x"}, {"type": "token", "text": "late"}]
    lines = [": comment", "data: {broken"] + [ev.encode(e).strip() for e in sent]
    assert list(ev.decode(lines)) == sent[:2]


def table_runs(spark, world, rules, **config):
    """Runs whose model answers by rules: (task, word in the prompt) to a reply, an exception or a list of replies by failures."""
    chunks, documents, graph, embedder = world

    class RuleModel:
        def chat(self, messages, temperature=0.0, max_tokens=0):
            body = json.loads(messages[0])
            task = "graph" if "tables" in body else body["task"].split(" ")[0]
            for (wanted, word), reply in rules.items():
                if wanted == task and word in messages[0]:
                    reply = reply[min(len(body.get("failures", [])), len(reply) - 1)] if isinstance(reply, list) else reply
                    if isinstance(reply, Exception):
                        raise reply
                    return Reply(reply)
            default = {"Choose": "lookup it is", "Word": body["question"], "Decide": "sufficient", "Answer": "An answer to " + body["question"]}
            return Reply(default.get(task, ""))

    settings = EngineConfig(embedding_dim=16, top_k=2, **config)
    return QuestionRuns(spark, chunks, documents, graph, SCHEMA, RuleModel, lambda: HashingEmbedder(16), settings)


def test_a_table_of_questions(spark, world):
    rules = {
        ("Choose", "core"): "Relationship: asks for links", ("Choose", "Which"): "compliance-mapping x", ("Choose", "fails"): RuntimeError("no such model"),
        ("graph", "core"): QUERY, ("graph", "Which"): ["DROP TABLE x", "", "SELECT nothing FROM nodes"],
        ("Word", "core"): '"pay hub core"', ("Word", "blank"): "", ("Decide", "Which"): "insufficient: a", ("Decide", "lost"): RuntimeError("judge gone"),
    }
    questions = [("q1", "How does the pay hub reach core?"), ("q2", "Which clause?"), ("q3", " "), ("q4", None), ("q5", "this fails"), ("q6", "blank backup"), ("q7", "lost")]
    found = table_runs(spark, world, rules).answer(spark.createDataFrame(questions, "id string, question string"))
    rows = {(r["id"], r["mode"]): r for r in found.runs.collect()}
    assert len(rows) == 14 == found.runs.count()
    assert {k: (r["route"], r["iterations"], r["error"]) for k, r in rows.items() if k[1] == "hybrid"} == {
        ("q1", "hybrid"): ("relationship", 1, None), ("q2", "hybrid"): ("compliance-mapping", 3, None), ("q3", "hybrid"): (None, 0, "empty message"),
        ("q4", "hybrid"): (None, 0, "empty message"), ("q5", "hybrid"): (None, 0, "no such model"), ("q6", "hybrid"): ("lookup", 1, None),
        ("q7", "hybrid"): ("lookup", 1, "judge gone"),
    }
    assert [c["doc_id"] for c in rows["q1", "hybrid"]["citations"]][0] == "d2" and len(rows["q1", "hybrid"]["citations"]) == 2
    steps = {}
    for r in found.steps.collect():
        steps.setdefault((r["id"], r["mode"]), []).append((r["turn"], r["step"], json.loads(r["detail"])))
    names = lambda key: [s for _, s, _ in sorted(steps[key], key=lambda x: x[0])]
    assert names(("q1", "vector")) == ["route", "rewrite", "retrieve", "sufficiency", "synthesize"]
    assert names(("q2", "hybrid")).count("traverse") == 3 and names(("q2", "vector")).count("traverse") == 0
    detail = {(s, t): d for t, s, d in steps["q1", "hybrid"]}
    assert detail["route", 0] == {"route": "relationship", "rationale": "asks for links"} and detail["rewrite", 0] == {"rewritten": "pay hub core"}
    assert detail["traverse", 1] == {"statement": QUERY} and detail["retrieve", 1]["chunk_ids"][0] == "c2"
    last = {(s, t): d for t, s, d in steps["q2", "hybrid"]}["sufficiency", 3]
    assert last == {"sufficient": False, "capped": True, "note": "hard cap of 3 iterations reached", "iterations": 3}


def test_one_question_runs_alike_alone_and_in_a_table(spark, world):
    agent, _ = make(spark, world, ["Relationship: asks for links", '"pay hub core"', QUERY, "sufficient"], ["An answer to How does the pay hub reach core?"])
    alone = list(agent.ask("How does the pay hub reach core?"))
    rules = {("Choose", "core"): "Relationship: asks for links", ("Word", "core"): '"pay hub core"', ("graph", "core"): QUERY}
    (row,) = table_runs(spark, world, rules).answer(spark.createDataFrame([(1, "How does the pay hub reach core?")], "id int, question string"), ["hybrid"]).runs.collect()
    assert row["answer"] == alone[-1]["answer"] and [c.asDict() for c in row["citations"]] == alone[-1]["citations"]


def test_golden_evaluation(spark, world, tmp_path):
    golden_file = tmp_path / "golden.jsonl"
    question = {
        "id": "g1", "question": "pay hub?", "intent": "lookup", "notes": "",
        "expected_citations": [{"doc_title_contains": "TITLE 2"}, {"doc_title_contains": "Title 9", "clause": "1"}],
        "expected_graph_paths": [["PayHub", "DEPENDS_ON", "core"], ["nothing"]],
    }
    golden_file.write_text(json.dumps(question) + "\n\n")
    golden = read_golden(spark, str(golden_file))
    assert golden.count() == 1
    runs = table_runs(spark, world, {}).answer(golden.select("id", "question")).runs
    nodes = world[2].entities.select("name")
    edges = spark.createDataFrame([("Pay Hub", "DEPENDS_ON", "Core")], "source string, type string, target string")
    scored = evaluate(runs, golden, nodes, edges)
    rows = {r["mode"]: r for r in scored.collect()}
    assert set(rows) == {"hybrid", "vector"}
    for r in rows.values():
        assert (r["hits"], r["expected"], r["paths_ok"], r["paths_full"], r["paths_total"]) == (1, 2, 1, 1, 2)
        assert r["route"] == "lookup" and r["answer"] == "An answer to pay hub?"
    (pivoted,) = by_mode(scored, ["hits", "iterations"]).collect()
    assert pivoted["hybrid_hits"] == pivoted["vector_hits"] == pivoted["vector_iterations"] == 1
    write_results(scored, str(tmp_path / "out"))
    summary = spark.read.json(str(tmp_path / "out" / "summary"))
    assert "answer" not in summary.columns and summary.first()["answer_chars"] == 21
