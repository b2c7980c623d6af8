from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.functions import text as tx
from docweave.plans.tracing import RunLog
from docweave.session import shared_folder
from docweave.sources import corpus
from docweave.sources.jsonl import read_traces, trace_finals
from docweave.streaming.events import answers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def write(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_corpus_tree(spark, tmp_path):
    root = tmp_path / "data"
    write(root, "regulatory/rules.md", "# Rules\n\ntext")
    write(root, "security/rules.md", "## no title")
    write(root, "architecture/deep/er/Plan.TXT", b"#\n # Plan \xff\n")
    write(root, "architecture/a-b.md", "x")
    write(root, "architecture/a/b.md", "y")
    write(root, "code/tool.py", "# first comment\nx = 1\n")
    for skipped in ("README.md", "regulatory/README.md", "code/.hidden.md", "code/data.csv", "other/file.md"):
        write(root, skipped, "skip")
    docs = corpus.load_documents(spark, str(root)).orderBy("class_order", "parts").collect()
    assert [d["source_path"] for d in docs] == [
        "data/regulatory/rules.md", "data/security/rules.md", "data/architecture/a/b.md", "data/architecture/a-b.md",
        "data/architecture/deep/er/Plan.TXT", "data/code/tool.py",
    ]
    assert docs[0]["doc_id"] == "rules" and docs[1]["doc_id"].startswith("rules-") and len(docs[1]["doc_id"]) == 14
    assert [d["title"] for d in docs] == ["Rules", "rules", "b", "a-b", "Plan �", "first comment"]
    assert docs[4]["doc_type"] == "architecture"


def test_names_the_reader_would_skip(spark, tmp_path):
    root = tmp_path / "data"
    write(root, "code/pkg/__init__.py", "import os\n")
    write(root, "code/_private/x.py", "y = 1\n")
    write(root, "code/.dir/z.py", "z = 1\n")
    write(root, "code/.gone.py", "")
    write(root, "code/seen.py", "w = 1\n")
    docs = corpus.load_documents(spark, str(root)).orderBy("class_order", "parts").collect()
    assert [(d["source_path"], d["text"]) for d in docs] == [
        ("data/code/.dir/z.py", "z = 1\n"), ("data/code/_private/x.py", "y = 1\n"),
        ("data/code/pkg/__init__.py", "import os\n"), ("data/code/seen.py", "w = 1\n"),
    ]


def test_missing_root_and_pdf(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.load_documents(spark, str(tmp_path / "none"))
    write(tmp_path, "data/security/scan.PDF", b"%PDF")
    with pytest.raises(Exception, match="no PDF converter"):
        corpus.load_documents(spark, str(tmp_path / "data")).collect()
    read = corpus.load_documents(spark, str(tmp_path / "data"), lambda content: "# From " + content.decode())
    assert read.first()["title"] == "From %PDF"


@pytest.mark.parametrize(
    "text, title",
    [("intro\n# First\n# Second", "First"), ("## Two\n### Three", "stem"), ("#\n#  \n#Late", "Late"), ("none", "stem"), ("  # In  ", "In")],
)
def test_titles(spark, text, title):
    assert value(spark, tx.markdown_title(F.lit(text), F.lit("stem"))) == title


@pytest.mark.parametrize(
    "path, resolved",
    [("data/a/b.md", "a/b.md"), ("../x", None), ("a/../../x", None), ("a/../b", "b"), ("/etc/passwd", None), ("/app/data/x", "x"), ("../data/x", "x")],
)
def test_path_guard(spark, path, resolved):
    assert value(spark, corpus.resolve_source(F.lit(path), "/app/data")) == resolved


@pytest.mark.parametrize(
    "raw, key",
    [(" Payment-Order__Platform ", "payment order platform"), ("A  b\tc", "a b c"), ("--", ""), ("ÉCOLE", "école")],
)
def test_normalized_names(spark, raw, key):
    assert value(spark, tx.normalize_name(F.lit(raw))) == key


def test_text_functions(spark):
    assert value(spark, tx.alnum_name(F.lit(None).cast("string"))) == ""
    assert value(spark, tx.sanitize_query(F.lit('a+b (c) "d_é" AND ~'))) == "a b c d_é AND"
    assert value(spark, tx.first_token(F.lit("  "), "none")) == "none"
    assert value(spark, tx.route(F.lit("Compliance-Mapping: maps"))) == "compliance-mapping"
    assert value(spark, tx.route(F.lit("unclear"))) == "lookup"
    assert value(spark, tx.route_rationale(F.lit("lookup  a\nfact"))) == "a fact"
    assert value(spark, tx.citation_label(F.lit("T"), F.lit("27"), F.lit("r"), F.lit("s"))) == "T — ¶27"
    assert value(spark, tx.citation_label(F.lit("T"), F.lit(""), F.lit(""), F.lit(""))) == "T"
    assert value(spark, tx.strip_fences(F.lit("so:\n```cypher\nX\n```"))) == "X"


def test_a_long_stream_is_one_answer(spark):
    rows = spark.range(5000).select(F.lit("s").alias("run"), "id", (F.col("id") % 10).cast("string").alias("text"))
    (row,) = answers(rows, ["run"], "id").collect()
    assert row["answer"] == "".join(str(i % 10) for i in range(5000)) and row["tokens"] == row["chars"] == 5000


def test_short_forms_need_a_limit(spark):
    long = "word " * 200
    whole, short = tx.summarize(F.lit(long)), tx.summarize(F.lit(long), 10)
    assert value(spark, whole) == long and value(spark, short) == "word word …"
    assert value(spark, tx.trim_message(F.lit("x" * 401), 400)) == "x" * 400 + " [truncated]"
    assert len(value(spark, tx.purpose_label(F.lit(long)))) == 999 and len(value(spark, tx.route_rationale(F.lit(long)))) == 994


def test_the_root_may_repeat_below_itself(spark):
    files = spark.createDataFrame([("file:/data/security/data/a.md",), ("/data/code/b.py",)], "path string")
    assert {(r["source_path"], r["doc_type"]) for r in corpus.walk(files, "/data").collect()} == {
        ("data/security/data/a.md", "security"), ("data/code/b.py", "code")
    }


def test_settings_from_the_environment():
    config = EngineConfig.from_env({"CHUNK_SIZE": "512", "INGEST_CONCURRENCY": "0", "CHUNK_OVERLAP": ""})
    assert (config.chunk_size, config.chunk_overlap, config.ingest_concurrency) == (512, 150, 1)


def test_runs_are_appended_to_one_table(spark, tmp_path):
    for question in ("one", "two"):
        log = RunLog(spark, str(tmp_path / "traces"), question, "hybrid")
        log.step("route", {"route": "lookup"})
        log.close([], 1)
    traces = read_traces(spark, str(tmp_path / "traces"))
    assert traces.count() == 6 and trace_finals(traces).count() == 2
    RunLog(spark, "", "unkept", "vector").close([], 0)


def test_shared_folder_follows_the_session(tmp_path):
    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: settings.get(name.replace(".", "_"), default)))

    assert shared_folder(session(spark_checkpoint_dir=str(tmp_path), spark_sql_warehouse_dir="w")) == str(tmp_path)
    assert shared_folder(session(spark_sql_warehouse_dir="w")) == "w"
