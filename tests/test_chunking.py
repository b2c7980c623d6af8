import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from docweave.config import EngineConfig
from docweave.operators import chunking as ck
from docweave.operators.sections import extract_section, lookup_sections

GUIDE = """# Ferry handbook

Read this first.

## Boarding

Queue at gate two.

### Vehicles

Engines off.

### Bicycles

Walk them on.

## Safety

Vests are under the seats.
"""
CODE_OF_PRACTICE = """Harbour code, second edition.

## Chapter One

### Clause 4

Lamps are lit at dusk.

### Clause 5

Bells are rung in fog.

#### Clause 5.1

Twice a minute.

## Clause 31

### clause 32

New rule.
"""
MODULE = """import math

class Buoy:
    depth = 3


def drift(hours):
    return hours * math.pi


DEFAULT = drift(2)


@cached
async def tide(day):
    return day
"""


def chunk(spark, doc_type, text, path="data/x.md", size=900, overlap=150):
    docs = spark.createDataFrame(
        [("d", doc_type, path, text)], "doc_id string, doc_type string, source_path string, text string"
    )
    config = EngineConfig(chunk_size=size, chunk_overlap=overlap)
    return ck.chunk_documents(docs, config).orderBy("chunk_index").collect()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_heading_paths_leave_out_the_title(spark):
    rows = chunk(spark, "architecture", GUIDE)
    assert [(r["section"], r["text"]) for r in rows] == [
        ("", "Read this first."),
        ("Boarding", "Queue at gate two."),
        ("Boarding > Vehicles", "Engines off."),
        ("Boarding > Bicycles", "Walk them on."),
        ("Safety", "Vests are under the seats."),
    ]
    assert rows[4]["id"] == hashlib.sha256(b"d:4").hexdigest()


def test_bare_heading_and_bare_title(spark):
    rows = chunk(spark, "architecture", "## Alone\n")
    assert [(r["section"], r["text"]) for r in rows] == [("Alone", "Alone")]
    rows = chunk(spark, "architecture", "# Only a title")
    assert [(r["section"], r["text"]) for r in rows] == [("", "# Only a title")]
    assert chunk(spark, "architecture", " \n\n ") == []


def test_a_text_without_pieces_is_kept_whole(spark):
    title = "# " + "".join(f"word{i} " for i in range(400)).strip()
    rows = chunk(spark, "architecture", title, overlap=0)
    assert len(rows) == -(-len(title) // 900) > 2
    assert "".join("".join(r["text"].split()) for r in rows) == "".join(title.split())


def test_fences_hide_headings(spark):
    for fence in ("```", "~~~"):
        rows = chunk(spark, "architecture", f"## Guide\n\n{fence}\n# not a heading\n{fence}\n\nmore\n")
        assert [r["section"] for r in rows] == ["Guide"]
        assert "# not a heading" in rows[0]["text"] and "more" in rows[0]["text"]


def test_line_breaks_of_other_systems(spark):
    rows = chunk(spark, "architecture", "## A\r\n\r\none\r\n\r\n## B\x85\x85two")
    assert [(r["section"], r["text"]) for r in rows] == [("A", "one"), ("B", "two")]


def test_grouping_with_overlap(spark):
    paragraphs = [f"para{i} " + "x" * 30 for i in range(6)]
    rows = chunk(spark, "architecture", "## G\n\n" + "\n\n".join(paragraphs), size=70, overlap=20)
    assert len(rows) == 6 and all(len(r["text"]) <= 70 for r in rows)
    assert rows[1]["text"].startswith(rows[0]["text"][-20:])
    plain = value(spark, ck.group_paragraphs(F.array(*map(F.lit, paragraphs)), 70, 0))
    assert plain == paragraphs


def test_oversize_paragraph_carries_nothing_over(spark):
    pieces = value(spark, ck.group_paragraphs(F.array(F.lit("a" * 12), F.lit("bb"), F.lit("cc")), 10, 4))
    assert pieces == ["a" * 10, "a" * 6, "bb\n\ncc"]


def test_hard_split(spark):
    pieces = value(spark, ck.hard_split(F.lit("a" * 250), 100, 20))
    assert [len(p) for p in pieces] == [100, 100, 90]
    assert value(spark, ck.hard_split(F.lit("ab"), 100, 200)) == ["ab"]


def test_clauses(spark):
    rows = chunk(spark, "regulatory", CODE_OF_PRACTICE)
    assert [(r["clause"], r["section"]) for r in rows] == [
        ("", ""),
        ("4", "Chapter One > Clause 4"),
        ("5", "Chapter One > Clause 5"),
        ("32", "Clause 31 > Clause 32"),
    ]
    assert "Twice a minute." in rows[0]["text"]
    assert rows[2]["text"] == "### Clause 5\n\nBells are rung in fog."
    rows = chunk(spark, "security", "## Part C\n\n### Clause 5\n\n## Part D\n")
    assert rows[1]["text"] == "### Clause 5" and rows[1]["section"] == "Part C > Clause 5"


def test_clause_heading_in_a_fence_and_double_spacing(spark):
    rows = chunk(spark, "regulatory", "### Clause 7\n\nFirst.\nSecond.\n\n```\n### Clause 999\n```\n")
    assert [r["clause"] for r in rows] == ["7"]
    assert "First.\n\nSecond." in rows[0]["text"] and "Clause 999" in rows[0]["text"]


def test_code_symbols(spark):
    rows = chunk(spark, "code", MODULE, "port/sea.py")
    assert [r["code_ref"] for r in rows] == [
        "port/sea.py#module", "port/sea.py#Buoy:3-4", "port/sea.py#drift:7-8", "port/sea.py#module", "port/sea.py#tide:14-16"
    ]
    assert [r["text"] for r in rows][3:] == ["DEFAULT = drift(2)", "@cached\nasync def tide(day):\n    return day"]


def test_carriage_returns_and_deep_nesting(spark):
    rows = chunk(spark, "code", "a = 1\rdef f():\r    return a\r\ndef g():\r\n    pass\r", "m.py")
    assert [r["section"] for r in rows] == ["m.py#module", "m.py#f", "m.py#g"]
    deep = "x = " + "(" * 5000 + ")" * 5000 + "\ndef f():\n    pass\n"
    rows = chunk(spark, "code", deep, "m.py", size=20000)
    assert [r["section"] for r in rows] == ["m.py#module", "m.py#f"]


def test_code_without_symbols_and_broken_code(spark):
    assert [r["section"] for r in chunk(spark, "code", "import os\n# note\nimport sys\n", "m.py")] == ["m.py#module"]
    assert chunk(spark, "code", "  \n", "m.py") == []
    rows = chunk(spark, "code", "import os\n\ndef f(:\n    pass\n", "m.py")
    assert [r["section"] for r in rows] == ["m.py#module", "m.py#f"]
    assert chunk(spark, "code", "# T\n\nbody\n", "notes.md")[0]["code_ref"] == ""


def test_code_between_symbols(spark):
    source = "a = 1; b = 'é'  # tail\n# own line\n\n\ndef f():\n    # inside\n    return a  # kept\n\nif a:\n    b = 2\n"
    rows = chunk(spark, "code", source, "m.py")
    assert [r["text"] for r in rows] == [
        "a = 1\n;\nb = 'é'\n# tail\n# own line",
        "def f():\n    # inside\n    return a  # kept",
        "if a:\n    b = 2",
    ]
    assert rows[1]["code_ref"] == "m.py#f:5-7"


def test_sections(spark):
    def section(path):
        return value(spark, extract_section(F.lit(GUIDE), F.lit(path)))

    assert section("Boarding > Bicycles") == "### Bicycles\n\nWalk them on."
    assert section("Boarding").startswith("## Boarding") and "Engines off." in section("Boarding")
    assert section("Ferry handbook > Safety") == "## Safety\n\nVests are under the seats."
    assert section("Nothing") is None and section(" > ") is None


def test_section_requests(spark):
    docs = spark.createDataFrame([("data/g.md", GUIDE)], "source_path string, text string")
    asked = spark.createDataFrame(
        [("data/g.md", "Safety"), ("data/g.md", None), ("data/none.md", "Safety")], "source_path string, section string"
    )
    found = {(r["source_path"], r["section"]): r["content"] for r in lookup_sections(asked, docs).collect()}
    assert found["data/g.md", "Safety"].startswith("## Safety")
    assert found["data/g.md", None] == GUIDE and found["data/none.md", "Safety"] is None


def test_segments_are_handed_on_a_few_sources_at_a_time():
    sources = pa.array([f"x = {i}\n" if i % 7 else None for i in range(1000)])
    pieces = list(ck.python_segments.func(iter([sources, sources[:0], sources[:3]])))
    assert max(map(len, pieces)) <= ck.SOURCES_AT_ONCE < 1000
    found = [s for piece in pieces for s in piece.to_pylist()]
    assert len(found) == 1003 and found[0] == [] and found[8] == [{"symbol": "", "first": 1, "last": 1, "body": "x = 8"}] and found[1001] == found[1]
