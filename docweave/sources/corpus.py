"""A directory tree of classified files as a documents table."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.barrier import settle
from docweave.operators.joins import broadcast_if_small

# Document classes in ingestion order, supported and skipped files.
DOC_TYPES = ("regulatory", "security", "architecture", "code")
TEXT_SUFFIXES = (".md", ".markdown", ".txt")
CODE_SUFFIXES = (".py",)
PDF_SUFFIXES = (".pdf",)
SKIPPED_NAMES = ("README.md",)

PDF_HINT = (
    "no PDF converter is configured: pass pdf_to_text, or convert the file to markdown by hand "
    "and put the .md next to it"
)


def classify(directory: Column) -> Column:
    """The class a directory name stands for, or NULL."""
    return F.when(directory.isin(*DOC_TYPES), directory)


def _suffix(name: Column) -> Column:
    """Last extension with its dot, lower-cased; a leading dot does not start one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+?(\.[^.]+)\z", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def _below(path: Column, root: str) -> Column:
    """What follows the root; readers may put a scheme and authority before it, so the first occurrence counts."""
    base = re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    after = lambda bare: (
        F.when(bare.startswith(base), F.substr(bare, F.lit(len(base) + 1)))
        .when(bare.contains(base), F.substr(bare, F.instr(bare, base) + len(base)))
        .otherwise(bare)
    )
    return tx.let(F.regexp_replace(path, r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", ""), after)


def walk(files: DataFrame, root: str) -> DataFrame:
    """Ingestible files of a listing (column ``path``), with class, suffix and reading order.

    The class is the directory right below the root, however deep the file lies.
    """
    rel = _below(F.col("path"), root)
    parts = F.split("rel", "/")
    # Class, name and suffix are filtered on: the path is cut once, below them.
    listed = settle(files.withColumn("rel", rel).withColumn("parts", parts))
    listed = listed.withColumns(
        {
            "name": F.element_at("parts", -1),
            "doc_type": classify(F.get("parts", F.lit(0))),
        }
    ).withColumn("suffix", _suffix(F.col("name")))
    return listed.where(
        F.col("doc_type").isNotNull()
        & (F.size("parts") > 1)
        & ~F.col("name").isin(*SKIPPED_NAMES)
        & ~F.col("name").startswith(".")
        & F.col("suffix").isin(*TEXT_SUFFIXES, *CODE_SUFFIXES, *PDF_SUFFIXES)
    ).withColumns(
        {
            "class_order": F.array_position(F.array(*map(F.lit, DOC_TYPES)), F.col("doc_type")).cast("int"),
            "stem": file_stem(F.col("name")),
            "source_path": F.concat(F.lit(os.path.basename(root.rstrip("/")) + "/"), F.col("rel")),
        }
    )


def later_namesakes(files: DataFrame) -> DataFrame:
    """Paths of the files whose stem an earlier file already has.

    The first file of a stem comes from a pre-aggregated minimum and is taken
    out by its unique path, so files sharing one stem are never gathered.
    """
    stems = files.groupBy("stem").agg(
        F.min(F.struct("class_order", "parts", "path")).alias("first"), F.count("*").alias("n")
    )
    shared = stems.where(F.col("n") > 1)
    return (
        files.select("path", "stem")
        .join(shared.select("stem"), "stem", "left_semi")
        .join(shared.select(F.col("first.path").alias("path")), "path", "left_anti")
        .select("path")
    )


def with_doc_ids(files: DataFrame, namesakes: DataFrame) -> DataFrame:
    """The file stem as document id, with a path hash behind it for later namesakes."""
    suffixed = F.concat(F.col("stem"), F.lit("-"), F.substring(F.sha2("source_path", 256), 1, 8))
    flagged = files.join(namesakes.withColumn("is_later", F.lit(True)), "path", "left")
    return flagged.withColumn(
        "doc_id", F.when(F.col("is_later"), suffixed).otherwise(F.col("stem"))
    ).drop("is_later")


def decode_text(content: Column) -> Column:
    """S3: bytes as UTF-8, undecodable ones replaced, in the JVM."""
    return F.make_valid_utf8(content.cast("string"))


def _pdf_reader(convert: Callable[[bytes], str] | None):
    """A converter as a vectorized function; without one, any PDF fails the job with a hint."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        if convert is None:
            raise RuntimeError(PDF_HINT)
        return contents.map(convert)

    return read


def _unseen_by_reader(component: str) -> bool:
    """Path components that Spark's file listing passes over."""
    return (
        component.startswith(".")
        or (component.startswith("_") and "=" not in component)
        or component.endswith("._COPYING_")
    )


def unlisted_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below names such as ``__init__.py`` that the binary file reader leaves out: path, content.

    Only their paths are listed here; the contents are read in the tasks.
    """
    system, base = fs.FileSystem.from_uri(root)
    names = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
    hidden = [n for n in names if any(map(_unseen_by_reader, n[len(base) :].strip("/").split("/")))]
    paths = spark.createDataFrame([(n, root.rstrip("/") + n[len(base) :]) for n in hidden], "name string, path string")

    @F.pandas_udf("binary")
    def read(batch: pd.Series) -> pd.Series:
        source, _ = fs.FileSystem.from_uri(root)

        def content(name: str) -> bytes:
            with source.open_input_stream(name) as stream:
                return stream.read()

        return batch.map(content)

    return paths.select("path", read("name").alias("content"))


def _any_case_glob(suffixes: tuple[str, ...]) -> str:
    letters = ["".join(f"[{ch}{ch.upper()}]" if ch.isalpha() else ch for ch in s) for s in suffixes]
    return "*{" + ",".join(letters) + "}"


def load_documents(
    spark: SparkSession, root: str, pdf_to_text: Callable[[bytes], str] | None = None
) -> DataFrame:
    """Documents under ``root``: doc_id, doc_type, title, source_path, abs_path, text, reading order.

    Document ids come from the listing alone. File contents are read once and
    meet only the later namesakes, so texts are not shuffled for their ids.
    """
    if "://" not in root:
        root = os.path.abspath(root)
        if not os.path.isdir(root):
            raise FileNotFoundError(f"data directory not found: {root}")

    unlisted = unlisted_files(spark, root)

    def files(glob: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        listed = reader.option("pathGlobFilter", glob).load(root).select("path", "content")
        return walk(listed.unionByName(unlisted), root)

    namesakes = broadcast_if_small(later_namesakes(files("*").drop("content")))
    columns = ["doc_id", "doc_type", "source_path", "path", "stem", "class_order", "parts"]
    is_pdf = F.col("suffix").isin(*PDF_SUFFIXES)
    texts = with_doc_ids(files(_any_case_glob(TEXT_SUFFIXES + CODE_SUFFIXES)).where(~is_pdf), namesakes)
    pdfs = with_doc_ids(files(_any_case_glob(PDF_SUFFIXES)).where(is_pdf), namesakes)
    read = texts.select(*columns, decode_text(F.col("content")).alias("text")).unionByName(
        pdfs.select(*columns, _pdf_reader(pdf_to_text)("content").alias("text"))
    )
    return read.select(
        "doc_id",
        "doc_type",
        tx.markdown_title(F.col("text"), F.col("stem")).alias("title"),
        "source_path",
        F.col("path").alias("abs_path"),
        "text",
        "class_order",
        "parts",
    )


def resolve_source(path: Column, root: str) -> Column:
    """S11 guard: path below the data root, or NULL when it leads out of it.

    A leading "data/" is dropped, then "." and ".." are resolved against the
    absolute root the way a file system does; the result must lie within it.
    """
    base = [p for p in root.split("/") if p]
    rel = F.regexp_replace(path, "^data/", "")
    home = F.array(*map(F.lit, base)).cast("array<string>")
    empty = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), stack)
            .when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part)))
        )

    resolved = F.aggregate(F.split(rel, "/"), F.when(rel.startswith("/"), empty).otherwise(home), step)
    inside = lambda s: F.slice(s, F.lit(1), F.lit(len(base))) == home
    below = lambda s: F.slice(s, F.lit(len(base) + 1), F.greatest(F.size(s), F.lit(1)))
    return tx.let(resolved, lambda s: F.when(inside(s), F.array_join(below(s), "/")))
