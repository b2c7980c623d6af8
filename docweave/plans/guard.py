"""What a generated statement must satisfy before it may run.

Spark's own analysis decides. The statement is parsed and analysed, not run; every operator of the analysed plan,
in subqueries and CTE bodies too, must be one of a plain read, and what it reads must be one of the given views, by
the identity that names resolve to. Joins must have an equality between their sides. For tables of statements the
first questions (empty, a URL, a write keyword) are answered by columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx

# Write keywords, and how URLs and quoted literals look.
WRITE_KEYWORDS = "CREATE MERGE DELETE SET DETACH DROP REMOVE CALL LOAD FOREACH"
URL = r"https?://"
LITERAL = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""

# Operators of analysed plans that a plain read is made of.
READS = set(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias "
    "Window WithCTE CTERelationDef CTERelationRef OneRowRelation LocalRelation View Generate Expand Sample ResolvedHint".split()
)
# What a statement may be before names are resolved, by its root; commands and writes have other roots.
ROOTS = READS | {"UnresolvedWith", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "WithWindowDefinition", "Pivot", "Unpivot"}
# Expressions by which a query could leave the engine or see where data lies.
FOREIGN = set(
    "CallMethodViaReflection TryReflect StaticInvoke Invoke InputFileName InputFileBlockStart InputFileBlockLength "
    "ScalaUDF PythonUDF PythonUDAF ScalaUDAF ScalaAggregator HiveSimpleUDF HiveGenericUDF".split()
)
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


# What makes the bounds of literals and subqueries hard to tell, and where a list of values to miss begins.
HIDDEN_TEXT = r"--|/\*|`|\$\$"
MISSED_LIST = r"(?is)\bNOT\s+IN\s*\((?=[\s(]*(?:SELECT|WITH)\b)"


class Refused(ValueError):
    """The statement may not run; the message says why."""


def bare(text: str) -> str:
    """A reply's statement: what its fence holds, or all of it, without closing semicolons."""
    pieces = (text or "").split("```")
    inner = re.sub(r"\A[a-z]*\s", "", pieces[1]) if len(pieces) > 2 else (text or "")
    return inner.strip().rstrip("; \n\t").strip()


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _listed(nodes) -> Iterator:
    return (nodes.apply(i) for i in range(nodes.size()))


def _expressions(node) -> Iterator:
    """All expressions of a plan's operator, inner ones too."""
    waiting = list(_listed(node.expressions()))
    while waiting:
        expression = waiting.pop()
        yield expression
        waiting += _listed(expression.children())


def operators(plan, into_views: bool) -> Iterator:
    """All operators of a plan, those of subqueries too; with ``into_views`` also those that views are made of."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [e.plan() for e in _expressions(node) if _kind(e) in SUBQUERIES]
        if into_views or _kind(node) != "View":
            waiting += _listed(node.children())


def _check_reads(plan, allowed: set[str]) -> None:
    for node in operators(plan, into_views=False):
        kind = _kind(node)
        if kind == "View":
            name = node.desc().identifier().unquotedString().lower()
            if name not in allowed or (node.isTempView() and "." in name):
                raise Refused(f"{name} is not one of {', '.join(sorted(allowed))}")
        elif kind not in READS:
            raise Refused(f"{kind} is not part of a plain SELECT over {', '.join(sorted(allowed))}")
        else:
            for expression in _expressions(node):
                if _kind(expression) in FOREIGN:
                    raise Refused(f"{expression.prettyName()} may not be called")


def _check_joins(spark: SparkSession, plan) -> None:
    keys = spark._jvm.org.apache.spark.sql.catalyst.planning
    for node in operators(plan, into_views=True):
        if _kind(node) == "LateralJoin":
            raise Refused("a lateral join has no equality")
        if _kind(node) == "Join" and not (
            keys.ExtractEquiJoinKeys.unapply(node).isDefined() or keys.ExtractSingleColumnNullAwareAntiJoin.unapply(node).isDefined()
        ):
            raise Refused("tables are joined without an equality between them")


def distinct_lists(statement: str) -> str:
    """The statement with each value once in what follows its NOT IN, which asks no more of a list.

    Spark hands such a list whole to every executor. A statement whose text is hard to read stays as it is.
    """
    if re.search(HIDDEN_TEXT, statement):
        return statement
    literals = [m.span() for m in re.finditer(LITERAL, statement)]
    if any(re.match(r"[\w&]", statement[start - 1]) for start, _ in literals if start):  # of a kind with escapes of its own
        return statement
    bare_text = list(statement)
    for start, end in literals:
        bare_text[start:end] = "'" * (end - start)
    plain = "".join(bare_text)
    inserted: list[tuple[int, str]] = []
    for found in re.finditer(MISSED_LIST, plain):
        depth, end = 1, found.end()
        while depth and end < len(plain):
            depth += {"(": 1, ")": -1}.get(plain[end], 0)
            end += 1
        if depth:
            return statement
        inserted += [(found.end(), "SELECT DISTINCT * FROM ("), (end - 1, ")")]
    for place, piece in sorted(inserted, reverse=True):
        statement = statement[:place] + piece + statement[place:]
    return statement


def _check(spark: SparkSession, df: DataFrame, allowed: set[str]) -> DataFrame:
    execution = df._jdf.queryExecution()
    _check_reads(execution.analyzed(), allowed)
    _check_joins(spark, execution.optimizedPlan())
    return df


def checked(spark: SparkSession, statement: str, views: Iterable[str]) -> DataFrame:
    """The statement as a DataFrame; Refused when it does more than read the views.

    ``views`` are names of temporary views, or full names of stored ones. What the views themselves read is not
    asked; their joins need an equality as well.
    """
    allowed = {v.lower() for v in views}
    if re.search(URL, statement, re.IGNORECASE):
        raise Refused("a URL is not permitted")
    if not re.match(r"(?is)[\s(]*(?:SELECT|WITH)\b", statement):
        raise Refused(f"only a SELECT over {', '.join(sorted(allowed))} may run")
    root = _kind(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))
    if root not in ROOTS:
        raise Refused(f"{root} is not a SELECT")
    df = _check(spark, spark.sql(statement), allowed)  # a query by its root: analysed here, run by whoever reads it
    if (lean := distinct_lists(statement)) != statement:
        try:
            other = _check(spark, spark.sql(lean), allowed)
            if other.schema == df.schema:
                return other
        except (AnalysisException, ParseException, Refused):  # as stated, it may run
            pass
    return df


# ------------------------------------------------------------- Column forms


def cleaned(text: Column) -> Column:
    return tx.strip(F.rtrim(tx.strip_fences(text), F.lit(";")))


def verdict(text: Column) -> Column:
    """F14 over a column: ok, empty, url or write_keyword."""
    statement = cleaned(text)
    outside = F.regexp_replace(statement, LITERAL, "''")
    keyword = r"(?i)\b(" + WRITE_KEYWORDS.replace(" ", "|") + r")\b"
    return (
        F.when(statement == "", "empty")
        .when(statement.rlike("(?i)" + URL), "url")
        .when(outside.rlike(keyword), "write_keyword")
        .otherwise("ok")
    )


def unique_columns(names: list[str]) -> list[str]:
    """result columns told apart; the n-th of one name gets the number n, or the next that is free."""
    given: list[str] = []
    for name in names:
        numbered = (f"{name}_{n}" for n in range(2, len(names) + 2))
        given.append(name if name not in given else next(c for c in numbered if c not in given))
    return given
