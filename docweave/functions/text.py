"""Text functions as Column -> Column expressions.

Everything here stays in the JVM. Whitespace means what Python's ``str.strip``
and ``str.splitlines`` mean by it, so lengths and boundaries agree with the
Unicode-aware string semantics the engine is specified with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
# The line breaks Python's splitlines knows besides "\n".
OTHER_LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# One blank that is not a line break, and any run of blanks (Java regex, Unicode classes on).
BLANK = r"(?:[^\S\n]|\x1f)"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Question routes, the first being the default.
ROUTES = ("lookup", "relationship", "compliance-mapping")
TRUNCATED = " [truncated]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def unify_newlines(c: Column) -> Column:
    """Every line break as a plain newline; most texts pass on cheap byte tests alone."""
    odd = c.rlike(r"[\r\x0b\x0c\x1c-\x1e]")
    for mark in ("\x85", "\u2028", "\u2029"):
        odd = odd | c.contains(mark)
    return F.when(odd, F.regexp_replace(c, OTHER_LINE_BREAKS, "\n")).otherwise(c)


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def non_empty(c: Column) -> Column:
    """NULL for an empty string, so coalesce() skips it."""
    return F.nullif(c, F.lit(""))


def normalize_name(c: Column) -> Column:
    """F1: entity merge key. Lower case; runs of blanks, hyphens, underscores become one space."""
    return F.btrim(F.regexp_replace(F.lower(c), r"(?U)[-_\s\x1c-\x1f]+", " "))


def alnum_name(c: Column) -> Column:
    """only a-z and 0-9 of the lower-cased name; NULL counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def sanitize_query(c: Column) -> Column:
    """full-text query with everything but letters, digits and underscores blanked."""
    return F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))


def tokens(c: Column) -> Column:
    """Index terms: lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def clause_endpoint(c: Column) -> Column:
    """a clause reference as "<doc>:<number>", or NULL when it holds none."""
    value = strip(F.coalesce(c, F.lit("")))
    number = F.regexp_extract(value, r"(?U)(\d+)[\s\x1c-\x1f]*$", 1)
    doc = F.regexp_extract(value, r"(?U)^[^:]*?(CPS[\s\x1c-\x1f]*\d{3})", 1)
    return F.when(value.rlike(r"(?U)^[^:]+:\d+\z"), value).when(
        (number != "") & (doc != ""),
        F.concat(F.regexp_replace(doc, SPACE_RUN, " "), F.lit(":"), number),
    )


def endpoint_key(label: Column, raw: Column) -> Column:
    """F4 for any label: clause reference for clauses, else the normalized name; NULL if blank."""
    return non_empty(
        F.when(label == "CpsClause", clause_endpoint(raw)).otherwise(
            normalize_name(F.coalesce(raw, F.lit("")))
        )
    )


def clause_identity(given_id: Column, doc: Column, number: Column) -> Column:
    """F5 for clauses: the given id, else "<doc>:<number>"; NULL unless well formed."""
    doc, number, given = (strip(F.coalesce(x, F.lit(""))) for x in (doc, number, given_id))
    built = F.when((doc != "") & (number != ""), F.concat(doc, F.lit(":"), number))
    identity = F.coalesce(non_empty(given), built)
    return F.when(identity.rlike(r"(?U)^[^:]+:\d+\z"), identity)


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE_RUN), lambda w: w != "")


def first_token(c: Column, default: str) -> Column:
    """first word, lower-cased, without surrounding punctuation."""
    word = F.get(words(F.coalesce(c, F.lit(""))), F.lit(0))
    return F.coalesce(non_empty(F.btrim(F.lower(word), F.lit(".,:;!?\"'"))), F.lit(default))


def route(c: Column) -> Column:
    """the route named by the first word, else the default route."""
    token = first_token(c, ROUTES[0])
    return F.when(token.isin(*ROUTES), token).otherwise(F.lit(ROUTES[0]))


def _cut(c: Column, limit: int | None, mark: str = "") -> Column:
    """The first ``limit`` characters and a mark where more follow; all of them without a limit."""
    if limit is None:
        return c
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def route_rationale(c: Column, limit: int | None = None) -> Column:
    """Everything behind the first word, on one line."""
    w = words(F.coalesce(c, F.lit("")))
    return _cut(F.array_join(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), " "), limit)


def strip_fences(c: Column) -> Column:
    """the body of the first code fence, else the stripped text."""
    fence = r"(?s)```(?:cypher|sql)?\s*(.*?)```"
    return strip(F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c))


def trim_message(c: Column, limit: int | None = None) -> Column:
    """the stripped message; with a limit, so many characters plus a marker."""
    return let(strip(c), lambda s: _cut(s, limit, TRUNCATED))


def summarize(c: Column, limit: int | None = None) -> Column:
    """the detail; with a limit, so many characters plus an ellipsis."""
    return _cut(F.coalesce(c, F.lit("")), limit, "…")


def purpose_label(c: Column, limit: int | None = None) -> Column:
    """the prompt on one line; with a limit, its first characters."""
    return _cut(F.array_join(words(c), " "), limit)


def loosely_matches(expected: Column, actual: Column) -> Column:
    """F22 over alnum names: either contains the other and neither is empty."""
    return (expected != "") & (actual != "") & (actual.contains(expected) | expected.contains(actual))


def context_label(section: Column, code_ref: Column, chunk_id: Column) -> Column:
    return F.coalesce(non_empty(section), non_empty(code_ref), chunk_id, F.lit(""))


def citation_label(title: Column, clause: Column, code_ref: Column, section: Column) -> Column:
    """title, then the clause, code reference or section it points at."""
    where = F.coalesce(
        F.when(clause != "", F.concat(F.lit("¶"), clause)), non_empty(code_ref), non_empty(section)
    )
    return F.when(where.isNotNull(), F.concat(title, F.lit(" — "), where)).otherwise(title)


def markdown_title(text: Column, fallback: Column) -> Column:
    """Text of the first level-1 heading line, else the fallback."""
    heading = r"(?m)(?U)^" + BLANK + r"*#(?!#)([^\n]*[^\s\x1f][^\n]*)$"
    return F.coalesce(non_empty(strip(F.regexp_extract(unify_newlines(text), heading, 1))), fallback)
