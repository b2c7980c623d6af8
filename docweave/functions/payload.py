"""F9 and scalar access for JSON that a model wrote."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as tx


def json_text(content: Column) -> Column:
    """The object inside a reply: first "{" to last "}"; without one, the text in its fence."""
    fenced = r"(?s)^```(?:json)?\s*(.*?)\s*```\z"

    def unfenced(text: Column) -> Column:
        wrapped = text.startswith("```") & text.endswith("```")
        return F.when(wrapped, tx.strip(F.coalesce(tx.non_empty(F.regexp_extract(text, fenced, 1)), text))).otherwise(text)

    def inner(raw: Column) -> Column:
        # A fence holds no braces, so these alone say where the object lies; no pattern runs over the text.
        begin = F.length(F.substring_index(raw, "{", 1))
        end = F.length(raw) - F.length(F.substring_index(raw, "}", -1))
        return F.when(begin < end, F.substr(raw, begin + 1, end - begin)).otherwise(tx.let(tx.strip(raw), unfenced))

    return tx.let(F.coalesce(content, F.lit("")), inner)


def parse_object(content: Column) -> Column:
    """The reply as a VARIANT object, NULL when it holds none."""
    return tx.let(json_text(content), lambda t: F.when(t.startswith("{"), F.try_parse_json(t)))


def items(payload: Column, name: str) -> Column:
    """Array of VARIANT under ``name``: empty when missing, NULL when it is no list."""

    def listed(value: Column) -> Column:
        return F.when(value.isNull(), F.array().cast("array<variant>")).otherwise(
            F.try_variant_get(value, "$", "array<variant>")
        )

    return tx.let(
        payload, lambda p: F.when(p.isNotNull(), tx.let(F.variant_get(p, f"$.{name}", "variant"), listed))
    )


def texts(item: Column, names: Iterable[str]) -> Column:
    """The named fields of an object as one struct of texts, read in one go; NULL for what is no object."""
    return F.try_variant_get(item, "$", "struct<" + ", ".join(f"`{n}`: string" for n in names) + ">")


def scalar(item: Column, read: Column, name: str) -> Column:
    """The field ``name`` of an object whose ``texts`` are ``read``; NULL where it is missing, null, a list or an object.

    The type is looked up only for texts that could come from another type.
    """
    text = read[name]
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    nested = text.startswith("{") & kind.startswith("OBJECT") | text.startswith("[") & kind.startswith("ARRAY")
    odd = F.when(nested, None).when(text.isin("true", "false") & (kind == "BOOLEAN"), F.initcap(text)).otherwise(text)
    return F.when(_may_be_odd(text), odd).otherwise(text)


def _may_be_odd(text: Column) -> Column:
    """Whether a field's text could come from a list, an object or a truth value."""
    return text.startswith("{") | text.startswith("[") | text.isin("true", "false")


def read_items(payload: Column, name: str, names: Iterable[str]) -> Column:
    """The items of the list ``name`` as an array of structs of ``scalar`` fields, NULL for an item that is no object.

    All fields of all items are read in one go. Only a list with a text that could come from another type is gone
    through again, item by item.
    """
    names = list(names)
    kind = "struct<" + ", ".join(f"`{n}`: string" for n in names) + ">"

    def checked(read: Column) -> Column:
        unsure = F.exists(read, lambda r: F.coalesce(reduce(Column.__or__, [F.coalesce(_may_be_odd(r[n]), F.lit(False)) for n in names]), F.lit(False)))
        again = F.transform(
            F.try_variant_get(payload, f"$.{name}", "array<variant>"),
            lambda v: F.when(is_object(v), tx.let(texts(v, names), lambda t: F.struct(*[scalar(v, t, n).alias(n) for n in names]))),
        )
        return F.when(unsure, again).otherwise(read)

    return tx.let(F.try_variant_get(payload, f"$.{name}", f"array<{kind}>"), checked)


def is_object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def first_truthy(*fields: Column) -> Column:
    """The first of the fields that holds a non-empty, non-zero scalar, "" when none does."""
    told = [F.when(~f.isin("", "0", "0.0", "False"), f) for f in fields]
    return F.coalesce(*told, F.lit(""))
