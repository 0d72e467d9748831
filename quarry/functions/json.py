"""JSON text and Variant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of JSON-ish text and of trimming (space, tabs, line ends, no-break and other Unicode spaces).
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"


def strict_variant(raw: Column) -> Column:
    """Variant of a JSON text, or null if it is not exactly one JSON value.

    try_parse_json ignores text after the value; wrapped in an array and in an object
    such text is an error. JSON null is a variant null, not SQL NULL.
    """
    both = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"r":'), raw, F.lit("}"))).isNotNull()
    return F.when(both, F.try_parse_json(raw))


def minified(raw: Column) -> Column:
    """JSON text without white space between tokens; key order and spelling of values stay."""
    return F.regexp_replace(raw, r'("(?:[^"\\]++|\\.)*+")|\s+', "$1")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, as long."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text).cast("long")).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"))


def trimmed(text: Column) -> Column:
    """text without SPACE at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def key(v: Column, name: str) -> Column:
    """Variant under a top-level key; SQL NULL if it is missing, variant null if it is JSON null."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def elements(v: Column) -> Column:
    """array<variant> of a JSON array, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    """True for a JSON object, never null."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def json_type(v: Column) -> Column:
    """null, boolean, integer, number, string, array or object for a variant; SQL NULL for SQL NULL. A number without fraction is an integer."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(F.is_variant_null(v), "null")
        .when(elements(v).isNotNull(), "array")
        .when(is_object(v), "object")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(kind == "BIGINT", "integer")
        .when(kind.isNotNull(), F.when(number == F.floor(number), "integer").otherwise("number"))
    )


def top_keys(raw: Column) -> Column:
    """Top-level keys of a JSON object text in order; empty for other text."""
    return F.coalesce(F.array_distinct(F.json_object_keys(raw)), F.array().cast("array<string>"))
