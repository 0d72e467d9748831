"""JSON Schema checks: a schema becomes one expression over the text of a value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.edits import translated
from quarry.functions.json import utf16_length
from quarry.functions.jsontext import STRING, alone, bound, dumps, elements, is_array, is_object, is_string, member, members, unquoted

#: Strings, marks and other scalars of a JSON text.
_TOKEN = rf'({STRING}:?+|[\[\]{{}},:]|[^"\[\]{{}},:]+)'
_ERRORS = "array<struct<path:string,msg:string>>"

#: Ready-made schemas.
SCHEMAS: dict[str, dict] = {
    "openai-chat": {
        "type": "object",
        "required": ["messages"],
        "properties": {
            "messages": {
                "type": "array",
                "minItems": 1,
                "items": {
                    "type": "object",
                    "required": ["role", "content"],
                    "properties": {"role": {"type": "string", "enum": ["system", "user", "assistant", "tool", "function"]}, "content": {"type": ["string", "array", "null"]}},
                },
            }
        },
    },
    "sharegpt": {
        "type": "object",
        "required": ["conversations"],
        "properties": {"conversations": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["from", "value"], "properties": {"from": {"type": "string"}, "value": {"type": "string"}}}}},
    },
    "alpaca": {
        "type": "object",
        "required": ["instruction", "output"],
        "properties": {"instruction": {"type": "string", "minLength": 1}, "input": {"type": "string"}, "output": {"type": "string", "minLength": 1}},
    },
}


def _number(raw: Column) -> Column:
    return raw.try_cast("double")


def kind_of(raw: Column) -> Column:
    """JSON type name of a value's text; a number without fraction is an integer."""
    plain = F.when(raw == "null", "null").when(raw.isin("true", "false"), "boolean").otherwise(F.when(_number(raw) == F.floor(_number(raw)), "integer").otherwise("number"))
    return F.when(is_string(raw), "string").when(is_object(raw), "object").when(is_array(raw), "array").otherwise(plain)


def canonical(raw: Column) -> Column:
    """A value's text with sorted keys, numbers by value and strings in one spelling."""
    tokens = F.transform(F.regexp_extract_all(raw, F.lit(_TOKEN)), lambda t: F.when(is_string(t), t).otherwise(F.coalesce(_number(t).cast("string"), t)))
    return F.coalesce(F.to_json(F.try_parse_json(F.array_join(tokens, ""))), raw)


def _error(path: Column, msg: str | Column) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"))).cast(_ERRORS)


def _unless(fine: Column, path: Column, msg: str | Column) -> Column:
    """The error, unless the condition holds (or cannot be told)."""
    return F.when(F.coalesce(fine, F.lit(True)), F.array().cast(_ERRORS)).otherwise(_error(path, msg))


def _pattern(text: str) -> str | None:
    """A pattern as Spark takes it; None for an invalid one."""
    try:
        return translated(text)[0]
    except (re.error, ValueError):
        return None


def _limits(raw: Column, kind: Column, schema: dict, path: Column) -> list[Column]:
    """Broken lengths, patterns, bounds and numbers of items."""
    out = []
    given = lambda name: schema.get(name) is not None
    size, number = utf16_length(unquoted(raw)), kind.isin("integer", "number")
    if given("minLength"):
        out.append(_unless((kind != "string") | (size >= schema["minLength"]), path, f"minLength {schema['minLength']}"))
    if given("maxLength"):
        out.append(_unless((kind != "string") | (size <= schema["maxLength"]), path, f"maxLength {schema['maxLength']}"))
    if schema.get("pattern") and (pattern := _pattern(schema["pattern"])):
        out.append(_unless((kind != "string") | unquoted(raw).rlike(pattern), path, "pattern mismatch"))
    if given("minimum"):
        out.append(_unless(~number | (_number(raw) >= schema["minimum"]), path, f"< minimum {schema['minimum']}"))
    if given("maximum"):
        out.append(_unless(~number | (_number(raw) <= schema["maximum"]), path, f"> maximum {schema['maximum']}"))
    for name, fits in (("minItems", lambda n, most: n >= most), ("maxItems", lambda n, most: n <= most)):
        if given(name):
            out.append(_unless((kind != "array") | fits(F.size(elements(raw)), schema[name]), path, f"{name} {schema[name]}"))
    return out


def _inside(raw: Column, schema: dict, path: Column) -> list[Column]:
    """What the items and members of a value break."""
    out, items = [], schema.get("items")
    if isinstance(items, dict):
        each = lambda x, i: broken_rules(x, items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        out.append(F.flatten(F.transform(elements(raw), each)))
    elif items:
        nth = lambda xs, i, sub: F.when(F.size(xs) > i, broken_rules(F.get(xs, F.lit(i)), sub, F.concat(path, F.lit(f"[{i}]")))).otherwise(F.array().cast(_ERRORS))
        out.append(bound(elements(raw), lambda xs: F.concat(*[nth(xs, i, sub) for i, sub in enumerate(items)])))
    required, properties = schema.get("required") or (), schema.get("properties") or {}
    if required or properties:
        at = lambda k: F.concat(path, F.lit(f".{k}"))
        none = F.array().cast(_ERRORS)

        def of(m: Column) -> Column:
            missing = [_missing(m, name, at(name)) for name in required]
            present = [F.when(member(m, name).isNotNull(), broken_rules(member(m, name), sub, at(name))).otherwise(none) for name, sub in properties.items()]
            return F.concat(*missing, *present, none)

        out.append(bound(members(raw), of))
    return [F.coalesce(x, F.array().cast(_ERRORS)) for x in out]


def _missing(m: Column, key: str, path: Column) -> Column:
    return _unless(F.exists(m, lambda e: e["key"] == key), path, "required")


def broken_rules(raw: Column, schema: dict, path: Column) -> Column:
    """Array of (path, msg) of what a value's text breaks: const, enum, type, lengths, pattern, bounds, items, required, properties, allOf, anyOf, oneOf.

    An invalid pattern is ignored. Own keys only count as present.
    """

    def of(value: Column) -> Column:
        kind, out = kind_of(value), [F.array().cast(_ERRORS)]
        if "const" in schema:
            out.append(_unless(canonical(value) == canonical(F.lit(dumps(schema["const"]))), path, f"expected const {dumps(schema['const'])}"))
        if isinstance(schema.get("enum"), list):
            same = F.lit(False)
            for x in schema["enum"]:
                same = same | (canonical(value) == canonical(F.lit(dumps(x))))
            out.append(_unless(same, path, "not in enum"))
        if schema.get("type"):
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            out.append(_unless(kind.isin(*names, *(["integer"] if "number" in names else [])), path, F.concat(F.lit(f"expected type {'|'.join(names)}, got "), kind)))
        out += _limits(value, kind, schema, path) + _inside(value, schema, path)
        out += [broken_rules(value, sub, path) for sub in schema.get("allOf") or ()]
        for name in ("anyOf", "oneOf"):
            if isinstance(schema.get(name), list):
                passed = F.lit(0)
                for sub in schema[name]:
                    passed = passed + F.when(F.size(broken_rules(value, sub, path)) == 0, 1).otherwise(0)
                out.append(_unless(passed > 0, path, "anyOf failed") if name == "anyOf" else _unless(passed == 1, path, F.concat(F.lit("oneOf matched "), passed.cast("string"))))
        return F.concat(*out)

    return bound(raw, of)


def errors(json: Column, schema: dict) -> Column:
    """Array of (path, msg) of what a minified JSON text breaks. Null, and what Spark's JSON reader refuses (over 1,000 levels), fails with `parse error`."""
    unread = json.isNull() | is_object(json) & members(json).isNull() | is_array(json) & elements(json).isNull()
    return alone(F.when(unread, _error(F.lit("$"), "parse error")).otherwise(broken_rules(json, schema, F.lit("$"))))


def validate(rows: DataFrame, schema: dict | str) -> DataFrame:
    """(row_id, errors) of the live rows that fail; an error row fails with `parse error`."""
    schema = SCHEMAS[schema] if isinstance(schema, str) else schema
    return rows.where("not deleted").select("row_id", errors(F.when(~F.col("error"), F.col("json")), schema).alias("errors")).where(F.size("errors") > 0)


def exclude_failures(rows: DataFrame, schema: dict | str) -> DataFrame:
    """Rows with `excluded` set where validation fails."""
    bad = validate(rows, schema).select(F.col("row_id").alias("__id"))
    out = rows.join(bad, F.col("row_id") == F.col("__id"), "left")
    return out.withColumn("excluded", F.col("excluded") | F.col("__id").isNotNull()).drop("__id")
