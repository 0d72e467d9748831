"""JSON text taken apart and put together by expressions: members, elements and strings as they are spelled."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string of a JSON text, and the pieces of one: keys with their colon, other strings, and what lies between.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
PIECE = rf'({STRING}:?+|[^"]++)'


def dumps(value) -> str:
    """A plain value as JSON text."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f may use its argument several times: as the element of an array it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def alone(value: Column) -> Column:
    """value as a result of a projection of its own: marked as not deterministic, it is computed once, and neither copied into filters nor merged into the arguments of an Arrow function (which Spark loses track of when they hold nested lambdas)."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def is_string(raw: Column) -> Column:
    """True for the text of a JSON string."""
    return F.coalesce(F.startswith(raw, F.lit('"')), F.lit(False))


def is_object(raw: Column) -> Column:
    """True for the text of a JSON object."""
    return F.coalesce(F.startswith(raw, F.lit("{")), F.lit(False))


def is_array(raw: Column) -> Column:
    """True for the text of a JSON array."""
    return F.coalesce(F.startswith(raw, F.lit("[")), F.lit(False))


def unquoted(raw: Column) -> Column:
    """The string that the text of a JSON string stands for; null for other text."""
    escaped = F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]")
    return F.when(is_string(raw), F.when(F.instr(raw, "\\") > 0, escaped).otherwise(F.substring(raw, F.lit(2), F.length(raw) - 2)))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return bound(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _pieces(text: Column, change: Callable[[Column], Column]) -> Column:
    """text with change(raw) in place of each string that is no key, at any depth."""
    value = lambda p: is_string(p) & ~F.endswith(p, F.lit(":"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE)), lambda p: F.when(value(p), change(p)).otherwise(p)), "")


def on_strings(text: Column, change: Callable[[Column], Column]) -> Column:
    """JSON text with change(string) in place of each string value, at any depth. Keys, numbers and strings that stay the same keep their spelling."""

    def one(raw: Column) -> Column:
        return bound(unquoted(raw), lambda s: bound(change(s), lambda n: F.when(n == s, raw).otherwise(quoted(n))))

    return _pieces(text, one)


def string_values(text: Column) -> Column:
    """The string values of a JSON text, at any depth, in order."""
    values = F.filter(F.regexp_extract_all(text, F.lit(PIECE)), lambda p: is_string(p) & ~F.endswith(p, F.lit(":")))
    return F.transform(values, unquoted)


def _coded(text: Column) -> Column:
    """JSON text with each key and string as base64 of its spelling, and each other scalar as a string behind #.

    Spark's reader gives the values of a map or an array without quotes and escapes, and spells numbers anew; so coded, each comes back as it was.
    """

    def one(p: Column) -> Column:
        key = F.endswith(p, F.lit(":"))
        plain = F.when(key, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        # base64 may come in lines
        string = F.concat(F.lit('"'), F.replace(F.base64(plain.cast("binary")), F.lit("\r\n"), F.lit("")), F.when(key, '":').otherwise('"'))
        return F.when(is_string(p), string).otherwise(F.regexp_replace(p, r"([^\[\]{},:]+)", '"#$1"'))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE)), one), "")


def _scalar(code: Column) -> Column:
    return F.when(F.startswith(code, F.lit("#")), F.substring(code, F.lit(2), F.length(code))).otherwise(F.unbase64(code).cast("string"))


def _decoded(value: Column) -> Column:
    """A value of such a text as it was spelled."""

    def one(p: Column) -> Column:
        key = F.endswith(p, F.lit(":"))
        return F.when(is_string(p), F.concat(_scalar(F.substring(p, F.lit(2), F.length(p) - F.when(key, 3).otherwise(2))), F.when(key, ":").otherwise(""))).otherwise(p)

    return F.when(is_array(value) | is_object(value), F.array_join(F.transform(F.regexp_extract_all(value, F.lit(PIECE)), one), "")).otherwise(_scalar(value))


def members(text: Column) -> Column:
    """array<struct<key,name,value>> of the text of a JSON object, in order; names and values as they are spelled. Of a repeated key the last value, at the place of the first.

    Null for other text, and for what Spark's reader refuses (over 1,000 levels).
    """

    def of(e: Column) -> Column:
        name = F.unbase64(e["key"]).cast("string")
        return F.struct(unquoted(name).alias("key"), name.alias("name"), _decoded(e["value"]).alias("value"))

    found = F.transform(F.map_entries(F.from_json(F.when(is_object(text), _coded(text)), "map<string,string>")), of)

    def once(m: Column) -> Column:
        keys = F.array_distinct(F.transform(m, lambda e: e["key"]))
        return F.when(F.size(keys) == F.size(m), m).otherwise(F.transform(keys, lambda k: F.element_at(F.filter(m, lambda e: e["key"] == k), -1)))

    return bound(found, once)


def elements(text: Column) -> Column:
    """array<string> of the text of a JSON array, elements as they are spelled; null as members()."""
    return F.transform(F.from_json(F.when(is_array(text), _coded(text)), "array<string>"), _decoded)


def object_of(m: Column) -> Column:
    """The text of an object of members."""
    return F.concat(F.lit("{"), F.array_join(F.transform(m, lambda e: F.concat(e["name"], F.lit(":"), e["value"])), ","), F.lit("}"))


def array_of(items: Column) -> Column:
    """The text of an array of elements."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def member(m: Column, key: str | Column) -> Column:
    """The value of a member; null if there is none."""
    return F.get(F.filter(m, lambda e: e["key"] == key), F.lit(0))["value"]


def first(m: Column, *keys: str) -> Column:
    """The value of the first of the keys that has one and is not JSON null."""
    return F.coalesce(*[F.nullif(member(m, k), F.lit("null")) for k in keys])


def entry(key: str, value: Column, name: Column | None = None) -> Column:
    """A member."""
    return F.struct(F.lit(key).alias("key"), (F.lit(dumps(key)) if name is None else name).alias("name"), value.alias("value"))


def put(m: Column, key: str, value: Column) -> Column:
    """Members with one set: in its place, or behind the others."""
    has = F.exists(m, lambda e: e["key"] == key)
    return F.when(has, F.transform(m, lambda e: F.when(e["key"] == key, entry(key, value, e["name"])).otherwise(e))).otherwise(F.concat(m, F.array(entry(key, value))))


def without(m: Column, key: str) -> Column:
    """Members but one."""
    return F.filter(m, lambda e: e["key"] != key)
