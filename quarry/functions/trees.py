"""JSON trees of any depth: strings, nodes and differences, in one Arrow pass and with a stack instead of recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rowscan import STEP, dumps, sliced

_PLAIN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_MISSING = object()
#: Rows of an Arrow batch that a pass gives back at most, and characters from which it is given back.
BATCH, BATCH_CHARS = 10_000, 1 << 20


class Number(str):
    """A number as it is spelled."""


def loads(text: str):
    return json.loads(text, parse_int=Number, parse_float=Number)


def kind_of(value) -> str:
    """null, boolean, integer, number, string, array or object. A number without fraction is an integer."""
    if isinstance(value, Number):
        return "integer" if float(value).is_integer() else "number"
    return {str: "string", bool: "boolean", list: "array", dict: "object"}.get(type(value), "null")


def spelled(value) -> str:
    """JSON of a leaf."""
    return str(value) if isinstance(value, Number) else dumps(value)


def child_path(path: str, name: str | int) -> str:
    if isinstance(name, int):
        return f"{path}[{name}]"
    return f"{path}.{name}" if _PLAIN.fullmatch(name) else f'{path}["' + re.sub(r'(["\\])', r"\\\1", name) + '"]'


def children(value) -> list[tuple[str | int, object]]:
    return list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []


def strings(value) -> list[str]:
    """All strings in a value, in order."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, (dict, list)):
            todo.extend(x for _, x in reversed(children(v)))
        elif isinstance(v, str) and not isinstance(v, Number):
            out.append(v)
    return out


def nodes(value, depth: int | None = None) -> Iterator[tuple]:
    """(path, parent, key, type, size, value) of every node, parents first; down to `depth` containers if given."""
    todo = [("$", None, None, value, 0)]
    while todo:
        path, parent, key, v, level = todo.pop()
        box = isinstance(v, (dict, list))
        yield path, parent, key, kind_of(v), len(v) if box else None, None if box else spelled(v)
        if box and (depth is None or level < depth):
            todo.extend((child_path(path, n), path, str(n), x, level + 1) for n, x in reversed(children(v)))


def differences(a, b) -> Iterator[tuple]:
    """(path, kind, from, to) where b differs from a: change, add or remove; nothing is listed below a change of type."""
    show = lambda v: f"<{kind_of(v)}>" if isinstance(v, (dict, list)) else spelled(v)
    todo = [("$", a, b)]
    while todo:
        path, x, y = todo.pop()
        if x is _MISSING or y is _MISSING:
            if x is not y:
                yield (path, "add", None, show(y)) if x is _MISSING else (path, "remove", show(x), None)
        elif kind_of(x) != kind_of(y):
            yield path, "change", show(x), show(y)
        elif isinstance(x, (dict, list)):
            left, right = dict(children(x)), dict(children(y))
            todo.extend((child_path(path, n), left.get(n, _MISSING), right.get(n, _MISSING)) for n in {**left, **right})
        elif spelled(x) != spelled(y):
            yield path, "change", spelled(x), spelled(y)


def string_leaves(text: Column) -> Column:
    """Strings at any place of a JSON text, in order; null for null."""

    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return sliced(texts, lambda ts: [None if t is None else strings(loads(t)) for t in ts], pa.list_(pa.string()))

    return of(text)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _walked(df: DataFrame, columns: list[tuple[str, str, pa.DataType]], walk) -> DataFrame:
    """(row_id, columns) of walk(texts of a row) for df (row_id and texts)."""
    id_type = df.schema["row_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("row_id", batch.schema.field(0).type), *[(n, t) for n, _, t in columns]])
            slices = ([c.to_pylist() for c in batch.slice(i, STEP).columns] for i in range(0, batch.num_rows, STEP))
            yield from _batches(((row[0], *found) for texts in slices for row in zip(*texts) for found in walk(*row[1:])), schema)

    return df.mapInArrow(of, ", ".join([f"row_id {id_type}", *[f"`{n}` {s}" for n, s, _ in columns]]))


def node_rows(df: DataFrame, depth: int | None = None) -> DataFrame:
    """(row_id, path, parent, key, type, size, value) of every node of df (row_id, JSON text)."""
    text = pa.string()
    columns = [("path", "string", text), ("parent", "string", text), ("key", "string", text), ("type", "string", text), ("size", "int", pa.int32()), ("value", "string", text)]
    return _walked(df, columns, lambda t: nodes(loads(t), depth) if t is not None else ())


def string_rows(df: DataFrame) -> DataFrame:
    """(row_id, path, text) of every string of df (row_id, JSON text)."""
    columns = [("path", "string", pa.string()), ("text", "string", pa.string())]
    return _walked(df, columns, lambda t: ((n[0], json.loads(n[5])) for n in nodes(loads(t)) if n[3] == "string") if t is not None else ())


def difference_rows(df: DataFrame) -> DataFrame:
    """(row_id, path, kind, from, to) between the two JSON texts of df (row_id, a, b); SQL NULL is a missing value."""
    read = lambda t: _MISSING if t is None else loads(t)
    columns = [(n, "string", pa.string()) for n in ("path", "kind", "from", "to")]
    return _walked(df, columns, lambda a, b: differences(read(a), read(b)))
