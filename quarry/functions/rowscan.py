"""What a JSON row is, in one Arrow pass: whether it parses, its format, its turns and what is odd about them."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.functions.json import SPACE

#: Roles of the strict chat format, and the formats' names.
CHAT_ROLES = ("system", "user", "assistant", "tool", "function")
CHAT_FORMATS = ("openai-chat", "openai-chat-loose", "sharegpt")
#: Severity of each lint code.
SEVERITY = {
    "parse-error": "error",
    "empty-turns": "error",
    "empty-content": "warn",
    "consecutive-role": "warn",
    "no-assistant": "warn",
    "pref-empty": "error",
    "pref-equal": "warn",
    "empty-instruction": "error",
    "empty-output": "error",
    "very-short": "warn",
}
ISSUES = "array<struct<code:string,sev:string,turn:int>>"
SCAN = f"struct<error:boolean,fmt:string,turns:array<struct<role:string,content:string>>,issues:{ISSUES}>"
_ARROW = pa.struct(
    [
        ("error", pa.bool_()),
        ("fmt", pa.string()),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))),
        ("issues", pa.list_(pa.struct([("code", pa.string()), ("sev", pa.string()), ("turn", pa.int32())]))),
    ]
)
#: Values of an Arrow batch that are Python objects at a time.
STEP = 128
#: Bytes of an Arrow batch, unless the session names others: a worker's memory then depends neither on the rows of a task nor on their length.
BATCH_BYTES = 2 << 20
_EDGES = re.compile(f"^{SPACE}+|{SPACE}+$")


def _constant(name: str):
    raise ValueError(name)


def _integer(digits: str):
    return int(digits) if len(digits) < 400 else float(digits)


def parse(text: str | None):
    """(value, error) of a text that must be exactly one JSON value."""
    if text is None:
        return None, True
    try:
        return json.loads(text, parse_constant=_constant, parse_int=_integer), False
    except (ValueError, RecursionError):
        return None, True


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def as_text(value) -> str:
    """A JSON value as text: a string as it is, a number without a needless fraction, others as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return dumps(value)


def strip(text: str) -> str:
    return _EDGES.sub("", text)


def first(box, *names: str):
    """The value of the first of the keys that is neither missing nor null."""
    return next((box[n] for n in names if box.get(n) is not None), None) if isinstance(box, dict) else None


def _strings(v: dict, *names: str) -> bool:
    return any(isinstance(v.get(n), str) for n in names)


def _each(items, fits) -> bool:
    return isinstance(items, list) and bool(items) and all(isinstance(m, dict) and fits(m) for m in items)


def _has(m: dict, *names: str) -> bool:
    return any(n in m for n in names)


def is_pair(v: dict) -> bool:
    return _strings(v, "instruction") and _strings(v, "output", "response")


#: Formats of an object and their tests; the first that fits counts.
FORMATS = {
    "openai-chat": lambda v: _each(v.get("messages"), lambda m: m.get("role") in CHAT_ROLES and "content" in m if isinstance(m.get("role"), str) else False),
    "openai-chat-loose": lambda v: _each(v.get("messages"), lambda m: _has(m, "role") and _has(m, "content")),
    "sharegpt": lambda v: _each(v.get("conversations"), lambda m: _has(m, "from", "role") and _has(m, "value", "content")),
    "preference-pair": lambda v: "chosen" in v and "rejected" in v,
    "alpaca": is_pair,
    "completion": lambda v: _strings(v, "prompt") and _strings(v, "completion"),
    "text": lambda v: _strings(v, "text") and len(v) <= 3,
    "qa": lambda v: _strings(v, "question", "q") and _strings(v, "answer", "a"),
}


def format_of(v) -> str:
    if not isinstance(v, dict):
        return "array" if isinstance(v, list) else "unknown"
    return next((name for name, fits in FORMATS.items() if fits(v)), "object")


def content_text(c) -> str:
    """Text of a message content: strings as they are, parts of an array joined by line ends, null empty, other values as JSON."""
    if c is None:
        return ""
    if isinstance(c, list):
        texts = ([p] if isinstance(p, str) else [p.get("text"), p.get("content")] if isinstance(p, dict) else [] for p in c)
        return "\n".join(next((t for t in some if isinstance(t, str)), "") for some in texts)
    return c if isinstance(c, str) else dumps(c)


def turns_of(v) -> list[dict]:
    """Turns (role, content) of a chat-like value; empty for others."""
    if not isinstance(v, dict):
        return []
    for key, roles, contents in (("messages", ("role",), ("content",)), ("conversations", ("role", "from"), ("content", "value"))):
        if isinstance(v.get(key), list):
            return [{"role": "unknown" if (r := first(m, *roles)) is None else as_text(r), "content": content_text(first(m, *contents))} for m in v[key]]
    if is_pair(v):
        extra = v.get("input")
        asked, said = v["instruction"] + ("\n\n" + as_text(extra) if extra or extra in ([], {}) and extra is not None else ""), as_text(first(v, "output", "response"))
    elif FORMATS["completion"](v):
        asked, said = v["prompt"], v["completion"]
    else:
        return []
    return [{"role": "user", "content": asked}, {"role": "assistant", "content": said}]


def is_blank(value) -> bool:
    """Missing, null, false, zero, or text of white space only."""
    return not strip(value) if isinstance(value, str) else value is None or value is False or (isinstance(value, (int, float)) and value == 0)


def odd_codes(v, fmt: str, turns: list[dict]) -> list[tuple[str, int | None]]:
    """Lint codes (code, turn) that a row's format gives rise to."""
    if fmt in CHAT_FORMATS:
        if not turns:
            return [("empty-turns", None)]
        roles = [t["role"] for t in turns]
        out = [("empty-content", i) for i, t in enumerate(turns) if not strip(t["content"])]
        out += [("consecutive-role", i) for i in range(1, len(turns)) if roles[i] == roles[i - 1] and roles[i] in ("user", "assistant", "human", "gpt")]
        return out if {"assistant", "gpt"} & set(roles) else [*out, ("no-assistant", None)]
    if fmt == "preference-pair":
        pair = v["chosen"], v["rejected"]
        falsy = any(x == "" or not isinstance(x, str) and is_blank(x) for x in pair)
        equal = all(isinstance(x, str) for x in pair) and strip(pair[0]) == strip(pair[1])
        return [("pref-empty", None)] * falsy + [("pref-equal", None)] * equal
    if fmt == "alpaca":
        return [("empty-instruction", None)] * is_blank(v["instruction"]) + [("empty-output", None)] * is_blank(first(v, "output", "response"))
    return []


def scan_row(text: str | None) -> dict:
    v, error = parse(text)
    if error:
        return {"error": True, "fmt": "parse-error", "turns": [], "issues": [{"code": "parse-error", "sev": SEVERITY["parse-error"], "turn": None}]}
    fmt, turns = format_of(v), turns_of(v)
    return {"error": False, "fmt": fmt, "turns": turns, "issues": [{"code": c, "sev": SEVERITY[c], "turn": i} for c, i in odd_codes(v, fmt, turns)]}


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches end at BATCH_BYTES (Spark's 64 MB are ten thousand rows of several KB). A bound that the session has been given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def sliced(texts: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """of (a function of a list of values, for a list) over an Arrow array, STEP values at a time: Python objects are held for these only, however large the batch."""
    parts = [pa.array(of(texts.slice(i, STEP).to_pylist()), kind) for i in range(0, len(texts), STEP)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def scanned(raw: Column) -> Column:
    """Struct (error, fmt, turns, issues) of a JSON text."""

    @F.arrow_udf(SCAN)
    def of(texts: pa.Array) -> pa.Array:
        return sliced(texts, lambda ts: [scan_row(t) for t in ts], _ARROW)

    # a filter on what it finds would otherwise be pushed below, with a second pass over the texts
    return of.asNondeterministic()(raw)
