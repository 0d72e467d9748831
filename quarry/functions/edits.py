"""Edits of JSON text: each edit is an expression over the text; order and spelling of what it leaves stay."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.json import trimmed
from quarry.functions.jsontext import PIECE, alone, array_of, bound, dumps, elements, entry, first, is_array, is_object, is_string, member, members, object_of, on_strings, put, quoted, unquoted, without

#: Roles of one chat form in the other.
TO_CHAT = {"human": "user", "gpt": "assistant", "system": "system", "tool": "tool"}
TO_SHARE = {"user": "human", "assistant": "gpt", "system": "system", "tool": "tool"}
#: An ASCII word border, as patterns of the web have it.
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: An edit: the new text, or null where it does not fit.
Edit = Callable[[Column, dict], Column]


# --- patterns ---


def translated(pattern: str, flags: str = "g", replacement: str = "") -> tuple[str, str]:
    """A pattern and its replacement as regexp_replace takes them, under flags of g, i, m, s (without g: the first match only). In the replacement $$, $&, $1 and $<name> are special, a backslash is not."""
    if set(flags) - set("gimsu"):
        raise ValueError(f"flags {flags!r} cannot be translated")
    compiled = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    shift = 0 if "g" in flags else 2

    def escape(m: re.Match) -> str:
        if m[0] == r"\b":
            return BORDER
        return f"\\{int(m[0][1:]) + shift}" if m[0][1:].isdigit() and m[0] != r"\0" else m[0]

    def reference(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] == "$&":
            return "$2" if shift else "$0"
        if m[1]:
            return f"${{{m[1]}}}" if m[1] in compiled.groupindex else ""
        if m[2]:
            number = m[2] if int(m[2]) <= compiled.groups else m[2][0]
            if 0 < int(number) <= compiled.groups:
                return f"${int(number) + shift}" + (f"\\{m[2][1:]}" if len(m[2]) > len(number) else "")
        return m[0].replace("\\", r"\\").replace("$", r"\$")

    java = re.sub(r"\\(?:[1-9]\d?|.)", escape, pattern, flags=re.S)
    inline = "".join(f for f in "ims" if f in flags)
    java = (f"(?{inline})" if inline else "") + java
    if shift:  # the text in front of the first match is matched, too
        java = rf"\A((?s:.*?))({java})"
    into = re.sub(r"\$(?:\$|&|<(\w+)>|(\d{1,2}))|[\\$]", reference, replacement)
    return java, ("$1" if shift else "") + into


def replacer(pattern: str, flags: str = "g", replacement: str = "") -> Callable[[Column], Column]:
    """Replacement of a pattern in a string; see translated."""
    java, into = translated(pattern, flags, replacement)
    return lambda s: F.regexp_replace(s, F.lit(java), F.lit(into))


def _trim(s: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


# --- turns ---


def _turns(m: Column, form: str) -> Column:
    """The elements of an array of turns under a key; null if there is none."""
    return elements(member(m, form))


def _on_turns(m: Column, change: Callable[[Column, str], Column]) -> Column:
    """Members with change(members of a turn, form) in place of the members of the turns in them; null drops a turn. Other values stay."""

    def one(form: str) -> Callable[[Column], Column]:
        def turn(t: Column) -> Column:
            return F.when(is_object(t), bound(members(t), lambda m: bound(change(m, form), lambda n: F.when(n == m, t).otherwise(object_of(n))))).otherwise(t)

        def of(m: Column) -> Column:
            kept = lambda items: F.filter(F.transform(items, turn), lambda t: t.isNotNull())
            return bound(_turns(m, form), lambda items: F.when(items.isNotNull(), put(m, form, array_of(kept(items)))).otherwise(m))

        return of

    return bound(bound(m, one("messages")), one("conversations"))


def _each_turn(text: Column, change: Callable[[Column, str], Column]) -> Column:
    """An object's text with its turns changed; other text stays."""
    return F.when(is_object(text), bound(members(text), lambda m: object_of(_on_turns(m, change)))).otherwise(text)


def _has_turns(m: Column) -> Column:
    """Whether members make a chat: non-empty messages, else conversations, or the strings of the two forms with one answer."""
    text = lambda k: is_string(member(m, k))
    pairs = text("instruction") & (text("output") | text("response")) | text("prompt") & text("completion")
    full = lambda form: member(m, form) != "[]"
    return F.when(is_array(member(m, "messages")), full("messages")).when(is_array(member(m, "conversations")), full("conversations")).otherwise(pairs)


def _set(m: Column, key: Column, value: Column) -> Column:
    return F.transform(m, lambda e: F.when(e["key"] == key, F.struct(e["key"].alias("key"), e["name"].alias("name"), value.alias("value"))).otherwise(e))


def _regex_replace(text: Column, edit: dict) -> Column:
    change, scope = replacer(edit["pattern"], edit.get("flags", "g"), edit.get("replacement", "")), edit.get("scope", "all")
    wanted = {scope, {"user": "human", "assistant": "gpt"}.get(scope, scope)}

    def in_turns(chat: Column) -> Column:
        def turn(m: Column, form: str) -> Column:
            if form == "messages":
                at, role = F.lit("content"), unquoted(member(m, "role"))
                fits = F.lit(True) if scope == "all" else role == scope
            else:
                said = member(m, "role")
                role = unquoted(F.when(~said.isin("null", '""'), said).otherwise(member(m, "from")))
                at = F.when(F.exists(m, lambda e: e["key"] == "value"), "value").otherwise("content")
                fits = ~F.coalesce(is_array(member(chat, "messages")), F.lit(False)) & (F.lit(True) if scope == "all" else role.isin(*wanted))
            return F.when(F.coalesce(fits, F.lit(False)), bound(unquoted(member(m, at)), lambda s: bound(change(s), lambda n: F.when(n != s, _set(m, at, quoted(n))).otherwise(m)))).otherwise(m)

        return object_of(_on_turns(chat, turn))

    # a text without these words is no chat, and need not be taken apart to know it
    named = F.rlike(text, F.lit('"(messages|conversations|instruction|prompt)"')) | F.contains(text, F.lit("\\u"))
    chat = F.when(is_object(text) & named, bound(members(text), lambda m: F.when(_has_turns(m), in_turns(m))))
    whole = F.when(is_array(text) | is_object(text), on_strings(text, change)).otherwise(text)
    return F.coalesce(chat, whole)


def _drop_empty_turns(text: Column, edit: dict) -> Column:
    def turn(m: Column, form: str) -> Column:
        value = member(m, "content") if form == "messages" else first(m, "value", "content")
        full = lambda raw: F.when(is_string(raw), trimmed(unquoted(raw)) != "").otherwise(~raw.isin("null", "false") & ~raw.rlike(r"^-?0+(\.0+)?([eE].*)?$"))
        return F.when(bound(value, lambda raw: F.coalesce(full(raw), F.lit(False))), m)

    return _each_turn(text, turn)


def _lowercase_roles(text: Column, edit: dict) -> Column:
    keys = {"messages": ("role",), "conversations": ("from", "role")}

    def turn(m: Column, form: str) -> Column:
        for key in keys[form]:
            raw = member(m, key)
            m = F.when(is_string(raw) & (F.lower(raw) != raw), _set(m, F.lit(key), quoted(F.lower(unquoted(raw))))).otherwise(m)
        return m

    return _each_turn(text, turn)


def _drop_system(text: Column, edit: dict) -> Column:
    role = lambda m, form: unquoted(member(m, "role") if form == "messages" else first(m, "from", "role"))
    return _each_turn(text, lambda m, form: F.when(F.coalesce(role(m, form) == "system", F.lit(False)), None).otherwise(m))


# --- conversions ---


def _said(raw: Column) -> Column:
    """A content as the text of a JSON string; what is no string, as the text of its JSON."""
    return F.when(is_string(raw), raw).otherwise(quoted(F.coalesce(raw, F.lit("null"))))


def _named(raw: Column, names: dict[str, str]) -> Column:
    """The other form's name of a role, as JSON; null for other roles."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, dumps(v))]), unquoted(raw))


def _converted(text: Column, source: str, target: str, turn: Callable[[Column], Column]) -> Column:
    """text with the array under `source` as `target`, its turns as turn(members); null where that is no array of objects."""

    def of(m: Column) -> Column:
        items = _turns(m, source)
        fine = lambda x: F.when(F.forall(x, is_object), array_of(F.transform(x, lambda t: bound(members(t), turn))))
        return bound(bound(items, fine), lambda turns: F.when(turns.isNotNull(), object_of(put(without(m, source), target, turns))))

    return bound(members(text), of)


def _pair(one: str, raw_one: Column, two: str, raw_two: Column) -> Column:
    return F.concat(F.lit(f'{{"{one}":'), raw_one, F.lit(f',"{two}":'), raw_two, F.lit("}"))


def _to_chat(text: Column, edit: dict) -> Column:
    role = lambda m: F.coalesce(_named(member(m, "from"), TO_CHAT), _named(member(m, "role"), TO_CHAT), first(m, "role", "from"), F.lit('"user"'))
    return _converted(text, "conversations", "messages", lambda m: _pair("role", role(m), "content", _said(first(m, "value", "content"))))


def _to_share(text: Column, edit: dict) -> Column:
    role = lambda m: F.coalesce(_named(member(m, "role"), TO_SHARE), member(m, "role"), F.lit("null"))
    return _converted(text, "messages", "conversations", lambda m: _pair("from", role(m), "value", _said(member(m, "content"))))


def _plain(raw: Column) -> Column:
    """A value as text: nothing for null, a string's own, else its JSON."""
    return F.when(is_string(raw), unquoted(raw)).otherwise(F.coalesce(F.nullif(raw, F.lit("null")), F.lit("")))


def _dialogue(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit('{"messages":['), _pair("role", F.lit('"user"'), "content", quoted(user)), F.lit(","), _pair("role", F.lit('"assistant"'), "content", quoted(assistant)), F.lit("]}"))


def _alpaca_to_chat(text: Column, edit: dict) -> Column:
    def of(m: Column) -> Column:
        extra = member(m, "input")
        more = F.when(extra.isNull() | extra.isin("null", "false", '""', "0"), "").otherwise(F.concat(F.lit("\n\n"), _plain(extra)))
        return _dialogue(F.concat(_plain(member(m, "instruction")), more), _plain(first(m, "output", "response")))

    return bound(members(text), lambda m: F.when(m.isNotNull(), of(m)))


def _completion_to_chat(text: Column, edit: dict) -> Column:
    return bound(members(text), lambda m: F.when(m.isNotNull(), _dialogue(_plain(member(m, "prompt")), _plain(member(m, "completion")))))


# --- paths ---


def steps(path: str) -> list[str | int]:
    """Keys and indexes of a path like $.a[0]["b c"]."""
    out: list[str | int] = []
    at = 1
    token = re.compile(r'\.([A-Za-z_$][\w$]*)|\[(\d+)\]|\["((?:[^"\\]|\\.)*)"\]')
    while at < len(path):
        m = token.match(path, at)
        if not m:
            raise ValueError(f"no path: {path!r}")
        out.append(m[1] if m[1] is not None else int(m[2]) if m[2] is not None else json.loads(f'"{m[3]}"'))
        at = m.end()
    return out


def _at(text: Column, way: list[str | int], change: Callable[[Column], Column]) -> Column:
    """text with change(part) in place of the part at the end of the way; null where there is no such part, or change gives null."""
    if not way:
        return change(text)
    step, rest = way[0], way[1:]
    if isinstance(step, int):
        inner = lambda x: bound(_at(F.get(x, F.lit(step)), rest, change), lambda n: F.when(n.isNotNull(), array_of(F.transform(x, lambda v, i: F.when(i == step, n).otherwise(v)))))
        return bound(elements(text), lambda x: F.when(F.size(x) > step, inner(x)))
    inner = lambda m: bound(_at(member(m, step), rest, change), lambda n: F.when(n.isNotNull(), object_of(put(m, step, n))))
    return bound(members(text), lambda m: F.when(F.exists(m, lambda e: e["key"] == step), inner(m)))


def _has(m: Column, key: str) -> Column:
    return F.exists(m, lambda e: e["key"] == key)


def _rename_at(text: Column, edit: dict) -> Column:
    way, key = steps(edit["path"]), edit["key"]
    if not way or isinstance(way[-1], int):
        return F.lit(None).cast("string")
    named = lambda e: F.when(e["key"] == way[-1], entry(key, e["value"])).otherwise(e)
    return _at(text, way[:-1], lambda box: bound(members(box), lambda m: F.when(_has(m, way[-1]) & ~_has(m, key), object_of(F.transform(m, named)))))


def _remove_at(text: Column, edit: dict) -> Column:
    way = steps(edit["path"])
    if not way:
        return F.lit(None).cast("string")
    last = way[-1]

    def change(box: Column) -> Column:
        if isinstance(last, int):
            return bound(elements(box), lambda x: F.when(F.size(x) > last, array_of(F.filter(x, lambda v, i: i != last))))
        return bound(members(box), lambda m: F.when(_has(m, last), object_of(without(m, last))))

    return _at(text, way[:-1], change)


def _append_item(text: Column, edit: dict) -> Column:
    return _at(text, steps(edit["path"]), lambda box: bound(elements(box), lambda x: F.when(x.isNotNull(), array_of(F.concat(x, F.array(F.lit("null")))))))


def _add_key(text: Column, edit: dict) -> Column:
    key = edit["key"]
    return _at(text, steps(edit["path"]), lambda box: bound(members(box), lambda m: F.when(~_has(m, key), object_of(put(m, key, F.lit("null"))))))


# --- keys ---


def _on_members(change: Callable[[Column, dict], Column]) -> Edit:
    """An edit of an object's members; other values stay, and an object that the change leaves alone keeps its text."""
    return lambda text, edit: F.when(is_object(text), bound(members(text), lambda m: bound(change(m, edit), lambda n: F.when(n == m, text).otherwise(object_of(n))))).otherwise(text)


def _rename_key(m: Column, edit: dict) -> Column:
    if edit["from"] == edit["to"]:
        return m
    return F.when(_has(m, edit["from"]), without(put(m, edit["to"], member(m, edit["from"])), edit["from"])).otherwise(m)


#: What an edit {"op": name, ...} does.
OPS: dict[str, Edit] = {
    "regex-replace": _regex_replace,
    "set-key": _on_members(lambda m, e: put(m, e["key"], F.lit(dumps(e["value"])))),
    "remove-key": _on_members(lambda m, e: without(m, e["key"])),
    "rename-key": _on_members(_rename_key),
    "drop-empty-turns": _drop_empty_turns,
    "lowercase-roles": _lowercase_roles,
    "trim-whitespace": lambda text, e: on_strings(text, _trim),
    "drop-system": _drop_system,
    "sharegpt-to-openai": _to_chat,
    "openai-to-sharegpt": _to_share,
    "alpaca-to-openai": _alpaca_to_chat,
    "completion-to-openai": _completion_to_chat,
    "set-at": lambda text, e: _at(text, steps(e["path"]), lambda _: F.lit(dumps(e["value"]))),
    "rename-at": _rename_at,
    "remove-at": _remove_at,
    "append-item": _append_item,
    "add-key": _add_key,
}


def check(edits: list[dict]) -> list[dict]:
    """The edits, if all are known and their patterns and paths can be read."""
    for e in edits:
        if e.get("op") not in OPS:
            raise ValueError(f"no edit {e.get('op')!r}")
        if e["op"] == "regex-replace":
            translated(e["pattern"], e.get("flags", "g"), e.get("replacement", ""))
        if "path" in e:
            steps(e["path"])
    return edits


def edited(text: Column, edit: dict) -> Column:
    """The JSON text after one edit; null where it does not fit. Null and JSON null pass through (but set-at)."""
    value = OPS[check([edit])[0]["op"]](text, edit)
    return value if edit["op"] == "set-at" else F.when(text == "null", text).otherwise(value)


def apply_edits(df: DataFrame, json_col: str, edits: list[dict], into: str = "edited") -> DataFrame:
    """df with `into` added, a struct (json, refused, plain) of a column of minified JSON texts: the text after the edits in order, how many did not fit, and the text without them.

    What an edit leaves keeps its order and spelling. Edits of strings take any depth; the others
    refuse a text that Spark's JSON reader refuses (over 1,000 levels), which then stays as it is.
    """
    none = F.lit(0).cast("long")
    out = df.withColumn(into, F.struct(F.col(json_col).alias("json"), none.alias("refused"), F.col(json_col).alias("plain")))
    now = F.col(into)
    for e in check(edits):  # a projection for each edit keeps the expressions small
        out = out.withColumn("__edited", alone(edited(now["json"], e)))
        refused = F.when(F.col("__edited").isNull() & now["json"].isNotNull(), 1).otherwise(0)
        out = out.withColumn(into, F.struct(F.coalesce("__edited", now["json"]).alias("json"), (now["refused"] + refused).cast("long").alias("refused"), now["plain"].alias("plain"))).drop("__edited")
    return out


def redact_json(text: Column, enabled: str | list[str] | None = None) -> Column:
    """Struct (json, matches): the JSON text with personal data replaced in every string value, at any depth, keys untouched."""
    from quarry.operators.pii import redacted_inside

    def one(p: Column) -> Column:
        value = is_string(p) & ~F.endswith(p, F.lit(":"))
        found = lambda s: bound(redacted_inside(s, enabled), lambda r: F.struct(F.when(r["matches"] > 0, quoted(r["text"])).otherwise(p).alias("piece"), r["matches"].alias("n")))
        return F.when(value, bound(unquoted(p), found)).otherwise(F.struct(p.alias("piece"), F.lit(0).cast("long").alias("n")))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE)), one)
    total = lambda ps: F.coalesce(F.aggregate(ps, F.lit(0).cast("long"), lambda n, p: n + p["n"]), F.lit(0)).cast("long")
    return alone(bound(pieces, lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: p["piece"]), "").alias("json"), total(ps).alias("matches"))))
