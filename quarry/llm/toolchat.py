"""Chat formatting: linking tool calls to results (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.json import json_type, strict_variant, utf16_length
from quarry.llm.text import carried, unpacked
from quarry.plans.lineage import cut

#: What a schema may say of a field: type (JSON type name), required, minLength, maxLength, minimum, maximum.
Schema = dict[str, dict[str, object]]


def argument_errors(name: Column, v: Column, keys: Column, schemas: dict[str, Schema]) -> Column:
    """Array of `field:rule` that a call's arguments (a variant, and its top-level keys) break, in the schema's order; empty if none.

    `tool:unknown` for a name without schema, `arguments:type` if they are not one JSON object, `field:unexpected` for others.
    """
    is_object = json_type(v) == "object"
    out = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("tool:unknown")))
    for tool, fields in schemas.items():
        rules = []
        for field, rule in fields.items():
            at = F.try_variant_get(v, f"$['{field}']", "variant")
            kind = json_type(at)
            text, number = F.try_variant_get(v, f"$['{field}']", "string"), F.try_variant_get(v, f"$['{field}']", "double")
            if rule.get("required"):
                rules.append(F.when(at.isNull(), f"{field}:required"))
            if "type" in rule:
                fits = kind.isin("integer", "number") if rule["type"] == "number" else kind == rule["type"]
                rules.append(F.when(at.isNotNull() & ~fits, f"{field}:type"))
            for key, broken in (("minLength", lambda n: utf16_length(text) < n), ("maxLength", lambda n: utf16_length(text) > n)):
                if key in rule:
                    rules.append(F.when((kind == "string") & broken(rule[key]), f"{field}:{key}"))
            for key, broken in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
                if key in rule:
                    rules.append(F.when(kind.isin("integer", "number") & broken(rule[key]), f"{field}:{key}"))
        extra = F.array_except(keys, F.array(*[F.lit(f) for f in fields]))
        rules_ = F.concat(F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>"), F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(":unexpected"))))
        out = out.when(name == tool, F.when(is_object, rules_).otherwise(F.array(F.lit("arguments:type"))))
    return out


def parse_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with part, content, call_id, name, arguments and after read from a message's text where that is a JSON object:

    {"id", "name", "arguments"} is a call, {"tool_calls": [...]} several, as one row each (part counts from 0), where an entry is such a call or has
    name and arguments under "function"; {"tool_call_id", "content"} is a result; any other text is plain content. arguments is JSON
    text; those given as a string of JSON are read as that JSON. after: identifier of a call whose result a call needs, if it names one.
    """
    shaped = F.col(f"`{text_col}`").rlike(r"^\s*\{")
    rows = cut(df.select(carried(df), F.when(shaped, strict_variant(F.col(f"`{text_col}`"))).alias("v")), "messages")
    get = lambda v, *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    none = F.lit(None).cast("variant")
    rows = rows.select("row", "v", F.posexplode_outer(F.when(F.size(calls) > 0, calls).otherwise(F.array(F.coalesce(F.col("v"), none)))).alias("part", "c"))
    result = get(F.col("v"), "$.tool_call_id").isNotNull()
    id_, name = get(F.col("c"), "$.id"), get(F.col("c"), "$.name", "$.function.name")
    call = id_.isNotNull() & name.isNotNull() & ~result
    given = F.coalesce(F.try_variant_get("c", "$.arguments", "variant"), F.try_variant_get("c", "$.function.arguments", "variant"))
    arguments = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string")).otherwise(F.to_json(given))
    added = {
        "part": F.col("part"),
        "content": F.when(result, get(F.col("v"), "$.content")).when(~call, F.col("row")[text_col]),
        "call_id": F.when(result, get(F.col("v"), "$.tool_call_id")).when(call, id_),
        "name": F.when(call, name),
        "arguments": F.when(call, arguments),
        "after": F.when(call, get(F.col("c"), "$.after")),
    }
    return unpacked(rows, df, added)


def call_order(calls: DataFrame) -> DataFrame:
    """(c, i, at): the place (turn, step) of each call of calls (c, i, turn, result_turn, after), which names each identifier of a conversation once.

    A call comes at its own turn, and behind the result of the call that it needs; that result comes at its turn, and behind
    its call. Chains are followed by pointer doubling: in each round a call takes the latest place that its pointer's chain asks for, and
    the pointer's pointer, so the rounds are the logarithm of the longest conversation. A call that is not there is not waited for; calls on or behind a circle wait for
    nothing, and keep their turn.
    """
    place = lambda turn, step: F.struct(turn.alias("turn"), step.cast("long").alias("step"))
    needed = calls.select(F.col("c").alias("nc"), F.col("i").alias("ni"), "result_turn")
    at = calls.select("c", "i", "turn", "after").join(needed, (F.col("c") == F.col("nc")) & (F.col("after") == F.col("ni")), "left")
    answered = F.col("result_turn").isNotNull()
    behind = F.when(answered, place(F.col("result_turn"), F.lit(2)))
    own = place(F.col("turn"), F.lit(0))
    at = cut(at.select("c", "i", own.alias("own"), F.greatest(own, behind).alias("at"), F.col("ni").alias("to"), F.when(answered, 2).otherwise(1).cast("long").alias("far")), "calls")
    most = calls.groupBy("c").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        if at.where("to is not null").isEmpty():
            break
        other = at.select(F.col("c").alias("nc"), F.col("i").alias("ni"), F.col("at").alias("there"), F.col("to").alias("next"), F.col("far").alias("more"))
        joined = at.join(other, (F.col("c") == F.col("nc")) & (F.col("to") == F.col("ni")), "left")
        asked = F.when(F.col("there").isNotNull(), place(F.col("there.turn"), F.col("there.step") + F.col("far")))
        at = cut(joined.select("c", "i", "own", F.greatest("at", asked).alias("at"), F.col("next").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "calls")
    return at.select("c", "i", F.when(F.col("to").isNull(), F.col("at")).otherwise(F.col("own")).alias("at"))


def link_calls(messages: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """Link tool results to calls, order them and serialise each message.

    messages: conv_id, turn, part, role, content, call_id (of calls and results), name,
    arguments (JSON text) and after (calls only); see parse_messages. Returned for each row: conv_id, turn, part, kind (message, call or
    result), call_id, linked, errors, order_turn, order_step and json.

    Results are joined by hash of (conv_id, call_id) to the first call of that identifier; a later call of the
    same identifier is `id:repeated` and links to nothing. The topological order is (order_turn, order_step, turn, part): a result
    comes behind its call, and a call behind the result that it needs (see call_order); it is given as keys, so
    no conversation is brought together. json is canonical: sorted keys, no white space.

    A call is linked if a result names it, a result if its call exists; unlinked ones keep their turn.
    Null texts are JSON null. Null conv_id or call_id link to nothing. Repeated rows come back each. Other columns are not read. Empty table: no rows.
    """
    kind = F.when(F.col("call_id").isNull(), "message").when(F.col("name").isNotNull(), "call").otherwise("result")
    v = F.when(F.col("arguments").isNotNull(), strict_variant(F.col("arguments")))
    rows = cut(messages.select("conv_id", "turn", "part", "role", "content", "call_id", "name", "arguments", "after", kind.alias("kind"), v.alias("v")), "rows")
    first = F.min(F.struct("turn", "part", "after")).alias("f")
    calls = rows.where("kind = 'call'").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(first)
    results = rows.where("kind = 'result'").groupBy(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri")).agg(F.min("turn").alias("result_turn"))
    linked_calls = calls.join(results, (F.col("c") == F.col("rc")) & (F.col("i") == F.col("ri")), "left").where("c is not null")
    known = cut(linked_calls.select("c", "i", "f.turn", "f.part", "f.after", "result_turn"), "known")
    known = known.select("c", "i", F.col("turn").alias("call_turn"), F.col("part").alias("call_part"), "result_turn").join(call_order(known), ["c", "i"])
    out = rows.join(known, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    repeated = is_call & F.coalesce((F.col("turn") != F.col("call_turn")) | (F.col("part") != F.col("call_part")), F.lit(False))
    linked = F.when(repeated, F.lit(False)).when(is_call, F.col("result_turn").isNotNull()).when(is_result, F.col("call_turn").isNotNull())
    found = argument_errors(F.col("name"), F.col("v"), F.json_object_keys("arguments"), schemas)
    errors = F.when(is_call, F.concat(F.when(repeated, F.array(F.lit("id:repeated"))).otherwise(F.array().cast("array<string>")), found))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(text(c))
    arguments = F.coalesce(F.to_json("v"), F.lit("null"))
    body = (
        F.when(is_call, F.concat(F.lit('{"role":'), quoted("role"), F.lit(',"tool_call":{"arguments":'), arguments, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit("}}")))
        .when(is_result, F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"role":"tool","tool_call_id":'), quoted("call_id"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"role":'), quoted("role"), F.lit("}")))
    )
    own = F.struct(F.col("turn"), F.lit(0).cast("long").alias("step"))
    behind = F.struct(F.col("at.turn").alias("turn"), (F.col("at.step") + 1).alias("step"))
    at = F.when(is_call & ~repeated & F.col("at").isNotNull(), F.col("at")).when(is_result & F.col("at").isNotNull(), F.greatest(own, behind)).otherwise(own)
    out = out.select("conv_id", "turn", "part", "kind", "call_id", linked.alias("linked"), F.array_join(errors, ",").alias("errors"), at.alias("place"), body.alias("json"))
    return out.select("conv_id", "turn", "part", "kind", "call_id", "linked", "errors", F.col("place.turn").alias("order_turn"), F.col("place.step").alias("order_step"), "json")
