"""Formats, turns, tokens, lint, conversion and edits on hand-made rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import edits, features
from quarry.functions.json import json_type, strict_variant
from quarry.operators import aggregates, annotate, audit, compare, dedup, filters, jsonops, lint, pii, split, transform, validate

ROWS = [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"text":"a"},"b",{"x":1}]}]}', "openai-chat", 10),
    ('{"messages":[{"role":"critic","content":null}]}', "openai-chat-loose", 4),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":{"a":1}}]}', "sharegpt", 11),
    ('{"chosen":null,"rejected":"x"}', "preference-pair", 8),
    ('{"instruction":"i","input":"in","output":"o"}', "alpaca", 11),
    ('{"prompt":"p","completion":"c"}', "completion", 10),
    ('{"text":"t","a":1,"b":2}', "text", 6),
    ('{"text":"t","a":1,"b":2,"c":3}', "object", 8),
    ('{"question":"q","a":"a"}', "qa", 6),
    ("[1]", "array", 1),
    ("5", "unknown", 1),
    ("null", "unknown", 1),
    ("{bad", "parse-error", 1),
    ('{"a":1} junk', "parse-error", 3),
    ("1] junk [2", "parse-error", 3),
    ("NaN", "parse-error", 1),
    ('{"a":01}', "parse-error", 2),
    ('{"messages":[]}', "object", 4),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "row_id long, raw string")
    return features.rows_table(df).cache()


def by_id(df, *cols):
    return {r[0]: r[1] if len(cols) == 1 else tuple(r[1:]) for r in df.select("row_id", *cols).collect()}


def test_formats_and_tokens(rows):
    got = by_id(rows, "fmt", features.row_tokens().alias("n"))
    assert got == {i: (f, n) for i, (_, f, n) in enumerate(ROWS)}


def test_turns(rows):
    got = by_id(rows, F.to_json("turns"))
    assert json.loads(got[0])[1]["content"] == "a\nb\n"
    assert json.loads(got[2])[1] == {"role": "gpt", "content": '{"a":1}'}
    assert json.loads(got[4])[0]["content"] == "i\n\nin"


def test_utf16_and_types(spark):
    df = spark.createDataFrame([("1.0",), ("1.5",), ('"x"',), ("true",), ("{}",), ("[]",), ("null",)], "s string")
    assert [r[0] for r in df.select(json_type(strict_variant(F.col("s")))).collect()] == ["integer", "number", "string", "boolean", "object", "array", "null"]
    one = features.rows_table(spark.createDataFrame([(1, '{"text": "a😀b"}')], "row_id long, raw string"))
    assert one.first()["char_count"] == len('{"text":"a😀b"}') + 1


def test_lint(rows):
    got = {k: [i["code"] for i in v] for k, v in by_id(lint.lint(rows), "issues").items()}
    assert got[1] == ["empty-content", "no-assistant", "very-short"]
    assert got[3] == ["pref-empty"]
    assert got[12] == ["parse-error"]
    assert 0 not in got and 4 not in got
    assert by_id(lint.exclude_lint_errors(rows), "excluded")[3]


def test_more_lint(spark):
    raw = [
        '{"messages":[{"role":"user","content":" \\u00a0"},{"role":"user","content":"x"},{"role":"assistant","content":"long enough answer"}]}',
        '{"chosen":" a lot of text here ","rejected":"a lot of text here"}',
        '{"instruction":" ","output":"","response":"x"}',
    ]
    df = features.rows_table(spark.createDataFrame(list(enumerate(raw)), "row_id long, raw string"))
    got = {k: [(i["code"], i["turn"]) for i in v] for k, v in by_id(lint.lint(df), "issues").items()}
    assert got[0] == [("empty-content", 0), ("consecutive-role", 1)]
    assert got[1] == [("pref-equal", None)]
    assert [c for c, _ in got[2]] == ["empty-instruction", "empty-output"]


def test_filters_and_counts(rows):
    assert {r[0] for r in rows.where(filters.search("HUMAN")).select("row_id").collect()} == {2}
    assert {r[0] for r in rows.where(filters.has_keys(["a", "b"])).select("row_id").collect()} == {6, 7}
    assert rows.where(filters.token_range(None, 1)).count() == 5
    assert aggregates.profile(rows).where("place = 1").first()["fmt"] == "parse-error"
    assert by_key(aggregates.key_counts(rows))["a"] == 3


def by_key(df):
    return {r[0]: r[1] for r in df.collect()}


def test_summarize_rule(spark):
    got = aggregates.summarize(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x long"), "x").first()
    assert (got["p50"], got["p90"], got["count"], got["sum"]) == (3, 4, 4, 10)
    empty = aggregates.summarize(spark.createDataFrame([], "x long"), "x").first()
    assert empty["count"] == 0 and empty["p50"] == 0
    same = aggregates.bucketize(spark.createDataFrame([(5,), (5,)], "x long"), "x", 4).collect()
    assert [tuple(r) for r in same] == [(0, 5.0, 5.0, 2)]
    assert aggregates.bucketize(spark.createDataFrame([], "x long"), "x", 4).count() == 0


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,2)"])
def test_percentiles_are_exact(spark, kind, monkeypatch):
    """Brackets by sketches, down to a handful of values: groups of one value, with a heavy value at a percentile, with NaN, without a name, and one that holds most rows."""
    monkeypatch.setattr(aggregates, "FEW", 150)
    monkeypatch.setattr(aggregates, "SKETCH", 16)
    monkeypatch.setattr(aggregates, "MARGIN", 0.05)
    rng = __import__("random").Random(5)
    groups = {"big": [rng.randrange(-(10**6), 10**6) for _ in range(4000)], "one": [3], "same": [4] * 500, "edge": [4] * 250 + list(range(5, 255)), None: [rng.randrange(50) for _ in range(300)]}
    if kind == "double":
        groups["nan"] = [1.5, float("inf"), float("-inf")] * 10 + [float("nan")] * 20
    made = [(g, str(v)) for g, vs in groups.items() for v in vs] + [("big", None), ("nulls", None)]
    df = spark.createDataFrame(made, "g string, s string").select("g", F.col("s").cast(kind).alias("x"))
    got = {r["g"]: r for r in aggregates.summarize(df, "x", ["g"]).collect()}
    assert set(got) == set(groups)
    plain = lambda v: "nan" if v != v else float(v)
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (v != v, v if v == v else 0))
        want = [vs[min(len(vs) - 1, int(p * len(vs)))] for p in (0.5, 0.9, 0.99)]
        assert [plain(got[g][c]) for c in ("p50", "p90", "p99", "min", "max", "count")] == [plain(v) for v in (*want, vs[0], vs[-1], len(vs))]
    every = aggregates.summarize(df.where("g = 'big'"), "x").first()
    assert all(every[c] == got["big"][c] for c in ("p50", "p90", "p99", "sum", "mean"))


def test_score(spark):
    one = spark.range(1)
    got = one.select(aggregates.quality_score(F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(1.0)), aggregates.score_tier(F.lit(80)), aggregates.score_tier(F.lit(60)), aggregates.score_tier(F.lit(59))).first()
    assert tuple(got) == (78, "good", "warn", "bad")


def test_pii(spark):
    text = "a@b.co 2024-01-15 é1.2.3.4 card 4111 1111 1111 1111 ssn 123-45-6789 key sk-abcdefghijklmnopqrstu"
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(F.explode(pii.scan_positions(F.col("t"))).alias("f")).select("f.*").collect()
    for r in found:
        assert text[r["start"] : r["end"]] == r["match"]
    assert [r["id"] for r in found] == ["email", "phone", "phone", "phone", "ipv4", "cc", "ssn", "apikey"]
    assert df.select(pii.redact(F.col("t"), ["cc", "ssn"])).first()[0] == text.replace("4111 1111 1111 1111 ", "<CC>").replace("123-45-6789", "<SSN>")
    left = df.select(pii.redact(F.col("t")).alias("t")).select(pii.scan(F.col("t"))).first()[0]
    assert left == []
    kept = df.select(edits.redact_json(F.to_json(F.struct("t")), "strict").alias("r")).first()["r"]
    assert kept["matches"] == 6 and "<PHONE>" in kept["json"] and "<APIKEY>" in kept["json"]


def test_cards(spark):
    assert [pii.luhn_ok(x) for x in ("4111111111111111", "4111111111111112", "411111111111")] == [True, False, False]
    text = "pay 4111111111111111; ref x4111111111111111, not 4111111111111112"
    want = text.replace("pay 4111111111111111", "pay <CC>")
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(pii.redact(F.col("t"), ["cc"])).collect()] == [want, None]
    assert json.loads(df.select(edits.redact_json(F.to_json(F.struct("t")), ["cc"])["json"]).first()[0])["t"] == want


def test_patterns_need_their_guard():
    """A match of a pattern always holds what its guard asks for."""
    samples = ["a.b+c@d-e.org", "+1 234 567 8901", "1234567890", "10.2.33.4", "fe80:0:0:1", "4111-1111-1111-1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "123-45-6789"]
    samples += ["sk-" + "a" * 20, "sk_live_" + "a" * 16, "AIza" + "a" * 30, "ghp_" + "a" * 30, "xoxb-" + "a" * 10, "AKIA" + "A" * 16, "eyJabcdefgh.abcd.efgh", "https://x.y/z?q"]
    import re

    hit = set()
    for t in samples:
        for n, (p, _) in pii.PATTERNS.items():
            if re.search(p, t, re.ASCII):
                hit.add(n)
                assert pii._NEEDS[n].search(t), (n, t)
    assert hit == set(pii.PATTERNS)


def apply(spark, text, ops):
    df = spark.createDataFrame([(text,)], "j string")
    return edits.apply_edits(df, "j", ops).select("edited.*").first()


@pytest.mark.parametrize(
    ("before", "ops", "after"),
    [
        ('{"b":1,"a":2}', [{"op": "set-key", "key": "c", "value": [1]}], '{"b":1,"a":2,"c":[1]}'),
        ('{"b":1,"a":2}', [{"op": "remove-key", "key": "b"}], '{"a":2}'),
        ('{"b":1,"a":2,"c":3}', [{"op": "rename-key", "from": "b", "to": "c"}], '{"a":2,"c":1}'),
        ('{"b":1}', [{"op": "rename-key", "from": "b", "to": "b"}], '{"b":1}'),
        ('{"messages":[{"role":"user","content":" "},{"role":"A","content":"x"}]}', [{"op": "drop-empty-turns"}, {"op": "lowercase-roles"}], '{"messages":[{"role":"a","content":"x"}]}'),
        ('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}', [{"op": "drop-system"}], '{"messages":[{"role":"user","content":"u"}]}'),
        ('{"t":" a  \\n\\n\\n\\nb "}', [{"op": "trim-whitespace"}], '{"t":"a\\n\\nb"}'),
        ('{"conversations":[{"from":"human","value":"aba"},{"from":"gpt","value":"aba"}]}', [{"op": "regex-replace", "pattern": "a", "replacement": "$&$&", "flags": "", "scope": "user"}], '{"conversations":[{"from":"human","value":"aaba"},{"from":"gpt","value":"aba"}]}'),
        ('{"x":["a",{"y":"a"}]}', [{"op": "regex-replace", "pattern": "(?<n>A)", "replacement": "<$<n>>\\\\", "flags": "gi"}], '{"x":["<a>\\\\\\\\",{"y":"<a>\\\\\\\\"}]}'),
        ('{"prompt":"p","completion":"a"}', [{"op": "regex-replace", "pattern": "a", "replacement": "z"}], '{"prompt":"p","completion":"a"}'),
        ('{"instruction":"i","input":"x","output":"o","k":1}', [{"op": "alpaca-to-openai"}], '{"messages":[{"role":"user","content":"i\\n\\nx"},{"role":"assistant","content":"o"}]}'),
        ('{"prompt":"p","completion":"c"}', [{"op": "completion-to-openai"}], '{"messages":[{"role":"user","content":"p"},{"role":"assistant","content":"c"}]}'),
        ('{"k":1,"conversations":[{"from":"human","value":"q"},{"role":"x","content":{"a":1}}]}', [{"op": "sharegpt-to-openai"}], '{"k":1,"messages":[{"role":"user","content":"q"},{"role":"x","content":"{\\"a\\":1}"}]}'),
        ('{"a":[1,{"b c":2}]}', [{"op": "set-at", "path": '$.a[1]["b c"]', "value": None}], '{"a":[1,{"b c":null}]}'),
        ('{"a":1,"b":2}', [{"op": "rename-at", "path": "$.a", "key": "z"}], '{"z":1,"b":2}'),
        ('{"a":[1,2]}', [{"op": "remove-at", "path": "$.a[0]"}, {"op": "append-item", "path": "$.a"}, {"op": "add-key", "path": "$", "key": "n"}], '{"a":[2,null],"n":null}'),
    ],
)
def test_edits(spark, before, ops, after):
    assert tuple(apply(spark, before, ops)) == (after, 0, before)


@pytest.mark.parametrize(
    ("before", "ops", "after"),
    [
        ('{"a":1.50,"b":[1e400,12345678901234567890123,{"z":"t","y":-0.0}]}', [{"op": "set-key", "key": "b2", "value": "x"}, {"op": "remove-key", "key": "none"}], '{"a":1.50,"b":[1e400,12345678901234567890123,{"z":"t","y":-0.0}],"b2":"x"}'),
        ('{"k [":["]x","[a","\\"[b"],"k2":"]"}', [{"op": "rename-key", "from": "k2", "to": "z"}], '{"k [":["]x","[a","\\"[b"],"z":"]"}'),
        ('{"é":{"k":"a"},"a":"\\u00e9a"}', [{"op": "regex-replace", "pattern": "a", "replacement": "b"}], '{"é":{"k":"b"},"a":"éb"}'),
        ('{"t":"a1 b22"}', [{"op": "regex-replace", "pattern": "([a-z])(\\d+)", "replacement": "$2$1$3$$", "flags": "g"}], '{"t":"1a$3$ 22b$3$"}'),
        ('{"t":"ab xyxy"}', [{"op": "regex-replace", "pattern": "(x)(y)\\1", "replacement": "<$2>", "flags": ""}], '{"t":"ab <y>y"}'),
        ('{"t":"éa a_ a"}', [{"op": "regex-replace", "pattern": "\\ba\\b", "replacement": "Z"}], '{"t":"éZ a_ Z"}'),
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"a","n":1},5]}', [{"op": "regex-replace", "pattern": "a", "replacement": "b", "scope": "assistant"}], '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","n":1},5]}'),
        ('{"messages":[],"t":"a"}', [{"op": "regex-replace", "pattern": "a", "replacement": "b", "scope": "user"}], '{"messages":[],"t":"b"}'),
        ('{"messages":[{"content":0},{"content":"x"},{"content":null},{"content":[]}]}', [{"op": "drop-empty-turns"}], '{"messages":[{"content":"x"},{"content":[]}]}'),
        ('{"conversations":[{"from":"SYSTEM","value":"s"},{"from":"Human","value":"u"}]}', [{"op": "lowercase-roles"}, {"op": "drop-system"}], '{"conversations":[{"from":"human","value":"u"}]}'),
        ('{"messages":[{"role":"user","content":null},{"role":"tool","content":[1]},{"content":"q"}],"k":{}}', [{"op": "openai-to-sharegpt"}], '{"k":{},"conversations":[{"from":"human","value":"null"},{"from":"tool","value":"[1]"},{"from":null,"value":"q"}]}'),
        ('"a"', [{"op": "set-key", "key": "k", "value": 1}, {"op": "regex-replace", "pattern": "a", "replacement": "b"}], '"a"'),
        ("null", [{"op": "remove-key", "key": "k"}, {"op": "set-at", "path": "$", "value": {"a": 1}}], '{"a":1}'),
        ('{"a":1,"a":2,"b":3}', [{"op": "remove-key", "key": "b"}], '{"a":2}'),
    ],
)
def test_edits_keep_the_rest(spark, before, ops, after):
    """Order, numbers and escapes of what is not edited; scopes, references, odd turns and values that are no objects."""
    assert tuple(apply(spark, before, ops)) == (after, 0, before)


def test_edits_of_long_strings(spark):
    long = "word \\n é " * 3000
    before, key = f'{{"messages":[{{"role":"user","content":"{long}"}}],"{"k" * 500}":1}}', "k" * 500
    assert apply(spark, before, [{"op": "openai-to-sharegpt"}])["json"] == f'{{"{key}":1,"conversations":[{{"from":"human","value":"{long}"}}]}}'


def test_edits_never_crash(spark):
    """Deep values and long numbers: strings are edited at any depth; edits that would take such a value apart refuse it, and it stays."""
    deep, digits = "[" * 5000 + '"a"' + "]" * 5000, "9" * 5000
    for text, changed in ((f'{{"x":{deep}}}', f'{{"x":{deep}}}'.replace('"a"', '"b"')), (f'{{"x":{digits},"y":"a"}}', f'{{"x":{digits},"y":"b"}}'), ('{"x":1e400,"y":"a"}', '{"x":1e400,"y":"b"}')):
        assert tuple(apply(spark, text, [{"op": "trim-whitespace"}])) == (text, 0, text)
        one = apply(spark, text, [{"op": "set-key", "key": "z", "value": 1}])
        assert tuple(one)[:2] in ((text[:-1] + ',"z":1}', 0), (text, 1))
        assert apply(spark, text, [{"op": "remove-at", "path": "$.none"}])["refused"] == 1
        found = apply(spark, text, [{"op": "regex-replace", "pattern": "a", "replacement": "b"}])
        assert tuple(found)[:2] in ((changed, 0), (text, 1))
    assert tuple(apply(spark, '{"x":1e400}', [{"op": "set-key", "key": "z", "value": 1}]))[:2] == ('{"x":1e400,"z":1}', 0)
    one = spark.createDataFrame([(f'{{"x":{deep}}}'.replace('"a"', '"me@a.org"'),)], "j string").select(edits.redact_json(F.col("j")).alias("r")).first()["r"]
    assert one["matches"] == 1 and "<EMAIL>" in one["json"]
    many = spark.createDataFrame([(None,), ('{"a":[1]}',), ("[1,2]",), ("5",)], "j string")
    many = edits.apply_edits(many, "j", [{"op": "remove-at", "path": "$.a[0]"}, {"op": "append-item", "path": "$.a"}]).select("edited.*")
    assert [tuple(r)[:2] for r in many.collect()] == [(None, 0), ('{"a":[null]}', 0), ("[1,2]", 2), ("5", 2)]


def test_edits_and_redaction_run_in_the_jvm(spark):
    import contextlib
    import io

    out = io.StringIO()
    df = spark.createDataFrame([("{}",)], "j string")
    with contextlib.redirect_stdout(out):
        for op in edits.OPS:
            edits.apply_edits(df, "j", [{"op": op, "path": "$.a", "key": "k", "value": 1, "from": "a", "to": "b", "pattern": "x"}]).explain()
        df.select(edits.redact_json(F.col("j")), pii.redact(F.col("j"))).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def test_refused_edits(spark):
    assert apply(spark, '{"a":1,"b":2}', [{"op": "rename-at", "path": "$.a", "key": "b"}, {"op": "remove-at", "path": "$"}])["refused"] == 2
    with pytest.raises(ValueError):
        edits.check([{"op": "eval"}])
    with pytest.raises(ValueError):
        edits.check([{"op": "regex-replace", "pattern": "a", "flags": "y"}])
    assert transform.read_pipeline(transform.write_pipeline([{"op": "drop-system"}])) == [{"op": "drop-system"}]
    with pytest.raises(ValueError):
        transform.read_pipeline('{"format":"x","schemaVersion":1,"ops":[]}')


def test_apply_and_convert(rows):
    counts, _ = transform.dry_run(rows, [{"op": "set-key", "key": "a", "value": 1}])
    assert tuple(counts.first()) == (8, 0)
    done = by_id(transform.apply_all(rows, [{"op": "remove-key", "key": "text"}]), "raw", "dirty")
    assert done[6] == ('{"a":1,"b":2}', True) and not done[0][1]
    assert tuple(transform.convert_counts(rows, "any-to-openai").first()) == (3, 15)
    assert {r["fmt"] for r in transform.convert(rows, "any-to-openai").collect()} == {"sharegpt", "alpaca", "completion"}


def test_nodes_and_diff(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b c":"x"}],"t":1}', '{"a":[1,{"b c":"y"},3],"t":"1","n":{}}')], "row_id long, p string, q string")
    pairs = df.select("row_id", F.parse_json("p").alias("a"), F.parse_json("q").alias("b"))
    paths = {r["path"]: r["type"] for r in jsonops.explode_nodes(pairs.select("row_id", F.col("a").alias("v")), 4).collect()}
    assert paths == {"$": "object", "$.a": "array", "$.a[0]": "integer", "$.a[1]": "object", '$.a[1]["b c"]': "string", "$.t": "integer"}
    got = {(r["path"], r["kind"]) for r in jsonops.diff_json(pairs).collect()}
    assert got == {('$.a[1]["b c"]', "change"), ("$.a[2]", "add"), ("$.t", "change"), ("$.n", "add")}
    assert pairs.select(jsonops.get_path(F.col("a"), '$.a[1]["b c"]')).first()[0] == '"x"'


@pytest.mark.parametrize(
    ("schema", "value", "found"),
    [
        ({"const": {"a": 1}}, '{"a":2}', ['$ expected const {"a":1}']),
        ({"enum": [1, "x"]}, '"y"', ["$ not in enum"]),
        ({"type": ["string", "null"]}, "1.5", ["$ expected type string|null, got number"]),
        ({"type": "number"}, "1.0", []),
        ({"minLength": 3, "pattern": "^b"}, '"a😀"', ["$ pattern mismatch"]),
        ({"maxLength": 1}, '"ab"', ["$ maxLength 1"]),
        ({"pattern": "["}, '"ab"', []),
        ({"minimum": 2, "maximum": 3}, "1", ["$ < minimum 2"]),
        ({"minItems": 2, "items": {"type": "integer"}}, '["a"]', ["$ minItems 2", "$[0] expected type integer, got string"]),
        ({"items": [{"type": "string"}, {"type": "integer"}]}, '["a","b"]', ["$[1] expected type integer, got string"]),
        ({"required": ["a"], "properties": {"b": {"properties": {"c": {"type": "null"}}}}}, '{"b":{"c":1}}', ["$.a required", "$.b.c expected type null, got integer"]),
        ({"allOf": [{"type": "string"}], "anyOf": [{"type": "null"}, {"const": 2}]}, "1", ["$ expected type string, got integer", "$ anyOf failed"]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 0}]}, "1", ["$ oneOf matched 2"]),
    ],
)
def test_schemas(spark, schema, value, found):
    df = spark.createDataFrame([(value,)], "s string").select(validate.errors(F.col("s"), schema).alias("e"))
    assert [f"{e['path']} {e['msg']}" for e in df.first()["e"]] == found


def test_validate_all(rows):
    bad = by_id(validate.validate(rows, "openai-chat"), "errors")
    assert 0 not in bad and bad[12][0]["msg"] == "parse error" and len(bad) == len(ROWS) - 1
    assert not by_id(validate.exclude_failures(rows, "alpaca"), "excluded")[4]


def near_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in town"
    texts = [base, base, base + " now", "completely different words about nothing in particular at all here today", "short"]
    return features.rows_table(spark.createDataFrame([(i, json.dumps({"text": t})) for i, t in enumerate(texts)], "row_id long, raw string"))


def test_dedup(spark):
    df = near_rows(spark)
    assert {tuple(r) for r in dedup.exact_dedup(df).collect()} == {(0, 0), (1, 0)}
    near = dedup.near_dedup(df, None, 10)
    got = {tuple(r) for r in near.collect()}
    assert {(0, 0), (1, 0)} <= got
    keep = {r["row_id"] for r in dedup.pick_keepers(df, dedup.exact_dedup(df), "last").where("keeper").collect()}
    assert keep == {1}
    tagged = by_id(dedup.dedup_resolve(df, dedup.exact_dedup(df), "tag"), "tags")
    assert tagged[0] == ["_dup"] and tagged[3] == []
    assert tuple(dedup.dup_counts(dedup.exact_dedup(df)).first()) == (1, 2, 1)
    assert dedup.near_dedup(df, None, 64).select("row_id").count() == 5


def test_simhash_matches_plain(spark):
    from quarry.functions.signature import simhash_of

    def plain(text):
        def fnv(t):
            h = 2166136261
            for c in t:
                h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
            return h

        import re

        v = [0] * 64
        for t in re.findall("[a-z0-9]+", text.lower()):
            h = fnv(t) | fnv(t + "!") << 32
            for i in range(64):
                v[i] += 1 if h >> i & 1 else -1
        n = sum(1 << i for i in range(64) if v[i] > 0)
        return n - (1 << 64) if n >> 63 else n

    for t in ("", "a", "The cat the hat 42", "Über x9 x9 x9 y"):
        assert simhash_of(t) == plain(t)


@pytest.mark.parametrize("most", [0, 4, 6, 12, 32])
def test_similar_signatures_brute_force(spark, most, monkeypatch):
    import random

    monkeypatch.setattr(dedup, "BLOCK", 16)
    rng = random.Random(4)
    sigs = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    for s in list(sigs)[:30]:
        for n in (2, 4, 6, 12):
            sigs.add(s ^ sum(1 << b for b in rng.sample(range(63), n)))
    label, near = {}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= most
    for s in sorted(sigs):
        if s not in label:
            todo, label[s] = [s], s
            while todo:
                x = todo.pop()
                for y in sigs:
                    if y not in label and near(x, y):
                        label[y] = s
                        todo.append(y)
    edges = dedup.similar_signatures(spark.createDataFrame([(s,) for s in sigs], "sig long"), most)
    assert all(near(a, b) for a, b in edges.collect())
    from quarry.operators.graph import connected_components

    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {s: got.get(s, s) for s in sigs} == label


def test_keys_grow_with_the_signatures():
    """Pairs that share a key by chance: about in step with the signatures, not with their square."""
    from math import comb

    def chance(n, most):
        parts, kept = dedup.slices(n, most)
        return comb(parts, kept) * n * n / 2 / 2 ** (64 // parts * kept)

    for n in (10**5, 10**6, 10**7):
        assert chance(2 * n, 4) < 3 * chance(n, 4) or chance(2 * n, 4) < 40 * n


def test_lists_take_few_postings_and_few_edges(monkeypatch):
    """Postings of a signature do not multiply with the signatures, and a list gives a forest of near pairs, whether few or many of its members are near."""
    from math import comb

    assert max(comb(*dedup.list_slices(n, 6)) for n in (40_000, 400_000, 2_500_000, 10_000_000)) <= 28
    monkeypatch.setattr(dedup, "CELLS", 256)
    rng = np.random.default_rng(3)
    flipped = lambda base, bits: base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(base), bits), dtype=np.uint64), axis=1)
    far = rng.integers(0, 2**64, 150, dtype=np.uint64)
    sets = far, flipped(np.repeat(far[:1], 150), 3), np.concatenate([far, flipped(far[:60], 5), flipped(np.repeat(far[:2], 90), 4)]), far[:1], far[:0]
    for sigs in map(np.unique, sets):
        pairs = [(a, b) for side in dedup._forest(sigs, 6) for a, b in zip(*side)]
        assert all(0 < np.bitwise_count(a ^ b) <= 6 for a, b in pairs) and len(pairs) <= 5 * len(sigs)
        near = np.bitwise_count(sigs[:, None] ^ sigs) <= 6
        label, linked = np.arange(len(sigs)), np.eye(len(sigs), dtype=bool)
        for a, b in np.searchsorted(sigs, np.array(pairs, np.uint64).reshape(-1, 2)):
            linked[a, b] = linked[b, a] = True
        reach = lambda m: np.array([np.where(m[i], label, len(sigs)).min() for i in range(len(sigs))], int)
        found = []
        for m in (near, linked):
            label = np.arange(len(sigs))
            while (step := reach(m)).tolist() != label.tolist():
                label = step
            found.append(label.tolist())
        assert found[0] == found[1]


def test_leakage(spark):
    words = [f"word{i}" for i in range(40)]
    passage = " ".join(words)
    a = [passage, " ".join(words[5:12]) + " " + "x" * 40, "tiny but " + "y" * 70, "漢字" * 30]
    b = ["before " + passage.upper() + "  after", " ".join(words[3:9]), "has tiny but " + "y" * 70 + " inside", "nothing of the kind", "word1 word2", "字漢字漢字", "字" * 8, "y" * 9, "other " + "y" * 71]
    make = lambda ts: features.rows_table(spark.createDataFrame([(i, json.dumps({"text": t})) for i, t in enumerate(ts)], "row_id long, raw string"))
    low = [t.lower().replace("  ", " ") for t in b]
    want = {i for i, t in enumerate(low) if len(t) >= 8 and any(t in x or x in t for x in a)}
    assert {r[0] for r in compare.leakage_exact(make(a), make(b)).collect()} == want == {0, 1, 2, 4, 7}
    assert {r[0] for r in compare.leakage_exact(make(a[:0]), make(b)).collect()} == set()
    kinds = by_id(compare.leakage(make(a), make(b)), "kind")
    assert kinds[0] == "exact"


def test_leakage_by_either_strategy(spark, monkeypatch):
    """A small side on either hand, or anchors: the same rows. Texts of one repeated character share one anchor, whose candidates go to several tasks."""
    rng = __import__("random").Random(3)
    line = lambda n: " ".join(rng.choice(("red", "green", "blue", "one", "two")) for _ in range(n))
    a = [line(rng.randrange(4, 40)) for _ in range(25)] + ["z" * (64 + k) for k in range(15)]
    b = [line(3) + " " + x + " end" for x in a[:12]] + [x[5:40].strip() for x in a[5:20]] + ["z" * k for k in range(60, 90, 3)] + [line(12) for _ in range(30)]
    make = lambda ts: features.rows_table(spark.createDataFrame([(i, json.dumps({"text": t})) for i, t in enumerate(ts)], "row_id long, raw string"))
    want = {i for i, t in enumerate(b) if len(t) >= 8 and any(len(x) >= 64 and (t in x or x in t) for x in a)}
    assert 0 < len(want) < len(b)
    monkeypatch.setattr(compare, "ANCHOR_BLOCK", 4)
    for few, first, second in ((256, a, b), (0, a, b)):
        monkeypatch.setattr(compare, "SMALL_TEXTS", few)
        assert {r[0] for r in compare.leakage_exact(make(first), make(second)).collect()} == want
    monkeypatch.setattr(compare, "SMALL_TEXTS", 30)  # the other side is the small one
    few = b[:20]
    assert {r[0] for r in compare.leakage_exact(make(a), make(few)).collect()} == {i for i in want if i < 20}


def test_leakage_of_every_size(spark, monkeypatch):
    """Texts of every size class inside others, in both directions, with candidates of a text dealt into blocks and joined either way."""
    rng = __import__("random").Random(11)
    letters = "abcdefgh éß漢😀"
    line = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip().ljust(n, "x")
    sizes = (8, 9, 12, 15, 16, 20, 31, 32, 40, 63, 64, 100, 255, 256, 300, 700)
    whole = [line(n) + line(1500) for n in sizes] + ["z" * 300, line(500) * 3]
    cut_out = lambda t, n: t[(at := rng.randrange(len(t) - n)) : at + n]
    parts = [cut_out(t, n) for t, n in zip(whole, sizes, strict=False)]
    edited = [p[: len(p) // 2] + "Q" + p[len(p) // 2 + 1 :] for p in parts]
    a = whole + [p for p in parts[10:]] + [line(70) for _ in range(5)]
    b = parts + edited + ["z" * n for n in range(100, 120)] + [line(30) + p + line(9) for p in parts] + [whole[0]] * 3 + [whole[-1][:520], whole[-1][700:]]
    make = lambda ts: features.rows_table(spark.createDataFrame([(i, json.dumps({"text": t})) for i, t in enumerate(ts)], "row_id long, raw string"))
    normal = lambda t: " ".join(t.lower().split(" ")).strip() if "  " not in t else " ".join(t.lower().split())
    units = lambda t: len(t.encode("utf-16-le")) // 2
    x, y = [normal(t) for t in a], [normal(t) for t in b]
    want = {i for i, t in enumerate(y) if units(t) >= 8 and any(units(u) >= 64 and (t in u or u in t) for u in x)}
    assert 20 < len(want) < len(b) - 10
    monkeypatch.setattr(compare, "SMALL_TEXTS", 0)
    assert {r[0] for r in compare.leakage_exact(make(a), make(b)).collect()} == want
    for name, n in (("ANCHOR_BLOCK", 2), ("CANDIDATES", 2), ("FEW_PAIRS", 0)):
        monkeypatch.setattr(compare, name, n)
    assert {r[0] for r in compare.leakage_exact(make(a), make(b)).collect()} == want


def test_leakage_writes_a_text_once(spark, tmp_path, monkeypatch):
    """What jn4_leakage writes and shuffles stays near the texts' size: neither they nor the runs of their bytes are moved for the candidates."""
    from pathlib import Path

    import __spark_entry__

    rng = __import__("random").Random(5)
    line = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=n))
    texts = [line(6000) for _ in range(600)] + [line(n) for n in (9, 20, 40, 90, 200) for _ in range(12)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(compare, "SMALL_TEXTS", 0)
    monkeypatch.setattr(compare, "bounded", lambda df: df.hint("merge"))  # tables that are too large to be broadcast
    monkeypatch.setattr("quarry.plans.lineage.shared_dir", lambda spark: f"file://{tmp_path}/shared")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sc = spark.sparkContext._jsc.sc()
        shuffled = lambda: sc.listenerBus().waitUntilEmpty(30_000) or sc.statusStore().executorList(False).apply(0).totalShuffleWrite()
        before = shuffled()
        __spark_entry__.queries()["jn4_leakage"](spark, str(tmp_path)).collect()
        moved = shuffled() - before + sum(f.stat().st_size for f in Path(tmp_path, "shared").rglob("*.parquet"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved < 2 * sum(map(len, texts))


def nested(depth, leaf):
    return '{"a":[' * depth + leaf + "]}" * depth


def test_deep_trees(spark):
    raw = [nested(20, '"deep text"'), nested(20, '"other"'), nested(20, "1.50")]
    df = features.rows_table(spark.createDataFrame(list(enumerate(raw)), "row_id long, raw string"))
    assert by_id(df, features.row_chunks()) == {0: ["deep text"], 1: ["other"], 2: []}
    at = "$" + ".a[0]" * 20
    nodes = jsonops.explode_nodes(df)
    assert nodes.count() == 3 * 41 and {tuple(r) for r in nodes.where(F.col("path") == at).select("row_id", "type", "value").collect()} == {(0, "string", '"deep text"'), (1, "string", '"other"'), (2, "number", "1.5")}
    assert jsonops.explode_nodes(df, 1).count() == 6
    assert {tuple(r) for r in jsonops.string_leaf_paths(df).collect()} == {(0, at, "deep text"), (1, at, "other")}
    pairs = df.where("row_id = 0").select("row_id", F.col("v").alias("a"), F.parse_json(F.lit(raw[1])).alias("b"))
    assert [tuple(r) for r in jsonops.diff_json(pairs).collect()] == [(0, at, "change", '"deep text"', '"other"')]
    found = pii.pii_fields(df, jsonops.string_leaf_paths(df)).collect()
    assert found == []


def by_md5(ids, seed=1):
    import hashlib

    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("few", [3, 10_000])
def test_split_members(spark, few, monkeypatch):
    """The members of parts and samples, by sorting; edges that are found in one round and in several."""
    monkeypatch.setattr(split, "FEW", few)
    rows = spark.range(500).select((F.col("id") * 7 - 100).alias("row_id"), (F.col("id") % 11 == 0).alias("deleted"), F.when(F.col("id") < 400, "hot").when(F.col("id") < 498, F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("key"))
    live = {r.row_id: r.key for r in rows.where("not deleted").collect()}
    got = {r.row_id: r.split for r in split.split(rows, (0.7, 0.2, 0.1)).collect()}
    order, n = by_md5(live), len(live)
    a, b = int(n * 0.7 // 1.0), int(n * 0.7 // 1.0) + int(n * 0.2 // 1.0)
    assert got == {i: "train" if k < a else "val" if k < b else "test" for k, i in enumerate(order)}
    strat = {r.row_id: r.split for r in split.split_stratified(rows, "key").collect()}
    want = {}
    for key in set(live.values()):
        mine = by_md5([i for i, x in live.items() if x == key])
        a, b = int(len(mine) * 0.8), int(len(mine) * 0.8) + int(len(mine) * 0.1)
        want |= {i: "train" if k < a else "val" if k < b else "test" for k, i in enumerate(mine)}
    assert strat == want
    for size in (0, 1, 77, n, n + 5):
        assert {r.row_id for r in split.sample(rows, size).collect()} == set(order[:size])
    none = rows.where("row_id < -1000")
    assert split.split(none).count() == split.split_stratified(none, "key").count() == split.sample(none, 3).count() == 0
    assert {r.split for r in split.split(rows, (1.0, 0.0)).collect()} == {"train"}


def test_split_does_not_shuffle_rows(spark):
    import contextlib
    import io

    rows, out = spark.range(100).select(F.col("id").alias("row_id"), F.lit(False).alias("deleted"), F.lit("x").alias("text")), io.StringIO()
    with contextlib.redirect_stdout(out):
        split.split(rows).explain()
        split.sample(rows, 10).explain()
    assert "Exchange" not in out.getvalue() and "Join" not in out.getvalue()


def test_splits(spark):
    df = spark.range(101).select(F.col("id").alias("row_id"), F.lit(False).alias("deleted"), (F.col("id") % 3).cast("string").alias("k"))
    parts = split.split(df, seed=7)
    assert by_key(parts.groupBy("split").count()) == {"train": 80, "val": 10, "test": 11} == by_key(split.split_preview(df))
    assert parts.select("row_id").distinct().count() == 101
    strata = split.split_stratified(df, "k", (0.5, 0.5)).groupBy("k", "split").count().collect()
    assert {(r["k"], r["split"]): r["count"] for r in strata} == {("0", "train"): 17, ("0", "val"): 17, ("1", "train"): 17, ("1", "val"): 17, ("2", "train"): 16, ("2", "val"): 17}
    assert split.sample(df, 500).count() == 101


def test_annotations(spark, rows):
    some = rows.where("row_id < 3")
    log = annotate.change(some, 1, "review", "approve").unionByName(annotate.change(some.where("row_id = 1"), 2, "tag+", "x")).unionByName(annotate.change(some.where("row_id = 0"), 3, "review", None))
    log = log.unionByName(annotate.change(some.where("row_id = 1"), 4, "tag+", "w")).cache()
    now = by_id(annotate.state(rows, log), "review", "tags")
    assert now[0] == (None, []) and now[1] == ("approve", ["x", "w"]) and now[5] == (None, [])
    back = by_id(annotate.state(rows, annotate.undo(log, 2)), "review", "tags")
    assert back[0] == ("approve", []) and back[1] == ("approve", ["x"])
    off = log.unionByName(annotate.toggle_tag(annotate.state(rows, log).where("row_id < 2"), 5, "x"))
    assert {k: v[1] for k, v in by_id(annotate.state(rows, off), "review", "tags").items() if k < 2} == {0: ["x"], 1: ["w"]}
    edits_ = spark.createDataFrame([(5, '{"x":1}'), (6, "{bad")], "row_id long, raw string")
    new = annotate.replace_rows(rows, edits_)
    assert by_id(new, "raw", "dirty")[5] == ('{"x":1}', True) and not by_id(new, "dirty")[6]
    assert by_id(annotate.reset_rows(new, rows), "raw", "dirty")[5] == (ROWS[5][0], False)
    assert annotate.add_rows(rows, spark.createDataFrame([("{}",)], "raw string")).agg(F.max("row_id")).first()[0] == len(ROWS)


def test_audit(spark, rows, tmp_path):
    found = audit.audit(rows)
    s = found["summary"].first()
    assert (s["total"], s["parse_err"], s["dominant"], s["dup_rows"]) == (18, 5, "parse-error", 0)
    assert {r["action"] for r in aggregates.recommendations(found["summary"]).collect()} == {"fix lint errors", "convert to the dominant format"}
    audit.save_audit(found, rows, str(tmp_path / "audit"))
    assert audit.load_audit(rows, str(tmp_path / "audit")) is not None
    assert audit.load_audit(rows.where("row_id > 0"), str(tmp_path / "audit")) is None
    for day in range(12):
        audit.push_score(found["summary"], str(tmp_path / "scores"), f"2024-01-{day + 1:02d}")
    last = audit.score_history(spark.read.parquet(str(tmp_path / "scores"))).collect()
    assert len(last) == 10 and str(last[0]["ran_at"]).startswith("2024-01-12")
    assert audit.attach_findings(rows, found).where("lint_n > 0").count() == found["lint"].count()


def test_chunks_and_snippet(spark, rows):
    got = by_id(rows, features.row_chunks())
    assert got[0] == ["hi", "a\nb\n"] and got[12] == ["{bad"]
    deep = features.rows_table(spark.createDataFrame([(0, '{"a":{"b":["x",{"c":""}]},"d":"y"}')], "row_id long, raw string"))
    assert deep.select(features.row_chunks()).first()[0] == ["x", "y"]
    s = spark.range(1).select(features.snippet(F.lit("abcdef"), F.lit(2), F.lit(4), 1).alias("s")).first()["s"]
    assert tuple(s) == ("b", "cd", "e", True, True)
    assert spark.range(1).select(features.truncated(F.lit("x" * 121)), features.norm(F.lit("  A  b "))).first()[1] == "a b"


def test_short_texts_are_near_from_a_length_on(spark):
    """Rows below the usual 16 units have near duplicates where a caller says so; their queries' SQL knows no least length."""
    make = lambda ts, at: features.rows_table(spark.createDataFrame([(at + 2 * i, json.dumps({"text": t}, separators=(",", ":"))) for i, t in enumerate(ts)], "row_id long, raw string"))
    a, b = make(["A.", "some longer text"], 0), make(["A.", ""], 1)
    assert compare.leakage_near(a, b).count() == 0
    assert [tuple(r) for r in compare.leakage(a, b, min_units=11).collect()] == [(1, "near", 0)]
    assert dedup.near_dedup(a.unionByName(b), "json", 0).count() == 0
    assert {tuple(r) for r in dedup.near_dedup(a.unionByName(b), "json", 0, min_units=11).collect()} == {(0, 0), (1, 0)}


def test_arrow_passes_hold_few_values_at_a_time():
    """Python objects of an Arrow pass are those of a slice, and batches that a walk gives back end by characters too."""
    import pyarrow as pa

    from quarry.functions import rowscan, trees

    seen = []
    texts = pa.array([None if i % 7 == 0 else str(i) for i in range(1000)])
    got = rowscan.sliced(texts, lambda ts: seen.append(len(ts)) or [t and t + "!" for t in ts], pa.string())
    assert got.to_pylist() == [t and t + "!" for t in texts.to_pylist()] and max(seen) == rowscan.STEP and sum(seen) == 1000
    assert rowscan.sliced(texts[:0], list, pa.string()).to_pylist() == []
    schema = pa.schema([("row_id", pa.int64()), ("text", pa.string())])
    batches = list(trees._batches(((i, "x" * 600_000) for i in range(6)), schema))
    assert [b.num_rows for b in batches] == [2, 2, 2] and [x for b in batches for x in b.column(0).to_pylist()] == list(range(6))


def test_arrow_batches_of_rows_tables_end_by_bytes(spark, tmp_path):
    """A worker holds a few MB of long rows at a time, in a table and in a stream; a bound that the session names stays."""
    import pyarrow as pa

    from quarry.functions.rowscan import BATCH_BYTES, bound_batches
    from quarry.streaming.ingest import stream_read_jsonl

    @F.arrow_udf("long")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    long = F.to_json(F.struct(F.repeat(F.lit("x"), 100_000).alias("text")))
    own = spark.newSession()
    rows = features.rows_table(own.range(0, 200, 1, 1).select(F.col("id").alias("row_id"), long.alias("raw")))
    assert rows.agg(F.max(held("raw"))).first()[0] < 2 * BATCH_BYTES
    assert rows.where("fmt = 'text' and length(raw) > 100000").count() == 200

    own = spark.newSession()
    own.range(0, 200, 1, 1).select(long.alias("value")).write.text(f"{tmp_path}/in")
    streamed = stream_read_jsonl(own, f"{tmp_path}/in").select("fmt", held("raw").alias("n"))
    streamed.writeStream.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet").awaitTermination()
    assert tuple(own.read.parquet(f"{tmp_path}/out").agg(F.count_if(F.col("fmt") == "text"), F.max("n") < 2 * BATCH_BYTES).first()) == (200, True)

    own, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    own.conf.set(key, "1m")
    bound_batches(own)
    assert own.conf.get(key) == "1m"


def test_walks_of_long_rows_get_batches_that_end_by_bytes(spark):
    """What the audit report's walk over strings gets of a rows table at a time, and that it finds all of them."""
    import pyarrow as pa

    from quarry.functions.rowscan import BATCH_BYTES

    def walk(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    own = spark.newSession()
    long = F.to_json(F.struct(F.repeat(F.lit("x"), 100_000).alias("text"), F.lit("a@b.org").alias("by")))
    rows = features.rows_table(own.range(0, 200, 1, 1).select(F.col("id").alias("row_id"), long.alias("raw")))
    assert rows.select("row_id", "raw").mapInArrow(walk, "n long").agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    found = pii.redacted_report(pii.pii_fields(rows, jsonops.string_leaf_paths(rows)))
    assert found.groupBy("field", "id", "len").count().collect() == [("$.by", "email", 7, 200)]
