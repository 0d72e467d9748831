"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, divergence, hierbayes, langid, linededup, merkle, mixing, quality, search, sharding, simhash, suffix, toolchat


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when sources are mixed 1 : 2 : 3 in turn."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=3, most=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.shard(_documents(spark, sf_dir))


def op4_drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from each document, and a digest of what stays."""
    kept = linededup.drop_frequent_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of each document."""
    return quality.quality(_documents(spark, sf_dir))


def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return langid.identify(_documents(spark, sf_dir))


#: Arguments of the tools that op7_link_tool_calls writes calls of.
TOOLS: dict[str, toolchat.Schema] = {
    "answer": {"prompt": {"type": "string", "required": True, "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "required": True, "minimum": 0, "maximum": 5}},
    "count": {"n": {"type": "integer", "required": True, "maximum": 200}},
}


def tool_messages(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as tool messages in JSON.

    A user's turn t calls the tool `answer` under the identifier t mod 6 (so turns 6 and 7 repeat one) and needs the result of turn t - 2; every
    third conversation calls `count` in the same message too, under t + 100, with arguments given as a string. An assistant's turn t is the result of call t - 1, in
    every fourth conversation of call t + 1, which comes later or never. Other turns stay plain.
    """
    t, number = F.col("turn"), lambda x: x.cast("string")
    answer = F.struct(F.col("text").alias("prompt"), t)
    one = F.struct(number(t % 6).alias("id"), F.lit("answer").alias("name"), answer.alias("arguments"), number(t - 2).alias("after"))
    function = lambda name, arguments: F.struct(F.lit(name).alias("name"), F.to_json(arguments).alias("arguments"))
    entry = lambda id_, f, after: F.struct(id_.alias("id"), f.alias("function"), after.alias("after"))
    two = F.array(entry(number(t % 6), function("answer", answer), number(t - 2)), entry(number(t + 100), function("count", F.struct(F.length("text").alias("n"))), F.lit(None).cast("string")))
    result = F.struct(number(F.when(F.col("conv_id") % 4 == 0, t + 1).otherwise(t - 1)).alias("tool_call_id"), F.col("text").alias("content"))
    called = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(two.alias("tool_calls")))).otherwise(F.to_json(one))
    return turns.select("conv_id", "turn", "role", F.when(F.col("role") == "user", called).when(F.col("role") == "assistant", F.to_json(result)).otherwise(F.col("text")).alias("text"))


def op7_link_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message of `conversations`, written as tool calls and results by tool_messages, read back, linked, ordered and serialised."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return toolchat.link_calls(toolchat.parse_messages(tool_messages(turns)), TOOLS)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in each document."""
    found = decontam.find_items(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from each document because their 100-byte strings start earlier."""
    found = suffix.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_quality_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, its source as host and its language there as path."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return hierbayes.classify(_documents(spark, sf_dir), labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op11_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each document's Merkle tree and of its edited text's, and how alike the trees are."""
    found = merkle.fingerprints(_documents(spark, sf_dir))
    sha = F.sha2("edited", 256).alias("edited_sha256")
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), sha, F.col("tree.root").alias("fingerprint"), F.col("edited_tree.root").alias("edited_fingerprint"), "near_edited", "near_next")


def op12_rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search.rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that set each apart."""
    return divergence.audit(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query opN_<name>."""
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: SQL twins, where SQL can say it.
SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null|' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w
  FROM d GROUP BY source),
k AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER o AS rn, sum(source_size * 3.0::DOUBLE) OVER o - source_size * 3.0::DOUBLE AS filled,
         sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW o AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((t - filled) / weights, rn) AS level FROM k, (SELECT CAST(sum(size) AS DOUBLE) AS t FROM d) WHERE cap / w >= (t - filled) / weights),
p AS (SELECT source, source_size, least(cap, w * level) AS target FROM k, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
c AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS need, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN cum < need OR cum - size < need AND (need - (cum - size)) * 2 >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
    "op7_link_tool_calls": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, 0 AS part, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN turn % 6 WHEN 'assistant' THEN CASE WHEN conv_id % 4 = 0 THEN turn + 1 ELSE turn - 1 END END AS id,
         'answer' AS name, CASE role WHEN 'user' THEN turn - 2 END AS after
  FROM conversations
  UNION ALL
  SELECT conv_id, turn, 1, role, text, 'call', turn + 100, 'count', NULL FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
results AS (SELECT conv_id, id, min(turn) AS result_turn FROM m WHERE kind = 'result' GROUP BY ALL),
calls AS (
  SELECT c.*, r.result_turn FROM (SELECT conv_id, id, min((turn, part, after)) AS f FROM m WHERE kind = 'call' GROUP BY ALL) c LEFT JOIN results r USING (conv_id, id)),
k AS (SELECT conv_id, id, f[1] AS turn, f[2] AS part, f[3] AS after, result_turn FROM calls),
-- every call that a call waits for, directly or not, and how many steps lie between
chain AS (
  SELECT conv_id, id, id AS up, 0 AS far FROM k
  UNION
  SELECT c.conv_id, c.id, p.id, c.far + CASE WHEN p.result_turn IS NULL THEN 1 ELSE 2 END
  FROM chain c JOIN k x ON x.conv_id = c.conv_id AND x.id = c.up JOIN k p ON p.conv_id = x.conv_id AND p.id = x.after WHERE c.far < 100),
asked AS (
  SELECT c.conv_id, c.id, k.turn, c.far AS step FROM chain c JOIN k ON k.conv_id = c.conv_id AND k.id = c.up
  UNION ALL
  SELECT c.conv_id, c.id, p.result_turn, c.far + 2 FROM chain c JOIN k x ON x.conv_id = c.conv_id AND x.id = c.up JOIN k p ON p.conv_id = x.conv_id AND p.id = x.after WHERE p.result_turn IS NOT NULL),
placed AS (SELECT conv_id, id, max((turn, step)) AS spot FROM asked GROUP BY ALL),
j AS (
  SELECT m.*, k.turn AS call_turn, k.result_turn, p.spot, m.kind = 'call' AND (m.turn <> k.turn OR m.part <> k.part) AS repeated
  FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.id = m.id LEFT JOIN placed p ON p.conv_id = m.conv_id AND p.id = m.id)
SELECT conv_id, turn, part, kind, CAST(id AS VARCHAR) AS call_id,
       CASE WHEN repeated THEN false WHEN kind = 'call' THEN result_turn IS NOT NULL WHEN kind = 'result' THEN call_turn IS NOT NULL END AS linked,
       CASE WHEN kind = 'call' THEN concat_ws(',', CASE WHEN repeated THEN 'id:repeated' END,
         CASE WHEN name = 'count' AND text IS NULL THEN 'n:required' WHEN name = 'count' AND length(text) > 200 THEN 'n:maximum' END,
         CASE WHEN name = 'answer' AND text IS NULL THEN 'prompt:required' WHEN name = 'answer' AND length(text) < 1 THEN 'prompt:minLength' WHEN name = 'answer' AND length(text) > 300 THEN 'prompt:maxLength' END,
         CASE WHEN name = 'answer' AND turn < 0 THEN 'turn:minimum' WHEN name = 'answer' AND turn > 5 THEN 'turn:maximum' END) END AS errors,
       CASE WHEN kind = 'call' AND NOT repeated THEN spot[1] WHEN kind = 'result' AND spot IS NOT NULL THEN greatest((turn, 0), (spot[1], spot[2] + 1))[1] ELSE turn END AS order_turn,
       CASE WHEN kind = 'call' AND NOT repeated THEN spot[2] WHEN kind = 'result' AND spot IS NOT NULL THEN greatest((turn, 0), (spot[1], spot[2] + 1))[2] ELSE 0 END AS order_step,
       CASE WHEN kind = 'call' AND name = 'count' THEN '{"role":"user","tool_call":{"arguments":{' || coalesce('"n":' || length(text), '') || '},"id":"' || id || '","name":"count"}}'
            WHEN kind = 'call' THEN '{"role":"user","tool_call":{"arguments":{' || coalesce('"prompt":' || to_json(text) || ',', '') || '"turn":' || turn || '},"id":"' || id || '","name":"answer"}}'
            WHEN kind = 'result' THEN '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"tool","tool_call_id":"' || id || '"}'
            ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' END AS json
FROM j""",
    "op4_drop_repeated_lines": r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT a.*, f.k IS NOT NULL AS bad FROM keyed a LEFT JOIN frequent f ON a.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_decontaminate": r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
pats AS (
  SELECT DISTINCT id AS item, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS pat, least(10, len(w)) AS n
  FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM words WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pats),
occ AS (
  SELECT id, p, n, array_to_string(w[p:p + n - 1], ' ') AS pat
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE side = 'd' AND len(w) >= n)),
hits AS (SELECT o.id, o.p, o.n, t.item FROM occ o JOIN pats t ON o.pat = t.pat AND o.n = t.n),
cover AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS s FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN cover c ON c.id = w.id LEFT JOIN its i ON i.id = w.id WHERE w.side = 'd'""",
    "op11_fingerprint_documents": r"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) AS rn FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY rn), first_value(t) OVER (ORDER BY rn)) AS nt FROM o),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS et FROM n),
texts AS (SELECT rn, 0 AS k, t AS x FROM e UNION ALL SELECT rn, 1, et FROM e UNION ALL SELECT rn, 2, nt FROM e),
p AS (SELECT rn, k, list_transform(regexp_extract_all(x, '[^.!?|\n]{1,200}[.!?|\n]*|[.!?|\n]+'), lambda y: md5(y)) AS p FROM texts),
b AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: substr(p[i], 1, 1) IN ('0', '8') OR i = len(p)) AS ends FROM p),
s AS (SELECT *, list_transform(range(1, len(ends) + 1), lambda i: md5(array_to_string(p[coalesce(ends[i - 1], 0) + 1:ends[i]], ''))) AS s FROM b),
r AS (SELECT rn, k, md5(array_to_string(s, '')) AS root, list_distinct(list_concat(['r' || md5(array_to_string(s, ''))], list_transform(s, lambda y: 's' || y), p)) AS nodes FROM s)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.et) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint,
       CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.nodes, b.nodes)) / (len(a.nodes) + len(b.nodes)) END AS near_edited,
       CASE WHEN a.root = c.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.nodes, c.nodes)) / (len(a.nodes) + len(c.nodes)) END AS near_next
FROM e JOIN r a ON a.rn = e.rn AND a.k = 0 JOIN r b ON b.rn = e.rn AND b.k = 1 JOIN r c ON c.rn = e.rn AND c.k = 2""",
    "op12_rank_documents": r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT qn, item_id, t, count(*) AS times FROM (
    SELECT row_number() OVER () AS qn, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
g AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
tf AS (SELECT rn, t, count(*) AS tf FROM (SELECT rn, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t, g.n),
i AS (SELECT tf.rn, tf.t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * g.n) // g.l)) AS i FROM tf JOIN d ON d.rn = tf.rn, g),
s AS (SELECT q.qn, q.item_id, i.rn, CAST(sum(q.times * w.w * i.i) AS BIGINT) AS score FROM q JOIN w ON w.t = q.t JOIN i ON i.t = q.t GROUP BY ALL),
r AS (SELECT s.*, d.doc_id, row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id) AS rank FROM s JOIN d ON d.rn = s.rn WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_audit_sources": r"""
WITH w AS (
  SELECT rn, lang, source, unnest(terms) AS t FROM (
    SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)),
k AS (SELECT lang, t, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT rn) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(ln) AS BIGINT) AS total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.t, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.t = w.t GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(v.v, 0) AS v, coalesce(v.total, 0) AS total, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) x LEFT JOIN v ON v.lang = x.lang),
p AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p, 1 + (1000000000 * (k.ln + 2)) // (g.total + 2 * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', t, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
