"""Merkle fingerprints, ranked search and the source audit against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest_rows import SCHEMA, prose
from pyspark.sql import functions as F

from quarry.llm import divergence, merkle, search


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def clash(df, module):
    """df with every name of the module's columns as an extra column."""
    import inspect

    names = {n for n in re.findall(r'["\']([a-z_]+)["\']', inspect.getsource(module))} - set(df.columns)
    return df.withColumns({n: F.lit(1) for n in sorted(names)})


# --- fingerprints ---


def tree(text):
    leaves = [md5(p) for p in re.findall(r"[^.!?|\n]{1,200}[.!?|\n]*|[.!?|\n]+", text)]
    sections, now = [], []
    for i, h in enumerate(leaves):
        now.append(h)
        if h[0] in "08" or i == len(leaves) - 1:
            sections.append(md5("".join(now)))
            now = []
    root = md5("".join(sections))
    return root, {"r" + root, *("s" + s for s in sections), *leaves}


def near(a, b):
    return 1.0 if a[0] == b[0] else 2 * len(a[1] & b[1]) / (len(a[1]) + len(b[1]))


def fingerprints_of(rows):
    rows = sorted(rows, key=lambda r: r[0])
    texts = [r[1] or "" for r in rows]
    out = {}
    for k, (i, *_) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        out[i] = (e, tree(t)[0], tree(e)[0], near(tree(t), tree(e)), near(tree(t), tree(after)))
    return out


def test_fingerprints(spark, docs, rows):
    want = fingerprints_of(rows)
    assert any(len(x[1] or "") > 20_000 for x in rows)
    for parts in ("4", "40"):  # with 40, each range of ids holds one document
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = merkle.fingerprints(docs).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {r.doc_id: (r.edited, r.tree.root, r.edited_tree.root, r.near_edited, r.near_next) for r in found} == want


def test_fingerprints_of_odd_rows(spark, odd, empty):
    """Repeated rows, equal ids with other texts, null ids (last) and clashing names; one row; none."""
    more = odd.unionByName(spark.createDataFrame([(3, "another text. of the same id", "xa", "s0", 1, 1, "x", 2)], odd.schema))
    found = merkle.fingerprints(clash(more, merkle)).collect()
    assert len(found) == more.count()
    texts = [r.text or "" for r in more.collect()]
    assert Counter(r.text for r in found) == Counter(texts) == Counter(r.next_text for r in found)
    roots = {r.text: r.tree.root for r in found}
    assert len({r.tree.root for r in found}) == len(roots)
    nulls = [r for r in found if r.doc_id is None]
    assert len(nulls) == 2 and sum(r.next_text == min((x for x in found if x.doc_id == 0), key=lambda x: x.text).text for r in nulls) >= 1
    one = merkle.fingerprints(docs_of(spark, [(1, "a. b. c. d.")])).first()
    assert (one.edited, one.near_next) == ("a. b. c. a.", 1.0)
    assert merkle.fingerprints(empty).count() == 0
    words = docs_of(spark, [("b", "x y"), ("a", "z")], "string")
    assert {r.doc_id: r.next_text for r in merkle.fingerprints(words).collect()} == {"a": "x y", "b": "z"}


def docs_of(spark, pairs, kind="long"):
    return spark.createDataFrame([(i, t, "xa", "s0", 1) for i, t in pairs], SCHEMA.replace("doc_id long", f"doc_id {kind}"))


def test_many_copies_under_one_id(spark):
    """A third of the rows are one row; it bounds several ranges."""
    many = docs_of(spark, [(5, "the same. text") for _ in range(60)] + [(i, f"text {i}. and more") for i in range(120)])
    found = merkle.fingerprints(many).collect()
    assert len(found) == 180 and Counter(r.text for r in found) == Counter(r.next_text for r in found)


def test_changes_are_located(spark):
    before = "\n".join(f"Line {i} of the text" for i in range(200))
    lines = before.split("\n")
    after = "\n".join([*lines[:20], "a new line", *lines[20:100], "CHANGED", *lines[101:]])
    df = spark.createDataFrame([(before, after)], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"), merkle.paragraphs(F.col("b")).alias("p"))
    row = df.select("p", merkle.changes(F.col("a"), F.col("b")).alias("c"), merkle.likeness(F.col("a"), F.col("b")).alias("n"), F.size("a.sections").alias("sections")).first()
    assert [row.p[x.paragraph].strip() for x in row.c] == ["a new line", "CHANGED"] and row.sections > 10 and 0.9 < row.n < 1
    assert "".join(row.p) == after
    same = df.select(merkle.changes(F.col("a"), F.col("a")).alias("c"), merkle.likeness(F.col("a"), F.col("a")).alias("n")).first()
    assert same.c == [] and same.n == 1.0
    void = spark.createDataFrame([("", None, "x. y")], "a string, b string, c string").select(*[merkle.tree(F.col(c)).alias(c) for c in "abc"])
    found = void.select(merkle.likeness(F.col("a"), F.col("b")), F.size(merkle.changes(F.col("b"), F.col("c"))), F.size(merkle.changes(F.col("c"), F.col("a")))).first()
    assert tuple(found) == (1.0, 2, 0)


def test_fingerprints_shuffle_texts_once_and_stay_in_the_jvm(spark, docs):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        merkle.fingerprints(docs).explain()
    plan = out.getvalue()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=10):
    words = [TERM.findall(low(t)) for _, t in docs]
    n, length = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        query, scores = Counter(TERM.findall(low(text))), []
        for (i, _), w in zip(docs, words):
            if not w:
                continue
            tf, m = Counter(w), 25 + 75 * len(w) * n // length
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in query.items() if t in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(out, key=repr)


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]


def test_rank(spark, docs, rows):
    items = [(k, prose(k, 30) + " " + (rows[k][1] or "")[:80]) for k in range(12)] + [(20, None), (21, "unheardof word"), (22, ""), (3, prose(3, 30)), (None, rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = ranked([(r[0], r[1]) for r in rows], items)
    for block in (200_000, 40):  # one block, and several
        assert sorted(map(tuple, search.rank(docs, bench, block_terms=block).collect()), key=repr) == want
    assert sorted(map(tuple, search.rank(docs, bench, top=3).collect()), key=repr) == ranked([(r[0], r[1]) for r in rows], items, 3)


def test_rank_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, prose(1, 30) + " kan tola miro same"), (2, "kala mist")], "item_id long, text string")
    found = search.rank(clash(odd, search), clash(bench, search)).collect()
    assert sorted(map(tuple, found), key=repr) == ranked(pairs(odd.select("doc_id", "text")), pairs(bench))
    assert search.rank(empty, bench).count() == 0 and search.rank(odd, bench.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "kala"), ("a", "kala"), (None, "kala"), ("c", "other")], "doc_id string, text string")
    assert sorted((r.rank, r.doc_id) for r in search.rank(named, bench.where("item_id = 2")).collect()) == [(1, "a"), (2, "b"), (3, None)]


def test_pruning_skips_work_and_loses_nothing(spark):
    """Buckets and rows that cannot reach a score are not summed; what is left are the best, for random vectors."""
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randint(1, 120)))) for i in range(3000)]
    items = [(k, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(12))) for k in range(5)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, search.rank(a, b).collect()), key=repr) == ranked(docs, items)


# --- source audit ---

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least=10, top=10):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = LETTERS.findall(low(text))
        docs[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]
        mine = [s for g, s in groups if g == lang]
        total = {s: sum(n[lang, s][t] for t in kept) for s in mine}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in mine}
        q = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in mine) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        found = sorted((-sum(f(p[source][t], p[s][t]) for t in kept), s.encode(), s) for s in mine if s != source)
        out += [(lang, source, "pair", s, -v, k + 1) for k, (v, _, s) in enumerate(found)]
        found = sorted((-f(p[source][t], q[t]), t.encode(), t) for t in kept if n[lang, source][t] and p[source][t] > q[t])[:top]
        out += [(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,fan", [(64 << 20, 4096), (20_000, 4096), (3_000, 4)])
def test_audit(docs, rows, block, fan):
    """One run a task, several runs a task, and runs that are merged in rounds."""
    want = audited([(r[1], r[2], r[3]) for r in rows], least=6)
    assert sum(r[2] == "pair" for r in want) > 20 and sum(r[2] == "term" for r in want) > 20
    assert sorted(map(tuple, divergence.audit(docs, min_docs=6, block_bytes=block, fan=fan).collect())) == want


def test_audit_of_odd_rows(spark, odd, empty):
    found = divergence.audit(clash(odd, divergence), min_docs=2).collect()
    assert sorted(map(tuple, found)) == audited([(r.text, r.lang, r.source) for r in odd.collect()], least=2)
    bare = [(None, "a", "x"), ("", "a", "y"), ("one two", "b", None), ("one", None, None), ("été ABC", "c", "z")]
    frame = spark.createDataFrame(bare, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(frame, min_docs=1).collect())) == audited(bare, least=1)
    assert sorted(map(tuple, divergence.audit(frame).collect())) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
    assert divergence.audit(empty).count() == 0


def test_large_counts_stay_exact(spark):
    n = 90_000_000_000_000
    df = spark.createDataFrame([(n, 7 * n, 11)], "n long, total long, kept long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 2) // (7 * n + 22)


def test_merge_puts_out_what_is_complete():
    """Sorted terms, each in one table, while few postings are open at a time."""
    rng = random.Random(3)
    rows, want = [], Counter()
    for _ in range(20):
        terms = [f"a\0{t:05}" for t in sorted(rng.sample(range(20_000), 4000))]
        want.update(terms)
        for at in range(0, 4000, 100):
            mine = terms[at : at + 100]
            rows.append((mine[0], pa.array(mine), pa.array([1] * 100, pa.int32()), pa.array(["s"] * 100), pa.array([1] * 100), pa.array([2] * 100)))
    rows.sort(key=lambda r: r[0])
    tables = list(divergence.merged(iter(rows), gather=4000))
    keys = [k for t in tables for k in t["key"].to_pylist()]
    assert keys == sorted(want) and [d for t in tables for d in t["docs"].to_pylist()] == [want[k] for k in keys]
    assert len(tables) > 10 and max(t.num_rows for t in tables) < 10_000
    assert list(divergence.merged(iter([]))) == []
