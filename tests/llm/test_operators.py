"""Each operator against brute force on a small table, and on odd rows and an empty table."""

import hashlib
import json
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, hierbayes, langid, linededup, mixing, quality, sharding, simhash, suffix, toolchat
from quarry.operators.graph import connected_components

BLANK = " \t\n\x0b\x0c\r"


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# --- 1 ---


def test_mix(docs, rows):
    r = got(mixing.mix(docs))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert {k: v["size"] for k, v in r.items()} == sizes
    total = {}
    for i, _, _, s, _ in rows:
        total[s] = total.get(s, 0) + sizes[i]
    order = sorted((s for s in total if s), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        open_ -= full
    for i, _, _, s, _ in rows:
        assert r[i]["source_size"] == total[s] and r[i]["target"] == pytest.approx(target[s])
        assert r[i]["taken"] <= 3 * sizes[i] and (not sizes[i] or r[i]["taken"] % sizes[i] == 0)
    for s in order:
        mine = [i for i, _, _, x, _ in rows if x == s]
        assert abs(sum(r[i]["taken"] for i in mine) - target[s]) <= max(sizes[i] for i in mine) / 2 + 1
    assert {k: v["taken"] for k, v in got(mixing.mix(docs.repartition(5))).items()} == {k: v["taken"] for k, v in r.items()}


def test_take(docs):
    """Rows come as often as mix() says."""
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, max_repeat=2).collect()}
    taken = Counter(r["doc_id"] for r in mixing.take(docs, max_repeat=2).collect())
    assert {k: n for k, n in copies.items() if n} == taken and max(copies.values()) > 0


def test_mix_odd(odd, empty):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0


# --- 2 ---


def plain_fingerprint(text):
    import xxhash

    w = low(text or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(items, linked):
    label = dict.fromkeys(items)
    for k in items:
        if label[k] is None:
            label[k], todo = k, [k]
            while todo:
                a = todo.pop()
                for b in items:
                    if label[b] is None and linked(a, b):
                        label[b] = k
                        todo.append(b)
    return label


def test_simhash(docs, rows):
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    label = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("x"), "component_id")
    assert {r["doc_id"]: (r["x"], r["component_id"]) for r in found.collect()} == {k: (f"{fps[k]:016x}", label[k]) for k in fps}


def test_near_edges_dense(spark):
    """Fingerprints that differ in few bits, in lists over the size at which neighbours are looked up."""
    import random

    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ (x << 13) for x in range(600)} | {base ^ (1 << 50) ^ (1 << 3), rng.getrandbits(64), base ^ (1 << 62) ^ (1 << 40)}
    df = spark.createDataFrame([(f.to_bytes(8, "little"),) for f in fps], "fp binary")
    label = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    edges = [(int.from_bytes(a, "little"), int.from_bytes(b, "little")) for a, b in simhash.near_edges(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    near = {f: {f} for f in fps}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    assert components(sorted(fps), lambda a, b: b in near[a]) == label
    assert len(edges) < 30 * len(fps)


def test_near_edges_crowded(spark):
    """A list over `crowd` is posted anew under finer sets, and no pair is lost."""
    import random

    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f.to_bytes(8, "little"),) for f in fps], "fp binary")
    one, two = (connected_components(simhash.near_edges(df, crowd=c)).collect() for c in (1 << 20, 50))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) >= 2016


def shingle_set(i, n=200):
    import random

    return random.Random(i).sample(range(1 << 32), n)


def signed(rows):
    """(node, fp, shingles) of sets of 32-bit numbers."""
    import numpy as np

    out = []
    for s in rows:
        a = np.unique(np.array(s, np.uint32))
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
        out.append((hashlib.md5(a.tobytes()).digest(), simhash.sampled_bytes(h), a.tobytes()))
    return out


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_similar_edges_recall(spark):
    """Pairs by exact similarity: those at 0.80 to 0.85 are joined in 97 % or more, those below 0.8 never."""
    import random

    rng, rows, want = random.Random(4), [], []
    for i in range(600):
        a = shingle_set(i)
        k = rng.randint(14, 30)  # changed shingles of 200
        b = a[k:] + shingle_set(i + 10_000, k)
        rows += [a, b]
        want.append(jaccard(a, b))
    made = signed(rows)
    edges = {frozenset(map(bytes, e)) for e in simhash.similar_edges(spark.createDataFrame(made, "node binary, fp binary, shingles binary")).collect()}
    joined = [frozenset((made[2 * i][0], made[2 * i + 1][0])) in edges for i in range(600)]
    near = [j for j, w in zip(joined, want) if 0.8 <= w < 0.85]
    assert len(near) > 100 and sum(near) >= 0.97 * len(near)
    assert not any(j for j, w in zip(joined, want) if w < 0.8) and len(edges) == sum(joined)


def test_similar_edges_crowded(spark):
    """A star of near copies and loosely linked pairs in lists that are dealt into many blocks: components are those of all similar pairs."""
    import random

    rng, base = random.Random(5), shingle_set(1)
    rows = [base] + [base[k:] + shingle_set(100 + i, k) for i in range(120) for k in [rng.randint(1, 30)]]
    df = spark.createDataFrame(signed(rows), "node binary, fp binary, shingles binary")
    one, two = (connected_components(simhash.similar_edges(df, block=b)).collect() for b in (1000, 8))
    label = components(range(len(rows)), lambda a, b: jaccard(rows[a], rows[b]) >= 0.8)
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert len(one) == sum(1 for k in label if sum(v == label[k] for v in label.values()) > 1)


def test_similar_copies(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    left = {x["doc_id"] for x in kept.collect()}
    assert not {10, 11, 12} & left and 2 in left
    assert {13, 14, 15} & left == {13}  # no words: one group
    assert len(left) >= docs.count() - 8


def test_simhash_odd(odd, empty):
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.keep_first(odd).where("doc_id = 3").count() == 1
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_keep_first_ids(spark):
    """Clean texts without an id, or under one id, are all kept; a near copy under an id that is kept elsewhere goes."""
    from conftest_rows import prose

    copy = prose(5) + " tail"
    rows = [(None, prose(i)) for i in range(4)] + [(None, prose(0))] + [(7, prose(4)), (7, prose(5)), (6, prose(6)), (None, prose(6)), (8, copy), (6, copy), (9, prose(9)), (9, prose(9))]
    kept = sorted(map(str, map(tuple, simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert kept == sorted(map(str, [(None, prose(i)) for i in range(4)] + [(7, prose(4)), (6, prose(6)), (6, copy), (9, prose(9))]))


# --- 3 ---


def check_shards(found, n, shards):
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(docs, rows, spark):
    found = sharding.shard(docs).collect()
    check_shards(found, len(rows), 24)
    for r in found:
        t = (rows[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 130, "hot").otherwise((F.col("id") / 3).cast("int").cast("string")).alias("text"))
    found = sharding.shard(many, shards=6).collect()
    check_shards(found, 400, 6)
    groups = {}
    for r in found:
        if r["doc_id"] >= 132:
            groups.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert all(len(v) == 1 for v in groups.values())
    again = sharding.shard(many.repartition(7), shards=6).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_shards_whole_groups(spark):
    """Groups of up to a shard's size stay whole though they fill half of all shards; the largest one is cut at shard ends only."""
    sizes = [45, 40, 38, 30, 22, 20, 17, 9, 5, 5, 4, 3, 2, 2]
    rows = [(1000 * k + i, f"text {k}") for k, n in enumerate(sizes) for i in range(n)] + [(10**6 + i, f"own {i}") for i in range(240)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    check_shards(found, len(rows), 10)
    homes = {}
    for r in found:
        if r["doc_id"] < 10**6:
            homes.setdefault(r["doc_id"] // 1000, set()).add(r["shard"])
    assert all(len(homes[k]) == 1 for k, n in enumerate(sizes) if n <= 48)


def test_shards_odd(odd, empty):
    check_shards(sharding.shard(odd).collect(), odd.count(), 24)
    assert sharding.shard(empty).count() == 0


# --- 4 ---


def test_lines(docs, rows):
    keys = [[low(x.strip(BLANK)) for x in (t or "").split("\n")] for _, t, *_ in rows]
    seen = Counter(k for ks in keys for k in set(ks))
    r = got(linededup.drop_frequent_lines(docs))
    for (i, t, *_), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if not (k and seen[k] >= 10)]
        assert (r[i]["n_lines"], r[i]["n_dropped"], r[i]["kept_text"]) == (len(ks), len(ks) - len(kept), "\n".join(kept))
    assert sum(v["n_dropped"] for v in r.values()) == 15


def test_lines_levels(spark):
    with linededup.LineRuns(spark, 3, fanout=2) as runs:
        for batch in ([1, 2], [1, 2, 4], [1, 3], [1, 4], [4, 5]):
            runs.add(spark.createDataFrame([(x, x) for x in batch], "h long, g long"))
        assert {r[0] for r in runs.frequent().collect()} == {1, 4}
        assert len(runs.levels) > 2 and runs.full
        counts = spark.table(runs.levels[-1][0])
        plan = runs.unseen(counts)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        names = [*runs.full, *(n for level in runs.levels for n in level)]
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_odd(odd, empty):
    out = linededup.drop_frequent_lines(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert linededup.drop_frequent_lines(empty).count() == 0


# --- 5 ---


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if tri[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, rows):
    r = got(quality.quality(docs))
    for i, t, *_ in rows:
        s = plain_stats(t)
        assert tuple(r[i][c] for c in quality.STATS) == s
        assert r[i]["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (r[i]["base_failed"] and r[i]["kept"])
    assert all(r[i]["kept"] for i in range(21, 60) if not r[i]["base_failed"])


def test_quality_outliers(spark):
    from conftest_rows import prose

    good = [(i, prose(i), "xa", "s") for i in range(150)]
    bad = [(1000 + i, prose(i).replace(" ", " ###|$$ "), "xa", "s") for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    r = got(quality.quality(df))
    assert all(r[i]["kept"] for i, *_ in good) and not any(r[i]["kept"] for i, *_ in bad)
    kept = {x["doc_id"] for x in quality.keep_good(df).collect()}
    assert kept == {k for k, v in r.items() if v["kept"]}


def test_mcd_brute_force(spark):
    """The least determinant over all halves of 14 rows, by trying each. Concentration ends in a local minimum: the estimate's standard deviations are within 3 % of the best on average."""
    import itertools
    import random

    import numpy as np

    rng = random.Random(6)
    x = np.array([[rng.gauss(0, 0.05) for _ in range(5)] for _ in range(9)] + [[rng.gauss(8, 2) for _ in range(5)] for _ in range(5)])
    factor, floor = quality.consistency(0.5, 5), quality.FLOOR**2 * np.eye(5)
    least = min(np.linalg.slogdet(factor * np.cov(x[list(c)].T, bias=True) + floor)[1] for c in itertools.combinations(range(14), 7))
    df = spark.createDataFrame([("g", r.tolist()) for r in x] + [("one", x[0].tolist())], "group string, x array<double>")
    r = got(quality.mcd(df), "group")
    assert np.linalg.slogdet(np.array(r["g"]["cov"]).reshape(5, 5))[1] <= least + 2 * 5 * 0.03
    assert abs(np.array(r["g"]["mean"])).max() < 0.2 and r["one"]["mean"] == pytest.approx(x[0].tolist())


def test_chi_squared():
    assert quality.chi_quantile(0.5, 5) == pytest.approx(4.3515, abs=1e-3) and quality.chi_quantile(1e-6, 5, above=True) == pytest.approx(35.89, abs=0.05)
    assert quality.chi_squared(4.3515, 7) == pytest.approx(0.2614, abs=2e-3)


@pytest.mark.parametrize("n", [75, 123])
def test_quality_large_outlier_groups(spark, n):
    """A third, or 45 %, of a cell's rows are junk."""
    from conftest_rows import prose

    good = [(i, prose(i), "xa", "s") for i in range(150)]
    bad = [(1000 + i, prose(i).replace(" ", "### "), "xa", "s") for i in range(n)]
    assert not any(100 * s[4] > 50 * s[0] for s in (plain_stats(t) for _, t, *_ in bad))
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    assert {x["doc_id"] for x in quality.keep_good(df).collect()} == set(range(150))


def vectors(spark, seed, cov, n=4000):
    """Normal vectors about one mean."""
    import numpy as np

    x = np.random.default_rng(seed).multivariate_normal([5.5, 1.6, 0.05, 0.05, 0.05], cov, n)
    return spark.createDataFrame([("xa", "s", r.tolist()) for r in x], "lang string, source string, x array<double>")


def test_quality_estimates_decide(spark):
    """Estimates are near the truth, the median distance is that of chi-squared, and a change of the covariance alone changes the verdict; no fixed diagonal gives both verdicts."""
    import numpy as np

    spread = np.array([0.8, 0.03, 0.02, 0.02, 0.02])
    corr = np.eye(5)
    corr[0, 1] = corr[1, 0] = 0.9
    joint, alone_ = np.outer(spread, spread) * corr, np.diag(spread**2)
    odd = [5.5 + 2.5 * 0.8, 1.6 - 2.5 * 0.03, 0.05, 0.05, 0.05]  # usual in each coordinate, not in both together where they go together
    verdict = {}
    for name, cov in (("joint", joint), ("alone", alone_)):
        e = quality.estimate(vectors(spark, 1, cov)).first()
        found = np.linalg.inv(np.array(e.precision).reshape(5, 5))
        assert np.allclose(np.sqrt(np.diag(found)), spread, rtol=0.15) and e.most == pytest.approx(quality.chi_quantile(quality.LEVEL, 5, above=True), rel=0.1)
        d2 = lambda x: float((np.array(x) - e.mean) @ np.array(e.precision).reshape(5, 5) @ (np.array(x) - e.mean))  # noqa: B023, E731
        assert np.median([d2(r.x) for r in vectors(spark, 2, cov, 1000).collect()]) == pytest.approx(4.35, rel=0.15)
        verdict[name] = d2(odd) <= e.most
    assert verdict == {"joint": False, "alone": True}


def test_quality_median_distance(spark):
    """On prose the squared distances are those of a calibrated estimate; many copies do not take the estimate over."""
    from conftest_rows import prose

    rows = [(i, prose(i, 60 + 15 * (i % 40)), "xa", f"s{i % 2}") for i in range(600)]
    copies = [(1000 + i, prose(1), "xa", "s0") for i in range(900)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string")
    r = got(quality.quality(df))
    mine = sorted(r[i]["d2"] for i in range(600) if not r[i]["base_failed"])
    assert 3 < mine[len(mine) // 2] < 7 and sum(r[i]["kept"] for i in range(600)) >= 0.97 * len(mine)
    assert len({r[i]["kept"] for i in range(1000, 1900)}) == 1


def test_quality_odd(odd, empty):
    assert quality.quality(odd).count() == odd.count()
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.quality(empty).count() == 0


# --- 6 ---


def test_language(docs, rows):
    r = got(langid.identify(docs))
    for i, t, lang, *_ in rows:
        assert r[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not t or not t.strip():
            assert (r[i]["lang_pred"], r[i]["score"]) == ("und", 0.0)
        elif lang and i not in (16, 18):
            assert r[i]["lang_pred"] == ("xa" if i in (2, 10, 11, 12) else lang)
        assert 0 <= r[i]["score"] <= 1


def test_language_ignores_labels_of_held_out(docs):
    swapped = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    pick = lambda df: {k: (v["lang_pred"], v["score"]) for k, v in got(langid.identify(df)).items()}
    assert pick(swapped) == pick(docs)


def test_language_filter():
    import numpy as np

    grams = langid.trigrams("abcdef ghij")
    assert len(grams) == 12 - 1 and len(langid.trigrams("12 !")) == 0 and len(langid.trigrams(None)) == 0
    cells = np.zeros((1 << 12, 2), np.uint64)
    for c in langid.cells_of(grams, 12):
        cells[c, 1] |= np.uint64(1 << 3)
    f = langid.Filter([f"l{i:02d}" for i in range(68)], 12, cells)
    assert f.shares(grams)[67] == 1.0 and f.shares(grams)[0] == 0.0


def test_language_odd(odd, empty):
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_brute_force(docs, rows):
    """Shares of each document's trigrams in the exact sets of the languages: same winners and, but for chance hits of the filter, same scores."""
    import math

    learned = [(t, lang) for i, t, lang, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang]
    known = {}
    for lang in {x for _, x in learned}:
        mine = [set(langid.trigrams(t).tolist()) for t, x in learned if x == lang]
        seen = Counter(g for s in mine for g in s)
        least = max(math.ceil(len(mine) * 0.02), min(len(mine), 2))
        known[lang] = {g for g, n in seen.items() if n >= least}
    r = got(langid.identify(docs))
    for i, t, *_ in rows:
        grams = langid.trigrams(t).tolist()
        if grams:
            share = {x: sum(g in k for g in grams) / len(grams) for x, k in sorted(known.items())}
            best = max(share, key=share.get)
            assert r[i]["lang_pred"] == best
            assert abs(r[i]["score"] - share[best] / sum(share.values())) < 0.05


# --- 7 ---


def test_tool_calls(spark):
    schema = {"add": {"a": {"type": "integer", "required": True, "minimum": 0}, "note": {"type": "string", "maxLength": 3}}}
    raw = [
        (1, 0, "user", "plain \"text\"\n"),
        (1, 5, "assistant", '{"id": "c1", "name": "add", "arguments": {"note": "long one", "b": 1, "a": -1}}'),
        (1, 2, "tool", '{"tool_call_id": "c1", "content": "3"}'),
        (1, 3, "tool", '{"tool_call_id": "none", "content": null}'),
        (2, 0, "assistant", '{"id": "c1", "name": "nix", "arguments": [1]}'),
        (2, 1, "assistant", '{"id": "c2", "name": "add", "arguments": {"a": 2}}'),
        (2, 2, None, None),
        (None, 0, "assistant", '{"id": "c1", "name": "add", "arguments": {"a": 1}}'),
    ]
    df = spark.createDataFrame(raw, "conv_id long, turn long, role string, text string")
    r = {(x["conv_id"], x["turn"]): x for x in toolchat.link_calls(toolchat.parse_messages(df), schema).collect()}
    assert len(r) == len(raw)
    assert r[1, 5]["errors"] == "a:minimum,note:maxLength,b:unexpected" and r[1, 5]["linked"]
    assert r[1, 5]["json"] == '{"role":"assistant","tool_call":{"arguments":{"a":-1,"b":1,"note":"long one"},"id":"c1","name":"add"}}'
    assert (r[1, 2]["order_turn"], r[1, 2]["order_step"], r[1, 2]["linked"]) == (5, 1, True)
    assert not r[1, 3]["linked"] and r[1, 3]["json"] == '{"content":null,"role":"tool","tool_call_id":"none"}'
    assert r[2, 0]["errors"] == "tool:unknown" and r[2, 1]["errors"] == "" and not r[2, 1]["linked"]
    assert r[2, 2]["json"] == '{"content":null,"role":null}' and not r[None, 0]["linked"]
    assert r[1, 0]["json"] == '{"content":"plain \\"text\\"\\n","role":"user"}'
    assert toolchat.link_calls(toolchat.parse_messages(df.limit(0)), schema).count() == 0


def test_tool_chains(spark):
    """Chains over several calls, several calls in a message, arguments in a string, repeated identifiers, circles and clashing columns."""
    call = lambda i, after=None: json.dumps({"id": i, "name": "f", "arguments": '{"x": 1}', "after": after})
    raw = [
        (1, 1, call("d", "c")), (1, 2, call("c", "b")), (1, 3, call("b", "a")), (1, 4, call("a")),
        (1, 9, json.dumps({"tool_call_id": "a", "content": "late"})),
        (2, 1, json.dumps({"tool_calls": [{"id": "p", "function": {"name": "f", "arguments": '{"x": 1}'}}, {"id": "q", "function": {"name": "f", "arguments": "no json"}}]})),
        (2, 2, call("p")),
        (3, 1, call("u", "v")), (3, 5, call("v", "u")), (3, 7, call("w", "none")),
    ]
    df = spark.createDataFrame([(c, t, "assistant", x, 1, "y") for c, t, x in raw], "conv_id long, turn long, role string, text string, v int, c string")
    r = {(x["conv_id"], x["turn"], x["part"]): x for x in toolchat.link_calls(toolchat.parse_messages(df), {"f": {"x": {"type": "integer"}}}).collect()}
    at = {k: (x["order_turn"], x["order_step"]) for k, x in r.items()}
    assert (at[1, 4, 0], at[1, 9, 0], at[1, 3, 0], at[1, 2, 0], at[1, 1, 0]) == ((4, 0), (9, 0), (9, 2), (9, 3), (9, 4))
    assert r[2, 1, 0]["errors"] == "" and r[2, 1, 1]["errors"] == "arguments:type" and r[2, 2, 0]["errors"] == "id:repeated"
    assert r[2, 1, 0]["json"] == '{"role":"assistant","tool_call":{"arguments":{"x":1},"id":"p","name":"f"}}'
    assert at[3, 7, 0] == (7, 0) and at[3, 1, 0] == (1, 0) and at[3, 5, 0] == (5, 0) and len(r) == 11


# --- 8 ---


def plain_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, names = word.findall(low(text or "")), set(), set()
    for i, t in items:
        iw = word.findall(low(t or ""))
        for k in range(max(1, len(iw) - 9)) if iw else ():
            p = iw[k : k + 10]
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    names.add(str(i))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination(spark, docs, rows, block):
    items = [(1, rows[40][1][:200]), (2, rows[30][1]), (10, "schung"), (11, "karo kala"), (4, None), (5, "..."), (1, rows[40][1][:200]), (6, "漢字"), (7, "ßtraße 漢字!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r = got(decontam.find_items(docs, bench, block_windows=block))
    for i, t, *_ in rows:
        assert (r[i]["n_words"], r[i]["n_hit"], r[i]["items"]) == plain_hits(t, items)
        assert r[i]["contaminated"] == (r[i]["n_hit"] > 0)


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(None, "ka to"), (1, None)], "item_id long, text string")
    assert decontam.find_items(odd, bench).count() == odd.count()
    assert decontam.find_items(empty, bench).count() == 0
    assert not decontam.find_items(odd, bench.limit(0)).where("contaminated").count()


# --- 9 ---


def plain_removed(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, x in zip(b, cover) if not x)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("pieces", [20_000, 1])
def test_suffixes(docs, rows, pieces, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_PIECES", pieces)
    r = got(suffix.remove_repeats(docs))
    want = plain_removed(rows)
    assert {k: tuple(v[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for k, v in r.items()} == want
    assert sum(v[1] > 0 for v in want.values()) >= 4


def test_suffix_array():
    import random

    rng = random.Random(5)
    for _ in range(500):
        text = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffixes_odd(odd, empty):
    out = suffix.remove_repeats(odd)
    assert out.count() == odd.count()
    assert out.where("doc_id = 3").select("kept_sha256").distinct().count() == 1
    assert suffix.remove_repeats(empty).count() == 0


# --- 10 ---


def test_sites(spark):
    """Rates against the formulas in plain numbers, and a document's own value left out."""
    rows = [("big", "big/a", 1.0)] * 80 + [("big", "big/a", 0.0)] * 20 + [("bad", "bad/a", 0.0)] * 90 + [("bad", "bad/b", 1.0)] * 2 + [(None, None, 1.0)]
    found, overall, strong, weak = hierbayes.sites(spark.createDataFrame(rows, "host string, path string, p double"), "p")
    assert overall == pytest.approx(83 / 193)
    rated = found.withColumn("own", F.when(F.col("path") == "bad/b", 1.0).otherwise(0.0)).withColumn("r", F.struct(*hierbayes._rates(overall, strong, weak, F.col("own"))))
    got_ = {r["path"]: r["r"][1] for r in rated.collect()}
    host = lambda good, n: (good + strong * overall) / (n + strong)
    path = lambda good, n, h: (good + weak * h) / (n + weak)
    assert got_["big/a"] == pytest.approx(path(80, 99, host(80, 99))) and got_["bad/a"] == pytest.approx(path(0, 89, host(2, 91)))
    assert got_["bad/b"] == pytest.approx(path(1, 1, host(1, 91))) and got_[None] == pytest.approx(path(1, 0, host(1, 0)))


def test_classifier(spark):
    from conftest_rows import prose

    text = lambda i: prose(i) + (" moron scum idiot" if i % 5 == 0 else "")
    junk = lambda i: " | ".join(prose(i).upper().split())
    df = spark.createDataFrame([(i, junk(i) if i % 4 == 1 else text(i), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 5 == 0 and i % 4 != 1)) for i in range(0, 120)] + [(500, None, 1)], "doc_id long, quality int, toxic int")
    r = got(hierbayes.classify(df, labels, F.col("source"), F.col("source")))
    rest = [i for i in range(120, 200)]
    right = [r[i]["kept"] == (i % 4 != 1 and i % 5 != 0) for i in rest]
    assert sum(right) >= 0.95 * len(rest)
    assert all(0 <= r[i][c] <= 1 for i in rest for c in ("quality_doc", "host_quality", "path_quality", "quality", "toxic"))


def test_classifier_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert hierbayes.classify(odd, labels, F.col("source"), F.col("lang")).count() == odd.count()
    assert not hierbayes.classify(odd, labels.limit(0), F.col("source"), F.col("lang")).where("quality <> 0.5").count()
    assert hierbayes.classify(empty, labels, F.col("source"), F.col("lang")).count() == 0
