"""Comparing datasets: overlap, leakage, formats and keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.features import norm, row_chunks, row_text
from quarry.functions.json import utf16_length
from quarry.functions.signature import hamming64, simhash64
from quarry.operators.aggregates import profile
from quarry.operators.dedup import MIN_UNITS, keys_of, slices
from quarry.plans.lineage import bounded, cut

#: Bytes of the shortest text that is looked for by anchors. Bytes of anchors: a text below WINDOW bytes is covered by anchors of the largest size that it holds, a longer one has the
#: least of the last size in each window.
GRAM, GRAMS, WINDOW = 8, (8, 16, 32, 64), 256
#: Different chunks, and bytes of them, up to which a side is taken to every task; long texts of an anchor, and candidates of a text, that one task takes.
SMALL_TEXTS, SMALL_BYTES, ANCHOR_BLOCK, CANDIDATES = 20_000, 1 << 21, 1024, 10_000
#: Bits of the filter of short texts' anchors (2 MB), whatever the input; two are set for each. A fuller one lets more through and loses nothing.
FILTER_BITS = 24
#: Base of the sums by which a text's parts are compared with shorter texts, and pairs of texts up to which they are broadcast.
BASE, FEW_PAIRS = 0x9E3779B97F4A7C15, 400_000


def exact_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(overlap, live, share): live rows of b whose serialised JSON is in a."""
    live = b.where("not deleted")
    known = a.where("not deleted and not error").select(F.sha2("json", 256).alias("h")).distinct()
    hit = live.where("not error").select(F.sha2("json", 256).alias("h")).join(known, "h", "left_semi").agg(F.count("*").alias("overlap"))
    return hit.crossJoin(live.agg(F.count("*").alias("live"))).withColumn("share", F.when(F.col("live") > 0, F.col("overlap") / F.col("live")).otherwise(0.0))


def _chunks(least: int) -> Column:
    """A row's normalised chunks of `least` characters up."""
    # an array of them is made first, so a chunk is normalised once, however often the length looks at it
    return F.filter(F.transform(row_chunks(), norm), lambda c: utf16_length(c) >= least)


def _signature(text: Column, min_units: int) -> Column:
    """Signature of a text, null below min_units units."""
    return F.when(utf16_length(text) >= min_units, simhash64(text))


def _texts(rows: DataFrame) -> DataFrame:
    """(row_id, k, c): the chunks of written rows (row_id, chunks), with their places."""
    return rows.select("row_id", F.posexplode("chunks").alias("k", "c"))


def _digest(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(data: bytes) -> np.ndarray:
    """Hashes of all runs of GRAM bytes."""
    return _mixed(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), GRAM).copy().view(np.uint64).ravel())


def _longer(data: bytes, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of all runs of so many bytes) for the sizes of GRAMS that a text holds, up to `most`."""
    for gram in GRAMS:
        if gram <= min(len(data), most):
            h = _hashes(data) if gram == GRAM else _mixed(h[: -gram // 2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gram // 2 :])  # noqa: F821
            yield gram, h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: step - width], h[width - step :]) if width > step else h


def _powers(n: int) -> np.ndarray:
    """1, BASE, BASE ** 2 and so on, modulo 2 ** 64."""
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sums(data: bytes, powers: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... bytes (and one), each times its power; modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def _marked(text: Column) -> Column:
    """Struct (total, anchors) of a text: its sum; from WINDOW bytes on the least hash of each window, below that hashes of the runs of bytes that it is cut into. A text inside another has them there too."""
    kind = pa.struct([("total", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<total:bigint,anchors:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        data = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
        powers = _powers(max(map(len, data), default=0))
        for d in data:
            h, gram = np.zeros(0, np.uint64), GRAM
            for gram, h in _longer(d, GRAMS[-1]):  # noqa: B007
                pass
            own = _least(h, WINDOW - gram + 1) if len(d) >= WINDOW else np.append(h[::gram], h[-1:])
            own = np.unique(own).view(np.int64).tolist()
            out.append({"total": int(_sums(d, powers)[-1:].view(np.int64)[0]), "anchors": own})
        return pa.array(out, kind)

    return of(text)


def _marks(texts: DataFrame, name: str) -> DataFrame:
    """(id, row_id, k, size, total, anchors) of the different texts, with a place of each; written."""
    found = texts.select(_digest("c").alias("id"), "row_id", "k", F.octet_length("c").alias("size"), _marked(F.col("c")).alias("m"))
    return cut(found.select("id", "row_id", "k", "size", "m.total", "m.anchors").dropDuplicates(["id"]), name)


def _filter(anchors: DataFrame) -> np.ndarray:
    """Filter of anchors (column anchor), in words of 64 bits. Spark makes its words; only those reach the driver."""
    most = (1 << FILTER_BITS) - 1
    bit = F.explode(F.array(F.col("anchor").bitwiseAND(most), F.shiftright("anchor", FILTER_BITS).bitwiseAND(most)))
    words = anchors.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("mask")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bits


def _filtered(text: Column, bits: np.ndarray, grams: list[int]) -> Column:
    """Array of the hashes of a text's runs of so many bytes (ascending) that pass a filter."""
    most = np.uint64((1 << FILTER_BITS) - 1)
    passed = lambda h, bit: h[(bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            data, found = t.encode("utf-8", "surrogatepass"), []
            for gram, h in _longer(data, grams[-1]):
                if gram in grams:
                    h = passed(h, h & most)
                    found += np.unique(passed(h, h >> np.uint64(FILTER_BITS) & most)).view(np.int64).tolist()
            out.append(found)
        return pa.array(out, pa.list_(pa.int64()))

    return of(text)


def _holds(text: Column, wanted: Column) -> Column:
    """Array of the ids of the wanted texts (id, size, total) that are inside a text.

    The sums of all its parts of a size are compared at once; one whose sum is right is inside if the MD5 of the part is its id.
    """

    @F.arrow_udf("array<binary>")
    def of(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out, powers = [], _powers(0)
        for t, each in zip(texts, wanted, strict=True):
            data, found = t.as_py().encode("utf-8", "surrogatepass"), []
            if len(powers) <= len(data):
                powers = _powers(len(data))
            sums = _sums(data, powers)
            for x in each.as_py():
                size, total = x["size"], np.uint64(x["total"] % (1 << 64))
                if size <= len(data):
                    at = np.flatnonzero(sums[size:] - sums[: len(sums) - size] == total * powers[: len(sums) - size])
                    if any(hashlib.md5(data[i : i + size]).digest() == x["id"] for i in at.tolist()):
                        found.append(x["id"])
            out.append(found)
        return pa.array(out, pa.list_(pa.binary()))

    return of(text, wanted)


def _inside(short: DataFrame, long: DataFrame, texts: DataFrame) -> DataFrame:
    """(s, l): ids of texts (marks; GRAM bytes up) where short's is inside a longer one, long's. texts: those of long, and others.

    A short text is looked for under one of its anchors, the one that fewest long texts have. Long texts post the anchors of their windows;
    of the runs of bytes that are anchors of texts below WINDOW bytes only those that pass a filter are posted. Only ids and hashes are joined for that. The
    candidates left go to a long text as sizes, sums and digests, so a text is moved once at most, and not once a candidate.
    An anchor that over ANCHOR_BLOCK long texts have is dealt into blocks, and so are over CANDIDATES candidates of a text.
    """
    mine = lambda df: df.select("id", F.size("anchors").alias("all"), F.explode("anchors").alias("anchor"))
    asked = cut(mine(short).select("anchor").distinct(), "asked")
    posted = mine(long.where(F.col("size") >= WINDOW)).select("id", "anchor").join(bounded(asked), "anchor", "left_semi")
    below = short.where((F.col("size") >= GRAM) & (F.col("size") < WINDOW))
    gram = F.greatest(*[F.when(F.col("size") >= g, g) for g in GRAMS])
    if grams := sorted(r[0] for r in below.select(gram).distinct().collect()):
        seen = texts.select(_digest("c").alias("id"), F.explode(_filtered(F.col("c"), _filter(mine(below)), grams)).alias("anchor"))
        seen = seen.join(bounded(asked), "anchor", "left_semi").join(bounded(long.select("id")), "id", "left_semi").select("id", "anchor")
        posted = posted.unionByName(seen).distinct()
    there = cut(posted, "anchors")
    counts = cut(there.groupBy("anchor").agg(F.count("*").alias("n")), "counts")
    # a text is inside only where all of its anchors occur somewhere
    rare = mine(short).join(bounded(counts), "anchor").groupBy("id", "all").agg(F.min(F.struct("n", "anchor")).alias("r"), F.count("*").alias("found")).where("found = all")
    rare = cut(rare.select(F.col("id").alias("s"), "r.anchor", F.ceil(F.col("r.n") / ANCHOR_BLOCK).cast("int").alias("parts")), "rare")
    hot = cut(rare.where("parts > 1").select("anchor", "parts").distinct(), "hot")
    dealt = there.join(bounded(hot), "anchor", "left").select(F.col("id").alias("l"), "anchor", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("block"))
    asking = rare.select("s", "anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    sizes = short.select(F.col("id").alias("s"), "size", "total")
    places = long.select(F.col("id").alias("l"), "row_id", "k", F.col("size").alias("room"))
    pairs = asking.join(sizes, "s").join(dealt, ["anchor", "block"]).join(places, "l").where("size < room")
    pairs = cut(pairs.select("s", "size", "total", "l", "row_id", "k"), "pairs")
    many = cut(pairs.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") > CANDIDATES).select("l", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("parts")), "many")
    block = F.pmod(F.xxhash64("s"), F.coalesce("parts", F.lit(1)))
    lists = pairs.join(bounded(many), "l", "left").groupBy("l", "row_id", "k", block.alias("block")).agg(F.collect_list(F.struct(F.col("s").alias("id"), "size", "total")).alias("wanted"))
    lists = cut(lists, "lists")
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        lists = F.broadcast(lists)
    return texts.join(lists, ["row_id", "k"]).select("l", F.explode(_holds(F.col("c"), F.col("wanted"))).alias("s"))


def _small(texts: DataFrame) -> list[str] | None:
    """Different texts (column c of a written table) if they are counted to be few and short enough to be taken to every task, else None."""
    sizes = texts.select(_digest("c").alias("id"), F.octet_length("c").alias("size")).distinct()
    n, size = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return [r[0] for r in texts.select("c").distinct().collect()] if n <= SMALL_TEXTS and size <= SMALL_BYTES else None


def _related(text: Column, small: list[str], all_of_them: bool) -> Column:
    """Array of places in `small` of the texts that are inside a text, or that it is inside; only the first found, or all of them.

    Hashes of the text's runs of GRAM bytes are looked up once for all small texts (one run of each); what they point to is compared directly.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in small]
    tiny = [i for i, d in enumerate(data) if len(d) < GRAM]
    longest = max(map(len, data), default=0)

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        runs = [(i, _hashes(d)) for i, d in enumerate(data) if len(d) >= GRAM]
        own: dict[int, list[int]] = {}
        for i, h in runs:
            own.setdefault(int(h.min()), []).append(i)
        keys = np.array(sorted(own), np.uint64)
        every = np.concatenate([h for _, h in runs] or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat([i for i, _ in runs], [len(h) for _, h in runs]).astype(np.int64)[order]

        def one(t: str) -> list[int]:
            d, found = t.encode("utf-8", "surrogatepass"), set()
            near = list(tiny)
            if len(d) >= GRAM and len(keys):
                h = _hashes(d)
                at = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
                for k in np.unique(h[at]).tolist():
                    near += own[k]
                if len(d) <= longest:
                    near += np.unique(owner[np.searchsorted(every, h[0]) : np.searchsorted(every, h[0], "right")]).tolist()
            elif len(d) < GRAM:
                near = range(len(small))
            for i in near:
                if small[i] in t or t in small[i]:
                    found.add(i)
                    if not all_of_them:
                        break
            return sorted(found)

        for texts in batches:
            yield pa.array([one(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return of(text)


def leakage_exact(a: DataFrame, b: DataFrame, min_len: int = 64) -> DataFrame:
    """(row_id) of rows of b with a normalised chunk (8 characters up) that contains, or is inside, a chunk of a (min_len up).

    A side that is counted to have at most SMALL_TEXTS different chunks of SMALL_BYTES in all is taken to every task and looked for in one
    scan of the other side. Two larger sides meet through anchors, in both directions. The rows are the same either way.
    """

    read = lambda rows, least, name: cut(rows.where("not deleted").select("row_id", _chunks(least).alias("chunks")), name)
    return _exact(read(a, min_len, "chunks_a"), read(b, 8, "chunks_b"))


def _exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """leakage_exact() of written rows (row_id, chunks)."""
    left, right = _texts(a), _texts(b)
    if (small := _small(left)) is not None:
        return right.where(F.size(_related(F.col("c"), small, False)) > 0).select("row_id").distinct()
    if (small := _small(right)) is not None:
        hits = left.select(F.explode(_related(F.col("c"), small, True)).alias("i")).distinct()
        digests = left.sparkSession.createDataFrame([(i, hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()) for i, t in enumerate(small)], "i int, id binary")
        hits = cut(hits.join(F.broadcast(digests), "i").select("id"), "hits")
    else:
        mine, theirs = _marks(right, "marks_b"), _marks(left, "marks_a")
        # what is known to leak is looked for no more
        known = lambda df, name: cut(mine.join(df, "id", "left_semi").select("id"), name)
        rest = lambda *seen: cut(reduce(lambda df, hits: df.join(bounded(hits), "id", "left_anti"), seen, mine), "rest")
        equal = known(theirs, "equal")
        within = known(_inside(rest(equal), theirs, left).select(F.col("s").alias("id")), "within")
        around = known(_inside(theirs, rest(equal, within), right).select(F.col("l").alias("id")), "around")
        hits = equal.unionByName(within).unionByName(around)
    return right.select("row_id", _digest("c").alias("id")).join(bounded(hits), "id", "left_semi").select("row_id").distinct()


def leakage_near(a: DataFrame, b: DataFrame, max_hamming: int = 4, min_units: int = MIN_UNITS) -> DataFrame:
    """(row_id, match_a): for rows of b the first row of a whose signature differs in at most max_hamming bits; texts of min_units units up on both sides."""

    read = lambda rows: cut(rows.where("not deleted").select("row_id", row_text().alias("t")).select("row_id", _signature(F.col("t"), min_units).alias("sig")), "signatures")
    return _near(read(a), read(b), max_hamming)


def _near(a: DataFrame, b: DataFrame, max_hamming: int) -> DataFrame:
    """leakage_near() of written rows (row_id, sig)."""
    x = cut(a.where("sig is not null").groupBy("sig").agg(F.min("row_id").alias("match_a")), "sigs_a")
    y = b.where("sig is not null").select("row_id", "sig")
    shape = slices(x.count() + y.count(), max_hamming)
    keyed = lambda df, *cols: df.select(*cols, F.explode(keys_of(F.col("sig"), *shape)).alias("k")).select(*cols, "k.key", "k.bits")
    left = keyed(x, "sig", "match_a").withColumnRenamed("sig", "x")
    near = keyed(y.select("sig").distinct(), "sig").join(left, ["key", "bits"]).where(hamming64(F.col("sig"), F.col("x")) <= max_hamming).groupBy("sig").agg(F.min("match_a").alias("match_a"))
    return y.join(near, "sig").select("row_id", "match_a")


def leakage(a: DataFrame, b: DataFrame, min_len: int = 64, max_hamming: int = 4, min_units: int = MIN_UNITS) -> DataFrame:
    """(row_id, kind, match_a) of leaking rows of b: exact, or else near. Rows are scanned once; what is written of them is their chunks and signatures."""

    def read(rows: DataFrame, least: int, name: str) -> DataFrame:
        texts = rows.where("not deleted").select("row_id", row_text().alias("t"), _chunks(least).alias("chunks"))  # a text is made once, for its length and its signature
        return cut(texts.select("row_id", _signature(F.col("t"), min_units).alias("sig"), "chunks"), name)

    a, b = read(a, min_len, "read_a"), read(b, 8, "read_b")
    exact = cut(_exact(a, b), "exact")
    near = _near(a, b, max_hamming).join(exact, "row_id", "left_anti")
    return exact.select("row_id", F.lit("exact").alias("kind"), F.lit(None).cast("long").alias("match_a")).unionByName(near.select("row_id", F.lit("near").alias("kind"), "match_a"))


def format_mix_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fmt, n_a, n_b, delta) over the live rows of both."""
    count = lambda df, name: df.where("not deleted").groupBy("fmt").agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = count(a, "x").join(count(b, "y"), "fmt", "full_outer")
    return both.select("fmt", zero("x").alias("n_a"), zero("y").alias("n_b"), (zero("y") - zero("x")).alias("delta"))


def key_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, side): `a`, `both` or `b`."""
    keys = lambda df, side: df.where("not deleted").select(F.explode("top_keys").alias("key")).distinct().withColumn(side, F.lit(True))
    both = keys(a, "x").join(keys(b, "y"), "key", "full_outer")
    return both.select("key", F.when(F.col("x").isNull(), "b").when(F.col("y").isNull(), "a").otherwise("both").alias("side"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: live rows, dominant format and its share on both sides, overlap, and keys by side."""
    top = lambda df, s: profile(df).where("place = 1").select(F.col("total").alias(f"live_{s}"), F.col("fmt").alias(f"dominant_{s}"), F.col("share").alias(f"share_{s}"))
    sides = key_delta(a, b).agg(*[F.count_if(F.col("side") == s).alias(f"keys_{s}") for s in ("a", "both", "b")])
    return top(a, "a").crossJoin(top(b, "b")).crossJoin(exact_overlap(a, b).select("overlap", F.col("share").alias("overlap_share"))).crossJoin(sides)
