"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from quarry.llm.text import small_batches, utf8
from quarry.operators.graph import connected_components
from quarry.plans.lineage import bounded, cut, lookup

#: Bit counts of every byte value, bit 0 first: row v holds the bits of v.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles of a lower-cased text, repeats included; uint64."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, 42)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])), np.uint64, len(starts))


def majority_bits(h: np.ndarray) -> bytes:
    """Little-endian 64-bit fingerprint: a bit is 1 if set in over half the hashes."""
    cols = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    if len(h) < 64:
        ones = _BITS[cols].sum(0).reshape(-1)
    else:  # count byte values first: 8 passes over the hashes instead of 64
        ones = np.concatenate([np.bincount(cols[:, i], minlength=256) @ _BITS for i in range(8)])
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def fingerprint(text: Column, width: int = 3) -> Column:
    """Binary fingerprint of 8 bytes, least significant first. No words (or null): all zero."""

    @F.arrow_udf(BinaryType())
    def of(texts: pa.Array) -> pa.Array:
        zero = bytes(8)
        return pa.array([majority_bits(h) if len(h := shingle_hashes(t.as_py(), width)) else zero for t in texts], pa.binary())

    return of(utf8(text))


def hex_digits(fp: Column, n_bytes: int = 8) -> Column:
    """Lower-case hexadecimal digits, most significant first."""
    return F.lower(F.hex(F.concat(*[F.substring(fp, i + 1, 1) for i in reversed(range(n_bytes))])))


def _breadth_first(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row, row) of a list of n rows: near(left, at) tells which rows of left are linked to row `at`.

    Rows are visited from the least one; one edge is kept for each newly reached row, so nothing
    grows with the square of the list.
    """
    left, src, dst = np.arange(n), [], []
    while len(left):
        todo, left = deque([left[0]]), left[1:]
        while todo and len(left):
            at = todo.popleft()
            linked = near(left, at)
            found, left = left[linked], left[~linked]
            todo.extend(found)
            src.extend([at] * len(found))
            dst.extend(found)
    return np.array(src, int), np.array(dst, int)


_PAIR = StructType([StructField("src", BinaryType()), StructField("dst", BinaryType())])
_PAIRS = pa.list_(pa.struct([("src", pa.binary()), ("dst", pa.binary())]))


# --- fingerprints of 64 bits, linked at few differing bits ---------------------------


def _close(fps: np.ndarray, most: int):
    """near() of fingerprints (n, 8): tallies the positional bytes that each shares, and compares the bits of those that reach the minimum."""
    words = np.ascontiguousarray(fps).view(np.uint64).ravel()

    def near(left: np.ndarray, at: int) -> np.ndarray:
        linked = (fps[left] == fps[at]).sum(1) >= 8 - most
        linked[linked] = np.bitwise_count(words[left[linked]] ^ words[at]) <= most
        return linked

    return near


def _close_in_two(low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of rows that differ in two bytes only (values of low, all different): looks each row's neighbours up."""
    at = np.full(65536, -1)
    at[low] = np.arange(len(low))
    src, dst = [], []
    for k in range(1, most + 1):
        for bits in itertools.combinations(range(16), k):
            there = at[low ^ sum(1 << b for b in bits)]
            ok = (there >= 0) & (np.arange(len(low)) < there)
            src.append(np.flatnonzero(ok))
            dst.append(there[ok])
    return np.concatenate(src), np.concatenate(dst)


def _edges(list_of: Column, most: int) -> Column:
    @F.arrow_udf(ArrayType(_PAIR))
    def of(lists: pa.Array) -> pa.Array:
        out = []
        for members in lists:
            raw = sorted(members.as_py())
            fps = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 8)
            free = np.flatnonzero((fps != fps[0]).any(0))
            if len(raw) > 256 and len(free) <= 2:
                free = [*free, *(i for i in range(8) if i not in free)][:2]
                src, dst = _close_in_two(fps[:, free].astype(np.int64) @ [1, 256], most)
            else:
                src, dst = _breadth_first(len(raw), _close(fps, most))
            out.append([{"src": raw[i], "dst": raw[j]} for i, j in zip(src, dst)])
        return pa.array(out, _PAIRS)

    return of(list_of)


def _postings(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """Array of (set, bytes): the bytes of fp at each set of positions."""
    return F.array(*[F.struct(F.lit(k).alias("set"), F.concat(*[F.substring(fp, i + 1, 1) for i in s]).alias("bytes")) for k, s in enumerate(sets)])


def near_edges(fps: DataFrame, most: int = 2, crowd: int = 4096) -> DataFrame:
    """(src, dst) edges that connect all 8-byte fingerprints (distinct, column fp) differing in at most `most` (0 to 3) bits.

    Postings: at most `most` differing bits touch as many of four 2-byte positions, so
    two fingerprints share 4 - most of them; the index lists each fingerprint under every
    choice of that many. Tally: in a list, the positional bytes that a pair shares are counted; 8 - most
    are guaranteed, and pairs below that are dropped. Verify: the bits of the pairs left are compared.
    A list of over `crowd` fingerprints is posted anew under every 8 - most positional bytes that hold its own,
    so with most = 2 its parts hold 65,536 at most: two bytes are free. No pair is lost by that.
    """
    halves = [(2 * i, 2 * i + 1) for i in range(4)]
    sets = [sum(s, ()) for s in itertools.combinations(halves, 4 - most)]
    finer = [s for s in itertools.combinations(range(8), 8 - most)]
    posted = cut(fps.select("fp", F.explode(_postings(F.col("fp"), sets)).alias("k")).select("fp", "k.set", "k.bytes"), "posted")
    counts = cut(posted.groupBy("set", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    rows = lookup(posted, counts, ["set", "bytes"])
    few = rows.where(F.col("n") <= crowd).groupBy("set", "bytes").agg(F.collect_list("fp").alias("members"))
    many = rows.where(F.col("n") > crowd).select("fp", "set", F.explode(_postings(F.col("fp"), finer)).alias("f"))
    holds = F.array(*[F.array(*[F.lit(k) for k, f in enumerate(finer) if set(s) <= set(f)]) for s in sets])
    many = many.where(F.array_contains(F.get(holds, F.col("set")), F.col("f.set"))).select("fp", "f.set", "f.bytes").distinct()
    many = many.groupBy("set", "bytes").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    lists = few.select("members").unionByName(many.select("members"))
    return lists.select(F.explode(_edges(F.col("members"), most)).alias("e")).select("e.src", "e.dst").distinct()


# --- fingerprints of sampled shingles, linked at a Jaccard similarity ------------------

#: Sets of positional bytes that postings are made of, and bytes in each set.
TABLES, TAKE = 16, 5
_ODD = np.random.default_rng(8).integers(1, 2**63, TABLES * TAKE, dtype=np.uint64) | np.uint64(1)


def sampled_bytes(h: np.ndarray) -> bytes:
    """Fingerprint of TABLES * TAKE bytes: byte i is the SimHash, in 8 bits, of a sample of one shingle, the one of least hash under permutation i."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 8192):
        least = np.minimum(least, (h[k : k + 8192, None] * _ODD).min(0))
    x = (least ^ (least >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(56)).astype(np.uint8).tobytes()


def word_shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes (uint64, sorted) of the word shingles of a lower-cased text; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width, out = min(width, len(words)), None
    for k in range(width):
        part = h[k : len(h) - width + 1 + k]
        out = part if out is None else (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + part
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))


def signature(text: Column, width: int = 5) -> Column:
    """Struct (node, fp, shingles): digest of the set of shingles, its sampled fingerprint, and the set itself as sorted 32-bit hashes."""

    @F.arrow_udf(StructType([StructField(c, BinaryType()) for c in ("node", "fp", "shingles")]))
    def of(texts: pa.Array) -> pa.Array:
        import xxhash

        rows = [word_shingles(t.as_py(), width) for t in texts]
        cols = [xxhash.xxh3_128_digest(h.tobytes()) for h in rows], [sampled_bytes(h) for h in rows], [np.unique(h.astype(np.uint32)).tobytes() for h in rows]
        return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["node", "fp", "shingles"])

    return of(utf8(text))


class Members:
    """The rows (node, fp, shingles) of a list, compared by tally and then by their sets."""

    def __init__(self, rows: list[dict], similarity: float):
        self.fps = np.frombuffer(b"".join(r["fp"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r["shingles"], np.uint32) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets])
        self.similarity = similarity
        p = self.fps.shape[1]
        #: A pair of that similarity shares as many positional bytes, but for one in 30,000 (four standard deviations).
        self.least = int(p * similarity - 4 * np.sqrt(p * similarity * (1 - similarity)))

    def near(self, left: np.ndarray, at: int) -> np.ndarray:
        linked = (self.fps[left] == self.fps[at]).sum(1) >= self.least
        some = left[linked]
        if len(some) and self.sizes[at]:
            flat = np.concatenate([self.sets[i] for i in some])
            mine, sizes = self.sets[at], self.sizes[some]
            place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.bincount(np.repeat(np.arange(len(some)), sizes), mine[place] == flat, len(some))
            linked[linked] = both * (1 + self.similarity) >= self.similarity * (sizes + len(mine)) - 1e-9
        return linked


def _similar(list_of: Column, similarity: float) -> Column:
    @F.arrow_udf(ArrayType(_PAIR))
    def of(lists: pa.Array) -> pa.Array:
        out = []
        for members in lists:
            rows = sorted(members.as_py(), key=lambda r: r["node"])
            src, dst = _breadth_first(len(rows), Members(rows, similarity).near)
            out.append([{"src": rows[i]["node"], "dst": rows[j]["node"]} for i, j in zip(src, dst)])
        return pa.array(out, _PAIRS)

    return of(list_of)


def _joins(list_of: Column, similarity: float) -> Column:
    """Edges from the probing members to the others of another label that are similar: as many as join labels anew."""

    @F.arrow_udf(ArrayType(_PAIR))
    def of(lists: pa.Array) -> pa.Array:
        out = []
        for members in lists:
            rows, ids = members.as_py(), {}
            found, edges = Members(rows, similarity), []
            label = np.array([ids.setdefault(r["label"], len(ids)) for r in rows])
            asks = np.array([r["probing"] for r in rows])
            there = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks):
                other = there[label[there] != label[i]]
                near = other[found.near(other, i)]
                while len(near):
                    edges.append({"src": rows[i]["node"], "dst": rows[near[0]]["node"]})
                    label[label == label[near[0]]] = label[i]
                    near = near[label[near] != label[i]]
            out.append(edges)
        return pa.array(out, _PAIRS)

    return of(list_of)


def similar_edges(docs: DataFrame, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """(src, dst) edges that connect the nodes of docs (node, fp, shingles; rows of a node repeat) whose sets of shingles reach a Jaccard similarity.

    Postings: fingerprints are listed under TABLES sets of TAKE positional bytes. A byte is
    shared with the probability of the Jaccard similarity, so a pair at 0.8 meets in a list with
    probability 1 - (1 - 0.8**5)**16 = 0.998, at any size of the corpus; 40 bits a key keep
    unrelated pairs rare. Tally: in a list the shared positional bytes of a pair are counted and must reach the minimum of
    Members.least. Verify: the sets themselves are compared. Lists of the same members are one. A list of over `block`
    members is dealt into blocks, and its blocks are then compared with each other (see _across), so no pair of a list is left out.
    """
    nodes = cut(docs.groupBy("node").agg(F.first("fp").alias("fp")), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(t), F.substring("fp", t * TAKE + 1, TAKE)) for t in range(TABLES)])
    posted = cut(nodes.select("node", F.explode(keys).alias("k")), "posted")
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    counts = posted.groupBy("k").agg(F.count("*").alias("n"), *members).where("n > 1")
    counts = cut(counts.groupBy("n", "x0", "x1").agg(F.min("k").alias("k")).select("k", "n"), "counts")
    listed = cut(lookup(posted, counts, "k"), "listed")
    needed = cut(listed.select("node").distinct(), "needed")
    sets = cut(docs.join(bounded(needed), "node", "left_semi").groupBy("node").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles")), "sets")
    rows = listed.join(sets, "node").withColumn("part", F.pmod(F.xxhash64("node", "k"), F.ceil(F.col("n") / block)))
    lists = rows.groupBy("k", "part").agg(F.collect_list(F.struct("node", "fp", "shingles")).alias("members")).where(F.size("members") > 1)
    edges = lists.select(F.explode(_similar(F.col("members"), similarity)).alias("e")).select("e.src", "e.dst").distinct()
    crowded = listed.where(F.col("n") > block)
    return edges if crowded.isEmpty() else _across(cut(edges, "links"), crowded, sets, similarity, block)


def _across(edges: DataFrame, listed: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges with the components of `edges` and of all similar pairs within the lists of listed (k, node), which were dealt into blocks.

    Only pairs of different components can still join any. At least one of such a pair is
    outside the largest component of its list, so these members, in blocks of their own,
    meet every block of the list. A task compares two blocks.
    """
    near = connected_components(edges)
    stars = near.where("node <> component").select(F.col("component").alias("src"), F.col("node").alias("dst"))
    labels = near.withColumnRenamed("component", "label")
    members = cut(listed.join(labels, "node", "left").select("k", "node", F.coalesce("label", "node").alias("label")), "members")
    sizes = members.groupBy("k", "label").agg(F.count("*").alias("m"))
    lists = sizes.groupBy("k").agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("n")).withColumn("rest", F.col("n") - F.col("main.m")).where("rest > 0")
    lists = cut(lists.select("k", F.col("main.label").alias("main"), F.ceil(F.col("n") / block).alias("parts"), F.ceil(F.col("rest") / block).alias("probes")), "mixed")
    rows = lookup(members, lists, "k").join(sets, "node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node", "k"), F.col(n))
    row = ["k", "node", "fp", "shingles", "label"]
    there = rows.select(*row, F.lit(False).alias("probing"), place("parts").alias("part"), every("probes").alias("probe"))
    asked = rows.where("label <> main").select(*row, F.lit(True).alias("probing"), place("probes").alias("probe"), every("parts").alias("part"))
    pairs = there.unionByName(asked).groupBy("k", "part", "probe").agg(F.collect_list(F.struct(*row[1:], "probing")).alias("members"))
    found = pairs.select(F.explode(_joins(F.col("members"), similarity)).alias("e")).select("e.src", "e.dst")
    return stars.unionByName(found).distinct()


# --- documents -----------------------------------------------------------------------


def _named(docs: DataFrame, first: Column, edges: DataFrame, node: str) -> DataFrame:
    """(node, first) of each node of docs: an aggregate over the rows of its component."""
    near = connected_components(cut(edges, "links"))
    nodes = cut(docs.groupBy(F.col(node).alias("node")).agg(first.alias("mine")), "nodes")
    named = cut(nodes.join(near, "node", "left").select("node", "mine", F.coalesce("component", "node").alias("root")), "named")
    least = cut(named.groupBy("root").agg(F.min("mine").alias("first")), "least")
    return cut(lookup(named, least, "root").select("node", "first"), "classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row of df: fp binary, component_id the smallest id reachable over links of fingerprints at `most` or fewer differing bits.

    Equal fingerprints are one node, so copies make no pairs.

    Null or empty text has no words: fingerprint zero, linked like any other. Repeated
    rows each come back. Null ids never become a component id while another is there.
    Other columns are not read. Empty table: no rows.
    """
    small_batches(df.sparkSession)
    docs = cut(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    edges = near_edges(docs.select("fp").distinct(), most)
    classes = _named(docs, F.min("id"), edges, "fp").select(F.col("node").alias("fp"), F.col("first").alias("component_id"))
    return lookup(docs, classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group on five-word shingles: the row of the least id, then the least hash of the text.

    Groups are the components of pairs whose shingles reach the Jaccard similarity. Rows repeated with the same id
    and text are kept once; different texts under one id are documents of their own.
    Texts without words are one group. A null id comes behind all others. Columns are those of df. Empty table: no rows.
    """
    small_batches(df.sparkSession)
    digest = F.unhex(F.md5(F.col(text_col)))
    docs = df.select(F.col(id_col).alias("id"), digest.alias("digest"), signature(F.col(text_col), 5).alias("s"))
    docs = cut(docs.select("id", "digest", "s.*"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    classes = _named(docs, first, similar_edges(docs, similarity), "node")
    rows = cut(docs.groupBy("node", "id", "digest").agg(F.count("*").alias("n")), "rows")
    same = F.col("id").eqNullSafe(F.col("first.id")) & F.col("digest").eqNullSafe(F.col("first.digest"))
    judged = lookup(rows, classes, "node").select("id", "digest", "n", same.alias("keep"))
    gone = cut(judged.where(~F.col("keep") | (F.col("n") > 1)).select("id", "digest", "keep"), "gone")
    # rows travel as one struct, so no column of df can clash
    carried = df.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    match = F.col("key.id").eqNullSafe(F.col("id")) & F.col("key.digest").eqNullSafe(F.col("digest"))
    kept = carried.join(bounded(gone, otherwise="shuffle_hash"), match, "left_anti").select("row.*")
    # rows that repeat with id and text, and stay, are brought together: one of each is left
    once = gone.where("keep")
    if once.isEmpty():
        return kept
    return kept.unionByName(carried.join(bounded(once), match, "left_semi").dropDuplicates(["key"]).select("row.*"))
