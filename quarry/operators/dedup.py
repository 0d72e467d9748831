"""Exact and near duplicates of rows, keepers and what to do with the rest."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.features import row_assistant_text, row_text
from quarry.functions.json import utf16_length
from quarry.functions.signature import simhash64
from quarry.operators.graph import connected_components
from quarry.plans.lineage import cut, lookup

#: Bits of a signature, and members of a list that are compared in one task.
BITS, BLOCK = 64, 16384
#: UTF-16 units from which texts have near duplicates.
MIN_UNITS = 16
#: Pairs a signature that may share a key by chance.
CHANCE = 20
#: Comparisons in a list that take as long as one posting, and those that are made at a time.
POSTING, CELLS = 1000, 1 << 18


def exact_dedup(rows: DataFrame, key: Column | str | None = None) -> DataFrame:
    """(row_id, cluster) of live rows that share a key (row text by default) with another; cluster is the first row. Empty and null keys are skipped.

    Keys are compared by SHA-256, so texts are not shuffled.
    """
    key = row_text() if key is None else F.col(key) if isinstance(key, str) else key
    keyed = rows.where("not deleted").select("row_id", key.alias("k")).where("k <> ''").select("row_id", F.unhex(F.sha2("k", 256)).alias("k"))
    keyed = cut(keyed, "keys")
    groups = keyed.groupBy("k").agg(F.min("row_id").alias("cluster"), F.count("*").alias("n")).where("n > 1")
    return lookup(keyed, cut(groups.select("k", "cluster"), "groups"), "k").select("row_id", "cluster")


def _choices(n: int, most: int) -> list[tuple[float, int, int, int]]:
    """(pairs a signature that share a key by chance, keys, parts, kept) of the ways to cut n signatures so that every pair within `most` bits shares a key. (1, 0) is one key for all."""
    found = [(n / 2, 1, 1, 0)]
    for parts in range(most + 1, min(BITS, most + 10) + 1):
        kept = parts - most
        keys = comb(parts, kept)
        if keys <= 3000:
            found.append((keys * n / 2 / 2 ** (BITS // parts * kept), keys, parts, kept))
    return found


def slices(n: int, most: int) -> tuple[int, int]:
    """(parts, kept): parts that a signature is cut into, and how many of them a key holds; signatures that differ in at most `most` bits agree on parts - most.

    More parts make longer keys, and more of them. Among the choices that let at most CHANCE pairs a signature share a key by chance
    the one with fewest keys is taken; where none does, the one that costs least in postings and such pairs.
    """
    found = _choices(n, most)
    few = [f for f in found if f[0] <= CHANCE]
    return (min(few, key=lambda f: f[1]) if few else min(found, key=lambda f: n / 2 if f[3] == 0 else 20 * f[1] + f[0]))[2:]


def list_slices(n: int, most: int) -> tuple[int, int]:
    """slices() for lists that are compared in a task and give no pair but those that link: there a posting costs as much as POSTING comparisons, so short keys, and few, cost least."""
    return min(_choices(n, most), key=lambda f: POSTING * f[1] + f[0])[2:]


def keys_of(sig: Column, parts: int, kept: int) -> Column:
    """Array of (key, bits): every choice of `kept` of the parts of a signature."""
    if not kept:
        return F.array(F.struct(F.lit(0).alias("key"), F.lit(0).cast("long").alias("bits")))
    edges = [BITS * i // parts for i in range(parts + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(parts), kept)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        out.append(F.struct(F.lit(k).alias("key"), sig.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask)).alias("bits")))
    return F.array(*out)


def _forest(sigs: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (ends, other ends) of distinct signatures within `most` bits that connect all that are connected: a few for each signature, not one for each pair.

    Many signatures are compared with the rest at a time. Where few are near, all near pairs are taken; where many are, what the one with most of them reaches is
    followed first, and is then compared no more.
    """
    left, out = sigs, []
    while len(left) > 1:
        rows = max(1, min(len(left), CELLS // len(left)))
        near = np.bitwise_count(left[:rows, None] ^ left) <= most
        near[:, :rows] = np.triu(near[:, :rows], 1)
        each = near.sum(1)
        if each.sum() <= 4 * rows:
            i, j = np.nonzero(near)
            out.append((left[i], left[j]))
            left = left[rows:]
            continue
        at = each.argmax()
        todo, left = left[at : at + 1], np.delete(left, at)
        while len(todo) and len(left):
            rows = max(1, CELLS // len(left))
            part, todo = todo[:rows], todo[rows:]
            near = np.bitwise_count(part[:, None] ^ left) <= most
            hit = near.any(0)
            if hit.any():
                out.append((part[near[:, hit].argmax(0)], left[hit]))
                todo, left = np.concatenate([todo, left[hit]]), left[~hit]
    return out


def _linked(lists: Column, most: int) -> Column:
    """Edges that connect the members of each list that differ in at most `most` bits."""

    @F.arrow_udf("array<struct<src:bigint,dst:bigint>>")
    def of(members: pa.Array) -> pa.Array:
        flat, ends = members.flatten().to_numpy(), np.cumsum(pc.list_value_length(members).to_numpy())
        src, dst, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [0]
        for sigs in np.split(flat, ends[:-1]):
            found = _forest(np.unique(sigs).view(np.uint64), most)
            src += [a for a, _ in found]
            dst += [b for _, b in found]
            counts.append(sum(len(a) for a, _ in found))
        edges = pa.StructArray.from_arrays([pa.array(np.concatenate(side).view(np.int64)) for side in (src, dst)], ["src", "dst"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), edges)

    return of(lists)


def similar_signatures(sigs: DataFrame, most: int) -> DataFrame:
    """(src, dst) edges that connect the distinct signatures (column sig) that differ in at most `most` (0 to 64) bits.

    Signatures meet under the keys that they share. A list of over BLOCK members is dealt into blocks, and each pair
    of its blocks is compared in a task, so no list is too large and no pair is left out.
    """
    posted = cut(sigs.select("sig", F.explode(keys_of(F.col("sig"), *list_slices(sigs.count(), most))).alias("k")).select("sig", "k.key", "k.bits"), "posted")
    counts = cut(posted.groupBy("key", "bits").agg(F.count("*").alias("n")).where("n > 1").select("key", "bits", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "counts")
    rows = lookup(posted, counts, ["key", "bits"]).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lists = rows.groupBy("key", "bits", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list("sig").alias("members"))
    return lists.where(F.size("members") > 1).select(F.explode(_linked(F.col("members"), most)).alias("e")).select("e.src", "e.dst").distinct()


def near_dedup(rows: DataFrame, text: Column | str | None = None, max_hamming: int = 6, min_units: int = MIN_UNITS) -> DataFrame:
    """(row_id, cluster) of live rows in near-duplicate clusters of two or more: texts of min_units UTF-16 units at least, linked at max_hamming differing signature bits.

    Equal signatures are one node of the graph; cluster is the first row.
    """
    text = row_text() if text is None else F.col(text) if isinstance(text, str) else text
    texts = rows.where("not deleted").select("row_id", text.alias("t")).where(utf16_length(F.col("t")) >= min_units)
    signed = cut(texts.select("row_id", simhash64(F.col("t")).alias("sig")), "signatures")
    nodes = signed.groupBy("sig").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    nodes = cut(nodes, "nodes")
    found = connected_components(cut(similar_signatures(nodes.select("sig"), max_hamming), "links"))
    named = nodes.join(found, nodes.sig == found.node, "left").select("sig", "first", "n", F.coalesce("component", "sig").alias("root"))
    named = cut(named, "named")
    clusters = named.groupBy("root").agg(F.min("first").alias("cluster"), F.sum("n").alias("size")).where("size > 1")
    near = cut(lookup(named, cut(clusters, "clusters"), "root").select("sig", "cluster"), "near")
    return lookup(signed, near, "sig").select("row_id", "cluster")


def dup_clusters(rows: DataFrame, mode: str, max_hamming: int = 6) -> DataFrame:
    """(row_id, cluster) by mode: exact-row, exact-assistant, near-row or near-assistant."""
    kind, _, part = mode.partition("-")
    text = {"row": row_text, "assistant": row_assistant_text}[part]()
    return exact_dedup(rows, text) if kind == "exact" else near_dedup(rows, text, max_hamming)


def default_mode(dominant: str) -> str:
    """exact-assistant for chats, else exact-row."""
    return "exact-assistant" if dominant in ("openai-chat", "sharegpt") else "exact-row"


def pick_keepers(rows: DataFrame, clusters: DataFrame, keep: str = "first") -> DataFrame:
    """(row_id, cluster, keeper): the first, last, longest or shortest row (by row text) of each cluster is kept, the earliest of equals.

    The keeper is an aggregate and comes back by a lookup, so a large cluster is not brought together.
    """
    size = utf16_length(row_text())
    by = {"first": F.negative("row_id"), "last": F.col("row_id"), "longest": F.col("size"), "shortest": F.negative("size")}[keep]
    sized = cut(clusters.join(rows.select("row_id", size.alias("size")), "row_id"), "sized")
    best = sized.groupBy("cluster").agg(F.max(F.struct(by.alias("by"), F.negative("row_id").alias("r"))).alias("b")).select("cluster", F.negative("b.r").alias("kept"))
    return lookup(sized, cut(best, "keepers"), "cluster").select("row_id", "cluster", (F.col("row_id") == F.col("kept")).alias("keeper"))


def dedup_resolve(rows: DataFrame, clusters: DataFrame, action: str, keep: str = "first") -> DataFrame:
    """Rows with the cluster's other rows deleted or excluded, or all its rows tagged `_dup`."""
    picked = pick_keepers(rows, clusters, keep).select(F.col("row_id").alias("__id"), "keeper")
    out = rows.join(picked, rows.row_id == F.col("__id"), "left")
    rest = F.coalesce(~F.col("keeper"), F.lit(False))
    if action == "tag":
        out = out.withColumn("tags", F.when(F.col("keeper").isNotNull(), F.array_union("tags", F.array(F.lit("_dup")))).otherwise(F.col("tags")))
    else:
        flag = {"delete": "deleted", "exclude": "excluded"}[action]
        out = out.withColumn(flag, F.col(flag) | rest)
    return out.drop("__id", "keeper")


def dup_counts(clusters: DataFrame) -> DataFrame:
    """(clusters, rows, removable)."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"))
