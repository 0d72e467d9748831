"""Sharding by balanced label propagation."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.lineage import bounded, cut, global_rank, lookup

#: Buckets of groups by hash in which a shard's quota is filled.
BUCKETS = 4096


def _sums(df: DataFrame, col: str, shards: int, rows: Column | None = None) -> list[int]:
    """Rows for each shard; one number a shard reaches the driver."""
    found = {r[0]: r[1] for r in df.groupBy(col).agg(F.count("*") if rows is None else F.sum(rows)).collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def _at(values: list, index: Column) -> Column:
    """The value at a shard's place of a list with one entry a shard."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def propagate(labels: DataFrame, links: DataFrame, others: list[int], shards: int, rounds: int = 5, slack: float = 0.1, seed: int = 11) -> DataFrame:
    """Move linked nodes towards their neighbours' shards under capacity quotas.

    labels: (node, shard) of the linked nodes, each once; links: (src, dst), both in labels;
    others: rows of each shard that no link touches. Each round half of the nodes (by
    hash) may move to the shard that most neighbours are in. A shard accepts no more
    than it has room for, up to (1 + slack) times the mean: the acceptance share of
    each shard is applied by hash, so nothing is sorted or collected but shard counts.
    """
    both = cut(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    labels = cut(labels, "labels")
    for r in range(rounds):
        sizes = [a + b for a, b in zip(_sums(labels, "shard", shards), others)]
        room = [max(0.0, sum(sizes) / shards * (1 + slack) + 1 - s) for s in sizes]
        near = labels.select(F.col("node").alias("dst"), F.col("shard").alias("there"))
        votes = lookup(both, near, "dst").groupBy("src", "there").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", F.negative("there").alias("t"))).alias("best"), F.collect_list(F.struct("there", "n")).alias("all"))
        here = F.coalesce(F.aggregate("all", F.lit(0).cast("long"), lambda a, x: F.when(x["there"] == F.col("shard"), x["n"]).otherwise(a)), F.lit(0).cast("long"))
        want = F.when((F.col("best.n") > here) & (F.pmod(F.xxhash64("node", F.lit(seed + r)), F.lit(2)) == 0), F.negative(F.col("best.t")))
        asked = cut(labels.join(best, labels.node == best.src, "left").select("node", "shard", want.alias("want")), "asked")
        demand = _sums(asked.where("want is not null"), "want", shards)
        if not sum(demand):
            continue
        share = [min(1.0, room[s] / max(demand[s], 1)) for s in range(shards)]
        lot = F.pmod(F.xxhash64("node", F.lit(-seed - r)), F.lit(1 << 30)) / float(1 << 30)
        go = F.col("want").isNotNull() & (lot < _at(share, F.coalesce("want", F.lit(0))))
        labels = cut(asked.select("node", F.when(go, F.col("want")).otherwise(F.col("shard")).alias("shard")), "labels")
    return labels


def pack(groups: DataFrame, quota: list[int], rounds: int = 12) -> tuple[DataFrame, list[int]]:
    """((digest, shard) of the groups that fit whole, rows used of each shard) for groups (digest, n, want) and a quota of rows a shard.

    In each round a shard takes the groups that want it, bucket by bucket of their hash, as long as its quota
    lasts; the others want a shard anew, drawn by the room that is left. A group that no shard has taken at the end is left out.
    """
    shards, used = len(quota), [0] * len(quota)
    pending, taken = groups, None
    for r in range(rounds):
        room = [q - u for q, u in zip(quota, used)]
        bucket = F.pmod(F.xxhash64("digest", F.lit(r)), F.lit(BUCKETS)).alias("bucket")
        sums = pending.where(F.col("n") <= _at(room, F.col("want"))).groupBy("want", bucket).agg(F.sum("n").alias("rows"))
        run = F.sum("rows").over(Window.partitionBy("want").orderBy("bucket"))  # at most BUCKETS rows a shard
        full = cut(sums.select("want", "bucket", run.alias("cum")).where(F.col("cum") <= _at(room, F.col("want"))).select(F.col("want").alias("w"), F.col("bucket").alias("b")), "buckets")
        marked = pending.select("*", bucket, (F.col("n") <= _at(room, F.col("want"))).alias("fits")).join(F.broadcast(full), (F.col("want") == F.col("w")) & (F.col("bucket") == F.col("b")), "left")
        marked = cut(marked.select("digest", "n", "want", (F.col("fits") & F.col("w").isNotNull()).alias("in")), "marked")
        mine = marked.where("in").select("digest", F.col("want").alias("shard"))
        taken = mine if taken is None else taken.unionByName(mine)
        used = [u + x for u, x in zip(used, _sums(marked.where("in"), "want", shards, F.col("n")))]
        pending = marked.where("not in")
        room = [max(0, q - u) for q, u in zip(quota, used)]
        if pending.where(F.col("n") <= max(room)).isEmpty():
            break
        room = list(accumulate(room))
        lot = F.pmod(F.xxhash64("digest", F.lit(~r)), F.lit(max(room[-1], 1)))
        pending = pending.select("digest", "n", F.size(F.filter(F.array(*[F.lit(x) for x in room[:-1]]), lambda x: x <= lot)).alias("want"))
    return taken, used


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rounds: int = 5) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; documents of equal text are linked.

    Label propagation draws linked documents together. Then each group of equal texts goes as a whole to the shard
    that most of it is in, or to one with room; groups that fit nowhere, such as one larger than a
    shard, and single documents fill the shards up in order. So the law is `rows`: counts are at most one apart, and
    only groups that fit nowhere are cut. The same rows give the same shards, however they are partitioned.

    Size: UTF-8 bytes plus 8; a null text has none and counts as empty, crc32 0. Repeated rows are
    documents of their own. Null ids are kept. Other columns are not read. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("digest")
    rows = cut(df.select(*columns), "rows")
    groups = cut(rows.groupBy("digest").agg(F.min(F.struct("id")).alias("leader"), F.count("*").alias("n")).where("n > 1"), "groups")
    node = lambda id_: F.struct("digest", id_).alias("node")
    linked = cut(lookup(rows, groups, "digest"), "linked")
    nodes = linked.select(node(F.col("id")), F.struct("digest", F.col("leader.id").alias("id")).alias("leader")).distinct()
    nodes = cut(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "nodes")
    total, held = rows.count(), linked.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    others = [(total - held) // shards] * shards
    labels = propagate(nodes.select("node", "shard"), nodes.where("node <> leader").select(F.col("node").alias("src"), F.col("leader").alias("dst")), others, shards, rounds)
    homes = labels.groupBy(F.col("node.digest").alias("digest"), "shard").agg(F.count("*").alias("m")).groupBy("digest").agg(F.max_by("shard", F.struct("m", F.negative("shard"))).alias("want"))
    packed, used = pack(cut(groups.select("digest", "n").join(homes, "digest"), "homes"), quota)
    packed = cut(packed, "packed")
    whole = global_rank(lookup(linked.select("id", "size", "crc", "digest"), packed, "digest"), [F.col("shard"), F.col("digest"), F.col("id")], "at")
    whole = whole.withColumn("slot", F.col("at") - _at([0, *accumulate(used)], F.col("shard")))
    loose = rows.join(bounded(packed), "digest", "left_anti").join(bounded(groups.select("digest", "n")), "digest", "left")
    # what is left of groups comes first, each group in one run
    fill = global_rank(loose, [F.col("n").isNull(), F.col("digest"), F.col("id")], "at")
    ends = list(accumulate(q - u for q, u in zip(quota, used)))
    fill = fill.withColumn("shard", F.size(F.filter(F.array(*[F.lit(x) for x in ends[:-1]]), lambda x: x <= F.col("at"))))
    fill = fill.withColumn("slot", F.col("at") - _at([0, *ends], F.col("shard")) + _at(used, F.col("shard")))
    out = ["id", "size", "crc", "shard", "slot"]
    return (
        whole.select(*out)
        .unionByName(fill.select(*out))
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
