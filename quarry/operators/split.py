"""Seeded splits and samples, in the order of md5(seed:row_id): the rows at the edges of parts are selected by histograms, and all rows are labelled where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.lineage import bounded, cut

NAMES = ("train", "val", "test")
#: Hex digits of a lot that one histogram resolves (65,536 buckets a stratum), and the rows of a bucket that are ranked one by one.
DIGITS, FEW = 4, 10_000


def _lot(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))


def _edges(total: Column, ratios: tuple[float, ...]) -> list[Column]:
    """Places where each part but the last ends: floor(total r / sum) rows a part."""
    whole, out, end = sum(ratios) or 1, [], F.lit(0).cast("long")
    for r in ratios[:-1]:
        end = end + F.floor(total * F.lit(r) / F.lit(float(whole)))
        out.append(end)
    return out


def _key(lot: Column | str, row_id: Column | str) -> Column:
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(of(lot).alias("lot"), of(row_id).alias("row_id"))


def edge_keys(ids: DataFrame, edges: list[Column]) -> DataFrame:
    """(stratum, c0, c1, ...) for ids (stratum, lot, row_id): the key (lot, row_id) at place `edges[k]` (an expression over n) of each stratum's order; null if that is past its end.

    Counts of lots by their first digits say in which bucket a place lies; the next digits are counted in these buckets only, until
    they hold FEW rows, which are ranked. Each round reads the ids once and shuffles counts, so a hot stratum is no larger than another.
    """
    sizes = cut(ids.groupBy("stratum").agg(F.count("*").alias("n")), "sizes")
    places = F.array(*[e.cast("long") for e in edges])
    edge = cut(sizes.select("stratum", "n", F.posexplode(places).alias("k", "left")).where("left < n").select("stratum", "k", F.lit("").alias("prefix"), "left"), "places")
    used = 0
    while True:
        inside = F.substring("lot", 1, used).alias("prefix")
        near = bounded(edge.select("stratum", "prefix").distinct())
        rows = ids.select("stratum", "lot", "row_id", inside).join(near, ["stratum", "prefix"])
        if used >= 32:
            break
        counts = rows.groupBy("stratum", "prefix", F.substring("lot", 1, used + DIGITS).alias("bucket")).agg(F.count("*").alias("c"))
        run = Window.partitionBy("stratum", "prefix").orderBy("bucket")  # 16**DIGITS rows at most
        steps = counts.withColumn("before", F.sum("c").over(run) - F.col("c"))
        hit = steps.join(bounded(edge), ["stratum", "prefix"]).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))
        edge = cut(hit.select("stratum", "k", F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "c"), "buckets")
        used += DIGITS
        if (edge.agg(F.max("c")).first()[0] or 0) <= FEW:
            rows = ids.select("stratum", "lot", "row_id", F.substring("lot", 1, used).alias("prefix")).join(bounded(edge.select("stratum", "prefix").distinct()), ["stratum", "prefix"])
            break
    place = F.row_number().over(Window.partitionBy("stratum", "prefix").orderBy("lot", "row_id")) - 1
    found = rows.withColumn("left", place.cast("long")).join(bounded(edge.select("stratum", "prefix", "k", "left")), ["stratum", "prefix", "left"])
    at = [F.max(F.when(F.col("k") == k, _key("lot", "row_id"))).alias(f"c{k}") for k in range(len(edges))]
    return cut(sizes.select("stratum").join(bounded(found.groupBy("stratum").agg(*at)), "stratum", "left"), "edges")


def _label(key: Column, cuts: list[Column], names: tuple[str, ...]) -> Column:
    """The part of a row: the first whose edge is behind its key."""
    out = F.lit(names[len(cuts)])
    for name, at in reversed(list(zip(names, cuts))):
        out = F.when(at.isNull() | (key < at), name).otherwise(out)
    return out


def _ids(rows: DataFrame, stratum: Column, seed: int) -> DataFrame:
    return cut(rows.where("not deleted").select("row_id", stratum.alias("stratum")).withColumn("lot", _lot(seed)), "lots")


def _one_edge(rows: DataFrame, edges: list[Column], seed: int) -> list[Column]:
    """Edge keys over all live rows, as constants."""
    ids = _ids(rows, F.lit(""), seed)
    found = edge_keys(ids, edges).first()
    kind = ids.schema["row_id"].dataType
    none = F.lit(None).cast(f"struct<lot:string,row_id:{kind.simpleString()}>")
    values = [found[f"c{k}"] if found else None for k in range(len(edges))]
    return [none if v is None else _key(F.lit(v.lot), F.lit(v.row_id).cast(kind)) for v in values]


def split(rows: DataFrame, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 1, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Live rows with a column `split`: disjoint parts of exact sizes, the last takes the remainder. No row is shuffled."""
    cuts = _one_edge(rows, _edges(F.col("n"), ratios), seed)
    return rows.where("not deleted").withColumn("split", _label(_key(_lot(seed), "row_id"), cuts, names))


def split_stratified(rows: DataFrame, key: Column | str, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = 1, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Live rows with `split`, cut in the same proportions within each value of key; null is `__none__`. The edges of the strata are a lookup."""
    key = F.col(key) if isinstance(key, str) else key
    stratum = F.coalesce(key.cast("string"), F.lit("__none__"))
    found = edge_keys(_ids(rows, stratum, seed), _edges(F.col("n"), ratios))
    cuts = [F.col(f"__c{k}") for k in range(len(ratios) - 1)]
    table = bounded(found.select(F.col("stratum").alias("__stratum"), *[F.col(f"c{k}").alias(f"__c{k}") for k in range(len(cuts))]))
    out = rows.where("not deleted").join(table, stratum == F.col("__stratum"))
    return out.withColumn("split", _label(_key(_lot(seed), "row_id"), cuts, names)).drop("__stratum", *[f"__c{k}" for k in range(len(cuts))])


def sample(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The first n live rows in md5 order, in no order."""
    at = _one_edge(rows, [F.lit(max(n, 0))], seed)[0]
    return rows.where("not deleted").where(at.isNull() | (_key(_lot(seed), "row_id") < at))


def split_preview(rows: DataFrame, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = NAMES) -> DataFrame:
    """(split, n): sizes that split() gives."""
    total = rows.where("not deleted").agg(F.count("*").alias("n"))
    ends = [F.lit(0).cast("long"), *_edges(F.col("n"), ratios), F.col("n")]
    parts = F.array(*[F.struct(F.lit(name).alias("split"), (b - a).cast("long").alias("n")) for name, a, b in zip(names, ends, ends[1:])])
    return total.select(F.explode(parts).alias("p")).select("p.*")
