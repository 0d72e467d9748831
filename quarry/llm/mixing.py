"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import n_words
from quarry.plans.lineage import bounded, cut, global_rank

#: Bits of the hash, and bits that one histogram level resolves (4096 buckets a source).
HASH_BITS, LEVEL_BITS = 60, 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """(key, source, source_size) -> the same with target.

    Sources in code-point order, null last, take the weights in turn and share
    `share` of all sizes. A target stops at max_repeat times its source's size; the
    excess is reshared by weight among the others. Only sums reach the driver.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeat)), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # the level only rises, so each round fills at least one more source
        open_ = F.col("cap") > F.col("weight") * level if full >= 0 else F.lit(True)
        row = ranked.agg(F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, F.col("cap"))), F.count(F.when(~open_, 1))).first()
        if row[0] is None or row[2] == full:
            break
        level, full = (total * share - (row[1] or 0.0)) / row[0], row[2]
    return ranked.withColumn("target", F.least("cap", F.col("weight") * level)).drop("at", "cap", "weight")


def _with_key(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """(key, h): a source's name that is never null, and a document's hash, of its id or, without one, of its text."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.coalesce(F.col(text_col), F.lit("")))))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    return key.alias("key"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h")


def thresholds(base: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """(key, source_size, target, whole, used, stop) of each source of base (source, key, size, h).

    A source takes each document `whole` times, and once more those whose first `used` hash bits are below
    `stop`. It is found from sums of words by hash bucket: the first level over all rows, each next one over
    the rows of the boundary bucket only, until that holds one document. The document on the
    boundary is taken if that brings the source nearer its target.
    """
    sizes = base.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut(source_targets(sizes, weights, share, max_repeat).withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    # prefix: the boundary bucket so far; left: words still to take from it
    edge = plan.select("key", F.lit(0).cast("long").alias("prefix"), F.col("need").alias("left"))
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        rows = base.join(bounded(edge.withColumnRenamed("key", "k")), F.col("key") == F.col("k"))
        rows = rows.where(F.shiftright("h", HASH_BITS - used + LEVEL_BITS) == F.col("prefix"))
        sums = rows.groupBy("key", "left", F.shiftright("h", HASH_BITS - used).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = Window.partitionBy("key").orderBy("bucket")  # at most 2**LEVEL_BITS rows a source
        sums = sums.withColumn("before", F.sum("words").over(run) - F.col("words")).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        edge = cut(
            sums.groupBy("key").agg(F.min(F.struct("bucket", (F.col("left") - F.col("before")).alias("left"), "words", "n")).alias("e")).select("key", F.col("e.bucket").alias("prefix"), "e.left", "e.words", "e.n"),
            "edge",
        )
        if edge.agg(F.max("n")).first()[0] in (None, 1):
            break
    # a document at or below the last prefix is taken once more, or only below it
    stop = F.col("prefix") + F.when(F.col("left") * 2 >= F.col("words"), 1).otherwise(0)
    found = plan.select("key", "source_size", "target", "whole", F.lit(used).alias("used")).join(edge.select("key", stop.alias("stop")), "key", "left")
    return cut(found, "thresholds")


def _copies() -> Column:
    return (F.col("whole") + F.when(F.expr(f"shiftright(h, {HASH_BITS} - used)") < F.col("stop"), 1).otherwise(0)).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Return (id, size, source_size, target, taken, copies) for every row; the rows are those of df.

    A source takes each document whole floor(target / size of source) times, and once
    more those whose hash lies below its threshold (see thresholds).

    Null text: size 0. Null source: a source of its own, last. Rows of one id share a hash and are taken together, and so
    are rows without id of one text. Other columns are not read. Empty table: no rows.
    """
    key, h = _with_key(df, id_col, text_col, source_col)
    base = cut(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key, n_words(F.col(text_col)).alias("size"), h), "mix")
    found = thresholds(base, weights, share, max_repeat)
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return base.join(bounded(found), "key").withColumn("copies", _copies()).select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "copies")


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """The rows of df, each as often as mix() takes it, with its columns. Sources are looked up in the scan: no text is shuffled."""
    key, h = _with_key(df, id_col, text_col, source_col)
    base = cut(df.select(F.col(source_col).alias("source"), key, n_words(F.col(text_col)).alias("size"), h), "mix")
    found = thresholds(base, weights, share, max_repeat)
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), key, h).join(bounded(found), "key")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), _copies()))).select("row.*")
