"""Cutting lineage, size-checked broadcasts, lookups on skewed keys and global ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a lookup table (a few narrow columns) up to which it is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one is set in local mode (tests); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, label: str = "cut", partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; a lost executor then costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path of the shared folder and is no longer read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str | None = None) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `rows` rows, else with the join hint `otherwise` or as it is (a shuffled join follows)."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], small: int = BROADCAST_ROWS) -> DataFrame:
    """rows inner-joined by equal keys with a table that holds each key once, however skewed the keys of rows are.

    A table counted to have at most `small` rows is broadcast. Of a larger one, the part of the keys that hold over
    1 / BROADCAST_ROWS of rows (so at most BROADCAST_ROWS keys) is broadcast, and only the rest is shuffled.
    Both sides are read more than once: give written tables.
    """
    keys = [key] if isinstance(key, str) else key
    if small and (near := bounded(table, small)) is not table:
        return rows.join(near, keys)
    least = max(1000, rows.count() // BROADCAST_ROWS)
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*keys), "hot")
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys).unionByName(cold)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add a gapless 0-based rank by `order` without one global window.

    Range partitions are sorted and written; only a row count for each partition
    reaches the driver, and comes back as an offset. Make `order` unique: equal
    keys share a partition.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id()),
        "rank",
    )
    part, pos = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted(ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "__p long, __offset long")
    return (
        ordered.withColumn("__p", part)
        .join(F.broadcast(table), "__p")
        .withColumn(name, pos + F.col("__offset"))
        .drop("__p", "__offset", "__at")
    )


def running_sum(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with cum, the sum of `value` up to each row in `order`, and n, that of all rows; both within each group of `by`.

    Rows are dealt into ranges of (by, order); a range's sums of each group are few, and what lies in the ranges before is added to
    the sum within one.
    """
    ranged = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, order).withColumn("__range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    before, all_ = Window.partitionBy(*by).orderBy("__range"), Window.partitionBy(*by)  # one row a range
    names = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    parts = parts.select(*names, F.col("__range").alias("__part"), (F.sum("__sum").over(before) - F.col("__sum")).alias("__before"), F.sum("__sum").over(all_).alias("n"))
    same = F.col("__range") == F.col("__part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    run = Window.partitionBy("__range", *by).orderBy(order)
    out = ranged.join(bounded(parts), same).withColumn("cum", F.col("__before") + F.sum(value).over(run))
    return out.select(*df.columns, "n", "cum")
