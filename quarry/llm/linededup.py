"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import BLANKS, ascii_lower, carried, unpacked
from quarry.plans.lineage import bounded, cut, lookup, remove, shared_dir

#: The two parts of a line's hash.
KEY = ["h", "g"]


class LineRuns:
    """Levelled runs of (h, g, n): line hash in two parts, 128 bits together, and the number of documents that it was counted in.

    A run is a table bucketed and sorted by hash, so that joins with runs merge without
    a shuffle of the runs. Keys that have reached `enough` documents move to the full
    runs; each new batch is merge-anti-joined with those, and what is left is added as a run of level 0.
    `fanout` runs of a level are merged into one of the next. Use it in a with block: the runs are removed at its end.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 2):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.levels: list[list[str]] = [[]]
        self.full: list[str] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self._drop([*self.full, *(name for runs in self.levels for name in runs)])

    def _write(self, df: DataFrame) -> str:
        name = f"quarry_run_{uuid.uuid4().hex}"
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        writer = df.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("compression", "zstd")
        writer.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{shared_dir(self.spark)}/{name}")

    def unseen(self, counts: DataFrame) -> DataFrame:
        """The rows of counts (h, g, n) whose key is in no full run: sorted once, then merged with each."""
        for name in self.full:
            counts = counts.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """lines: columns h and g, one row for each document and distinct line of a batch."""
        self.levels[0].append(self._write(self.unseen(lines.groupBy(*KEY).agg(F.count("*").alias("n")))))
        self._compact()

    def _merged(self, names: list[str]) -> DataFrame:
        """(h, g, n) of several runs: their sorted buckets are merge-joined in turn."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.join(other.hint("merge"), KEY, "full_outer").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            runs = self.levels[k]
            if len(runs) >= self.fanout:
                merged = cut(self._merged(runs), "merged")
                if merged.where(F.col("n") >= self.enough).limit(1).count():
                    self.full.append(self._write(merged.where(F.col("n") >= self.enough)))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged.where(F.col("n") < self.enough)))
                self._drop(runs)
                self.levels[k] = []
            k += 1

    def frequent(self) -> DataFrame:
        """(h, g) of the keys found in at least `enough` documents: those of the full runs, and those that the open runs add up to."""
        opened = [name for runs in self.levels for name in runs]
        if not opened:
            return self.spark.createDataFrame([], "h long, g long")
        found = self._merged(opened).where(F.col("n") >= self.enough).select(*KEY)
        for name in self.full:
            found = found.unionByName(self.spark.table(name).select(*KEY))
        return cut(found.distinct(), "frequent")


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """Hashes (h, g) of a text's lines, stripped and lower-cased (A-Z); null for a key below min_chars code points."""

    def key(line: Column) -> Column:
        stripped = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(stripped) >= min_chars, F.struct(F.xxhash64(stripped).alias("h"), F.xxhash64(F.lit(1), stripped).alias("g")))

    return F.transform(F.split(ascii_lower(text), "\n"), key)


def drop_frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batch_rows: int = 50_000_000, least_batches: int = 4) -> DataFrame:
    """The rows of df with n_lines, n_dropped and kept_text added: lines whose key is in at least min_docs documents are dropped everywhere.

    Documents go through the runs in batches, by hash, of about batch_rows or smaller. The lines to drop come back as
    positions by text, and only where they are no small table the text is shuffled.

    Null text is one empty line, and its kept text is empty. Each row counts as a document, repeated rows too.
    Null ids work like others. Other columns pass through; a column named like an added one is replaced. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    lines = cut(df.select(digest.alias("digest"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 20)).alias("lot"), line_hashes(text, min_chars).alias("lines")), "lines")
    batches = max(least_batches, -(-lines.count() // batch_rows))
    lines = cut(lines.withColumn("batch", (F.col("lot") % batches).cast("int")), "batches", partition_by="batch")
    with LineRuns(df.sparkSession, min_docs) as runs:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select(F.explode(F.array_distinct("lines")).alias("l")).where("l is not null").select("l.h", "l.g"))
        frequent = runs.frequent()
    # copies of a text lose the same lines: each text is looked at once
    at = lines.select("digest", F.posexplode("lines").alias("pos", "l")).select("digest", "pos", "l.h", "l.g")
    drop = lookup(at, frequent, KEY).groupBy("digest").agg(F.collect_set("pos").alias("drop"))
    split = F.split(F.coalesce(F.col("row")[text_col], F.lit("")), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce("drop", F.array().cast("array<int>")))
    joined = df.select(carried(df), digest.alias("digest")).join(bounded(cut(drop, "drop"), otherwise="shuffle_hash"), "digest", "left").withColumn("left", left)
    added = {
        "n_lines": F.size(split).cast("long"),
        "n_dropped": (F.size(split) - F.size("left")).cast("long"),
        "kept_text": F.array_join(F.transform("left", lambda i: F.get(split, i)), "\n"),
    }
    return unpacked(joined, df, added)
