"""An audit that is kept up: each row's contribution, counters by plus and minus, and the summary that they add up to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.features import row_text, row_tokens
from quarry.operators.aggregates import quality_score, score_tier, summarize_counts
from quarry.operators.lint import issues
from quarry.operators.pii import scan
from quarry.plans.lineage import bounded, cut

CONTRIBUTION = "row_id long, fmt string, error boolean, tokens long, lint_n int, lint_err boolean, pii_n int, k string"
_KEPT = f"{CONTRIBUTION}, live boolean, version long"
_COUNTERS = "kind string, value string, n long"


def contributions(rows: DataFrame) -> DataFrame:
    """CONTRIBUTION of each live row of a rows table: what the audit counts of it, and the digest of its text."""
    text = F.when(F.col("error"), F.col("raw")).otherwise(F.col("json"))
    bad = F.exists("issues", lambda i: i["sev"] == "error")
    key = F.when(row_text() != "", F.sha2(row_text(), 256))
    found = rows.where("not deleted").select("row_id", "fmt", "error", row_tokens().alias("tokens"), issues().alias("issues"), F.size(scan(text)).alias("pii_n"), key.alias("k"))
    return found.select("row_id", "fmt", "error", "tokens", F.size("issues").alias("lint_n"), bad.alias("lint_err"), "pii_n", "k")


def counters(found: DataFrame, sign: int = 1) -> DataFrame:
    """(kind, value, n) that contributions add to the counters, or take from them: totals, rows by format, by tokens and by digest."""
    one = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    nothing, n = F.lit(""), F.lit(1)
    all_ = F.array(
        one("total", nothing, n),
        one("parse_err", nothing, flag(F.col("error"))),
        one("lint_err_rows", nothing, flag(F.col("lint_err"))),
        one("lint_rows", nothing, flag(F.col("lint_n") > 0)),
        one("pii_rows", nothing, flag(F.col("pii_n") > 0)),
        one("pii_matches", nothing, F.col("pii_n")),
        one("fmt", F.col("fmt"), n),
        one("tokens", F.col("tokens"), n),
        one("key", F.col("k"), flag(F.col("k").isNotNull())),
    )
    parts = found.select(F.explode(F.filter(all_, lambda e: e["n"] != 0)).alias("e")).select("e.*")
    return parts.groupBy("kind", "value").agg((F.sum("n") * sign).alias("n"))


def summary(counted: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """The one-row summary of audit() from counters (kind, value, n), of which those of one kind and value are added up.

    firsts: (fmt, first) decides between formats with as many rows, the earlier one; without it, their names do.
    """
    totals = counted.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    many = (F.col("kind") == "key") & (F.col("n") > 1)
    number = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    tied = F.struct("n", F.negative(F.coalesce("first", F.lit(0))).alias("first"), "value") if firsts is not None else F.struct("n", "value")
    joined = totals if firsts is None else totals.join(F.broadcast(firsts), (F.col("kind") == "fmt") & (F.col("value") == F.col("fmt")), "left")  # a dozen formats
    dominant = F.max(F.when(F.col("kind") == "fmt", tied))
    row = joined.agg(
        *[number(k) for k in ("total", "parse_err", "lint_err_rows", "lint_rows", "pii_rows", "pii_matches")],
        F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("dup_rows"),
        F.count_if(many).alias("dup_clusters"),
        dominant.alias("top"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    row = row.withColumns({"dominant": F.coalesce("top.value", F.lit("unknown")), "dominant_share": F.when(F.col("total") > 0, F.coalesce("top.n", F.lit(0)) / F.col("total")).otherwise(0.0)}).drop("top")
    row = row.withColumn("score", quality_score(F.col("dominant_share"), share("parse_err"), share("lint_err_rows"), share("pii_rows"), share("dup_rows")))
    return row.withColumn("tier", score_tier(F.col("score")))


class AuditView:
    """An audit in a folder that is brought up to date from changed rows alone.

    It holds a contribution of each row and a ledger of counters. A refresh looks up what the changed rows counted before, and
    adds what they count now less that to the ledger; texts of other rows are not read. Each refresh is a version of its own, in force once its mark is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, of: int = 0) -> AuditView:
        """The audit of a rows table; `of` is the rows' own version, if they have one (see RowStore)."""
        view = cls(rows.sparkSession, path)
        view._write(0, contributions(rows), None, of)
        return view

    def _marks(self) -> list[tuple[int, int]]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(tuple(map(int, f.getPath().getParent().getName().split("-"))) for f in found)

    def _write(self, version: int, found: DataFrame, gone: DataFrame | None, of: int) -> None:
        new = cut(found, "contributions")
        kept = new.withColumns({"live": F.lit(True), "version": F.lit(version).cast("long")})
        ledger = counters(new)
        if gone is not None:  # ids of the changed rows: what they counted is taken back
            old = cut(self.contributions().join(bounded(gone), "row_id", "left_semi"), "old")
            ledger = ledger.unionByName(counters(old, -1)).groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")
            dead = gone.join(bounded(new.select("row_id")), "row_id", "left_anti").withColumns({"live": F.lit(False), "version": F.lit(version).cast("long")})
            kept = kept.unionByName(dead, allowMissingColumns=True)
        kept.write.mode("overwrite").parquet(f"{self.path}/rows/{version:08d}")
        ledger.write.mode("overwrite").parquet(f"{self.path}/ledger/{version:08d}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/marks/{version:08d}-{of}")

    def _tables(self, name: str, schema: str) -> list[DataFrame]:
        return [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{v:08d}") for v, _ in self._marks()]

    def contributions(self) -> DataFrame:
        """CONTRIBUTION of the rows in force: the first table less what later ones name, and of those the latest."""
        base, *later = self._tables("rows", _KEPT)
        names = [f.split(" ")[0] for f in CONTRIBUTION.split(", ")]
        if not later:
            return base.select(*names)
        newer = later[0]
        for table in later[1:]:
            newer = newer.unionByName(table)
        latest = cut(newer.groupBy("row_id").agg(F.max_by(F.struct(*[c for c in newer.columns if c != "row_id"]), "version").alias("r")).select("row_id", "r.*"), "latest")
        rest = base.join(bounded(latest.select("row_id")), "row_id", "left_anti")
        return rest.select(*names).unionByName(latest.where("live").select(*names))

    @property
    def of(self) -> int:
        """The version of the rows that the audit stands for."""
        return self._marks()[-1][1]

    def refresh(self, changed: DataFrame, of: int = 0) -> None:
        """Count the changed rows anew. changed: their rows table as it is now, deleted rows too; other rows of the audit stay."""
        changed = cut(changed, "changed")
        self._write(self._marks()[-1][0] + 1, contributions(changed), changed.select("row_id").distinct(), of)

    def counters(self) -> DataFrame:
        """(kind, value, n) in force."""
        out = None
        for table in self._tables("ledger", _COUNTERS):
            out = table if out is None else out.unionByName(table)
        return out.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def summary(self) -> DataFrame:
        """The summary of audit(), from the counters; the rows are asked only which of two equally frequent formats comes first."""
        counted = cut(self.counters(), "counters")
        formats = [r.n for r in counted.where("kind = 'fmt'").select("n").collect()]  # a dozen formats
        tied = formats.count(max(formats, default=0)) > 1
        firsts = self.contributions().groupBy("fmt").agg(F.min("row_id").alias("first")) if tied else None
        return summary(counted, firsts)

    def tokens(self) -> DataFrame:
        """The summary of tokens of audit(), from the counters."""
        return summarize_counts(self.counters().where("kind = 'tokens'").select(F.col("value").cast("long").alias("x"), F.col("n").alias("c")))

    def compact(self) -> None:
        """Write rows and counters in force as a view of one version, in a folder beside this one, and go on there."""
        into = f"{self.path}-{uuid.uuid4().hex}"
        of = self.of
        self.contributions().withColumns({"live": F.lit(True), "version": F.lit(0).cast("long")}).write.parquet(f"{into}/rows/{0:08d}")
        self.counters().write.parquet(f"{into}/ledger/{0:08d}")
        self.spark.range(1).write.parquet(f"{into}/marks/{0:08d}-{of}")
        self.path = into
