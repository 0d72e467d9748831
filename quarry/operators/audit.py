"""The audit: profile, statistics, lint, personal data, duplicates and score in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.features import row_tokens
from quarry.operators.aggregates import profile, quality_score, score_tier, summarize
from quarry.operators.dedup import exact_dedup
from quarry.operators.lint import lint
from quarry.operators.pii import scan
from quarry.plans.lineage import cut

#: Scores that are kept.
HISTORY = 10


def pii_rows_light(rows: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    """(row_id, pii) of the live rows with personal data in their serialised form: ids of the matches, no positions."""
    text = F.when(F.col("error"), F.col("raw")).otherwise(F.col("json"))
    return rows.where("not deleted").select("row_id", F.transform(scan(text, enabled), lambda x: x.getField("id")).alias("pii")).where(F.size("pii") > 0)


def audit(rows: DataFrame) -> dict[str, DataFrame]:
    """profile, tokens, lint, pii, dups and a one-row summary with the score. Features are written once and shared."""
    rows = cut(rows.withColumn("row_tokens", row_tokens()), "features")
    live = rows.where("not deleted")
    formats = cut(profile(rows), "profile")
    issues = cut(lint(rows), "lint")
    personal = cut(pii_rows_light(rows), "pii")
    dups = cut(exact_dedup(rows), "dups")
    counts = live.agg(F.count("*").alias("total"), F.count_if("error").alias("parse_err"))
    counts = counts.crossJoin(issues.agg(F.count_if(F.exists("issues", lambda i: i["sev"] == "error")).alias("lint_err_rows"), F.count("*").alias("lint_rows")))
    counts = counts.crossJoin(personal.agg(F.count("*").alias("pii_rows"), F.coalesce(F.sum(F.size("pii")), F.lit(0)).alias("pii_matches")))
    counts = counts.crossJoin(dups.agg((F.count("*") - F.count_distinct("cluster")).alias("dup_rows"), F.count_distinct("cluster").alias("dup_clusters")))
    top = formats.where("place = 1").select(F.col("fmt").alias("dominant"), F.col("share").alias("dominant_share"))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    summary = counts.join(top, F.lit(True), "left").withColumns({"dominant": F.coalesce("dominant", F.lit("unknown")), "dominant_share": F.coalesce("dominant_share", F.lit(0.0))})
    summary = summary.withColumn("score", quality_score(F.col("dominant_share"), share("parse_err"), share("lint_err_rows"), share("pii_rows"), share("dup_rows")))
    return {"profile": formats, "tokens": summarize(rows.where("not deleted"), "row_tokens"), "lint": issues, "pii": personal, "dups": dups, "summary": summary.withColumn("tier", score_tier(F.col("score")))}


def attach_findings(rows: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(row_id, lint_n, worst, pii_n, pii_types, dup) of every row: counts and badges, zero and empty without findings."""
    worst = F.when(F.exists("issues", lambda i: i["sev"] == "error"), "error").otherwise("warn")
    lint_ = found["lint"].select("row_id", F.size("issues").alias("lint_n"), worst.alias("worst"))
    pii = found["pii"].select("row_id", F.size("pii").alias("pii_n"), F.array_sort(F.array_distinct("pii")).alias("pii_types"))
    dup = found["dups"].select("row_id", F.lit(True).alias("dup"))
    out = rows.select("row_id").join(lint_, "row_id", "left").join(pii, "row_id", "left").join(dup, "row_id", "left")
    return out.select("row_id", F.coalesce("lint_n", F.lit(0)).alias("lint_n"), "worst", F.coalesce("pii_n", F.lit(0)).alias("pii_n"), F.coalesce("pii_types", F.array().cast("array<string>")).alias("pii_types"), F.coalesce("dup", F.lit(False)).alias("dup"))


def push_score(summary: DataFrame, path: str, ran_at: str) -> None:
    """Append (score, ran_at, lint_n, pii_n, dup_n) to the history."""
    row = summary.select("score", F.lit(ran_at).cast("timestamp").alias("ran_at"), F.col("lint_rows").alias("lint_n"), F.col("pii_matches").alias("pii_n"), F.col("dup_clusters").alias("dup_n"))
    row.write.mode("append").parquet(path)


def score_history(history: DataFrame) -> DataFrame:
    """The latest HISTORY scores, newest first."""
    return history.orderBy(F.col("ran_at").desc()).limit(HISTORY)


def save_audit(found: dict[str, DataFrame], rows: DataFrame, path: str) -> None:
    """Write an audit's findings with a guard: file names and live rows."""
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    guard(rows).write.mode("overwrite").parquet(f"{path}/guard")


def guard(rows: DataFrame) -> DataFrame:
    """(file, live, mark) of a rows table; file is null where it has no such column. mark: sum of the hashes of the live rows' ids and texts, so any edit changes it."""
    file = F.col("file") if "file" in rows.columns else F.lit(None).cast("string")
    mark = F.sum(F.xxhash64("row_id", "raw").cast("decimal(38,0)"))
    return rows.where("not deleted").groupBy(file.alias("file")).agg(F.count("*").alias("live"), mark.alias("mark"))


def audit_status(rows: DataFrame, path: str) -> DataFrame:
    """(fits, stale) of a saved audit: whether file names and live counts still match, and whether a text, or what is live, has changed since."""
    old, now = rows.sparkSession.read.parquet(f"{path}/guard"), guard(rows)
    old = old.select(*[F.col(c).alias(f"__{c}") for c in old.columns])
    both = now.join(old, F.col("file").eqNullSafe(F.col("__file")), "full_outer")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    return both.agg(F.coalesce(F.bool_and(same("live")), F.lit(True)).alias("fits"), F.coalesce(F.bool_or(~(same("live") & same("mark"))), F.lit(False)).alias("stale"))


def load_audit(rows: DataFrame, path: str) -> dict[str, DataFrame] | None:
    """A saved audit if file names and live counts still match, else None. With it comes its `status` (fits, stale): texts may have changed."""
    spark = rows.sparkSession
    status = cut(audit_status(rows, path), "status")
    if not status.first().fits:
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("profile", "tokens", "lint", "pii", "dups", "summary")} | {"status": status}
