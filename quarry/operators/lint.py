"""Lint findings of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.features import row_tokens
from quarry.functions.rowscan import ISSUES, SEVERITY


def issues() -> Column:
    """Array of (code, sev, turn) of a row of the rows table: what its format gave rise to, and `very-short`."""
    short = F.array(F.struct(F.lit("very-short").alias("code"), F.lit(SEVERITY["very-short"]).alias("sev"), F.lit(None).cast("int").alias("turn")))
    return F.when(~F.col("error") & (row_tokens() < 5), F.concat("form_issues", short)).otherwise(F.col("form_issues")).cast(ISSUES)


def lint(rows: DataFrame) -> DataFrame:
    """(row_id, issues) of the live rows with any issue."""
    return rows.where("not deleted").select("row_id", issues().alias("issues")).where(F.size("issues") > 0)


def lint_counts(findings: DataFrame) -> DataFrame:
    """(code, sev, issues, rows) for each code."""
    return findings.select("row_id", F.explode("issues").alias("i")).groupBy("i.code", "i.sev").agg(F.count("*").alias("issues"), F.count_distinct("row_id").alias("rows"))


def exclude_lint_errors(rows: DataFrame) -> DataFrame:
    """Rows with `excluded` set where a live row has an issue of severity error."""
    bad = F.exists(issues(), lambda i: i["sev"] == "error") & ~F.col("deleted")
    return rows.withColumn("excluded", F.col("excluded") | bad)
