"""Filters, sorts and pages over the rows table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.features import search_text

LIVE = "not deleted"


def search(query: str) -> Column:
    """Case-insensitive substring of the serialised row; an empty query matches all."""
    return F.contains(search_text(), F.lit(query.lower())) if query else F.lit(True)


def token_range(least: float | None = None, most: float | None = None) -> Column:
    """Inclusive range of item tokens; None is open."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("tokens") >= least)
    return out & (F.col("tokens") <= most) if most is not None else out


def _holds(col: str, wanted: list[str]) -> Column:
    out = F.lit(True)
    for w in wanted:
        out = out & F.array_contains(col, w)
    return out


def has_keys(keys: list[str]) -> Column:
    """All top-level keys are there."""
    return _holds("top_keys", keys)


def has_tags(tags: list[str]) -> Column:
    """All tags are there."""
    return _holds("tags", tags)


def review_in(states: list[str]) -> Column:
    """Review state is one of states; a row without one counts as `none`."""
    return F.coalesce("review", F.lit("none")).isin(*states)


def with_findings(rows: DataFrame, *findings: DataFrame) -> DataFrame:
    """Live rows with any finding (frames with row_id)."""
    ids = findings[0].select("row_id")
    for f in findings[1:]:
        ids = ids.unionByName(f.select("row_id"))
    return rows.where(LIVE).join(ids.distinct(), "row_id", "left_semi")


def clean_rows(rows: DataFrame, *findings: DataFrame) -> DataFrame:
    """Live rows not approved yet, without any finding."""
    out = rows.where(LIVE).where(F.coalesce("review", F.lit("")) != "approve")
    for f in findings:
        out = out.join(f.select("row_id"), "row_id", "left_anti")
    return out


def view_counts(rows: DataFrame, view: Column) -> DataFrame:
    """(live, hidden, excluded_in_view, will_export) under a view filter."""
    seen = F.coalesce(view, F.lit(False))
    live = rows.where(LIVE)
    return live.agg(F.count("*").alias("live"), F.count_if(~seen).alias("hidden"), F.count_if(seen & F.col("excluded")).alias("excluded_in_view"), F.count_if(seen & ~F.col("excluded")).alias("will_export"))


def sort_rows(rows: DataFrame, mode: str = "default") -> DataFrame:
    """File order, or `tokens-asc`, `tokens-desc`, `chars-asc`, `chars-desc`; ties stay in file order."""
    if mode == "default":
        return rows.orderBy("row_id")
    col, _, way = mode.partition("-")
    by = F.col({"tokens": "tokens", "chars": "char_count"}[col])
    return rows.orderBy(by.asc() if way == "asc" else by.desc(), "row_id")


def page(rows: DataFrame, pages: int = 1, size: int = 200, mode: str = "default") -> DataFrame:
    """The first pages of the sorted rows."""
    return sort_rows(rows, mode).limit(size * pages)


def longest_rows(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k live rows with most tokens: (row_id, tokens, text), the text cut at 200 characters."""
    from quarry.functions.features import row_text

    return rows.where(LIVE).orderBy(F.col("tokens").desc(), "row_id").limit(k).select("row_id", "tokens", F.left(row_text(), F.lit(200)).alias("text"))
