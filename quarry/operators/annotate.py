"""Review states, tags, flags and undo, as an append-only log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Changes that the log knows: seq (order), row_id, field, value. tag+ and tag- are sets of one tag.
FIELDS = ("review", "excluded", "deleted", "raw", "tag+", "tag-")
#: Undo levels kept.
UNDO_LEVELS = 10


def change(rows: DataFrame, seq: int, field: str, value: Column | str | None) -> DataFrame:
    """Log entries that set a field of all given rows: one bulk operation with one seq."""
    if field not in FIELDS:
        raise ValueError(f"no field {field!r}")
    value = value if isinstance(value, Column) else F.lit(value)
    return rows.select(F.lit(seq).cast("long").alias("seq"), "row_id", F.lit(field).alias("field"), value.cast("string").alias("value"))


def toggle_tag(rows: DataFrame, seq: int, tag: str) -> DataFrame:
    """Log entries that take a tag off the rows that have it and put it on the others."""
    has = F.array_contains("tags", tag)
    return rows.select(F.lit(seq).cast("long").alias("seq"), "row_id", F.when(has, "tag-").otherwise("tag+").alias("field"), F.lit(tag).alias("value"))


def undo(log: DataFrame, levels: int = 1) -> DataFrame:
    """The log without its last operations, at most UNDO_LEVELS."""
    last = log.select("seq").distinct().orderBy(F.col("seq").desc()).limit(min(levels, UNDO_LEVELS))
    return log.join(F.broadcast(last), "seq", "left_anti")


def state(rows: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """Rows as of operation `upto` of the log (all by default): review, excluded, deleted, tags, dirty, and raw where rows have it.

    A row's entries are gathered and replayed in order: the latest change of a field wins, a tag goes behind the others when it is put on a row
    without it. Where rows have the columns of a rows table, these are made anew from the text.
    """
    from quarry.functions.features import rows_table

    log = log if upto is None else log.where(F.col("seq") <= upto)
    entry = F.struct("seq", "field", "value")
    kept = log.groupBy(F.col("row_id").alias("__id")).agg(F.array_sort(F.collect_list(entry)).alias("__log"))
    out = rows.join(kept, F.col("row_id") == F.col("__id"), "left").drop("__id")
    entries = F.coalesce("__log", F.array().cast("array<struct<seq:bigint,field:string,value:string>>"))
    of = lambda field: F.filter(entries, lambda e: e["field"] == field)
    last = lambda field: F.try_element_at(of(field), F.lit(-1))["value"]

    def replayed(tags: Column, e: Column) -> Column:
        put = F.when(F.array_contains(tags, e["value"]), tags).otherwise(F.concat(tags, F.array(e["value"])))
        return F.when(e["field"] == "tag+", put).when(e["field"] == "tag-", F.array_remove(tags, e["value"])).otherwise(tags)

    changed = {
        "review": F.when(F.size(of("review")) > 0, last("review")).otherwise(F.col("review")),
        "excluded": F.coalesce(last("excluded").cast("boolean"), F.col("excluded")),
        "deleted": F.coalesce(last("deleted").cast("boolean"), F.col("deleted")),
        "tags": F.aggregate(entries, F.col("tags"), replayed),
        "dirty": F.col("dirty") | (F.size(of("raw")) > 0),
    }
    if "raw" in rows.columns:
        changed["raw"] = F.coalesce(last("raw"), F.col("raw"))
    out = out.withColumns(changed).drop("__log")
    return rows_table(out) if {"raw", "json", "fmt"} <= set(rows.columns) else out


def flag_rejected(rows: DataFrame, flag: str = "excluded") -> DataFrame:
    """Rows with `excluded` or `deleted` set where review is reject."""
    return rows.withColumn(flag, F.col(flag) | F.coalesce(F.col("review") == "reject", F.lit(False)))


def approve_clean(rows: DataFrame, *findings: DataFrame) -> DataFrame:
    """Rows with review = approve where no finding names them."""
    from quarry.operators.filters import clean_rows

    ids = clean_rows(rows, *findings).select(F.col("row_id").alias("__id"))
    out = rows.join(ids, rows.row_id == F.col("__id"), "left")
    return out.withColumn("review", F.when(F.col("__id").isNotNull(), "approve").otherwise(F.col("review"))).drop("__id")


def replace_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The source columns (row_id, raw, dirty) with edits (row_id, raw, and seq where there is an order) applied: valid JSON replaces a row's text; other edits are refused.

    Of several edits of a row the last by seq counts, without seq the greatest text. Build the rows table anew from the result.
    """
    from quarry.functions.json import strict_variant

    order = F.col("seq") if "seq" in edits.columns else F.col("raw")
    good = edits.where(strict_variant(F.col("raw")).isNotNull()).groupBy(F.col("row_id").alias("__id")).agg(F.max_by("raw", order).alias("__new"))
    out = rows.select("row_id", "raw", "dirty").join(good, F.col("row_id") == F.col("__id"), "left")
    return out.select("row_id", F.coalesce("__new", "raw").alias("raw"), (F.col("dirty") | F.col("__new").isNotNull()).alias("dirty"))


def add_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """(row_id, raw, dirty) with new texts (column raw) appended under the next ids, dirty: in order of their column seq, without one as they arrive."""
    from quarry.plans.lineage import global_rank

    last = rows.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("last"))
    seq = F.col("seq") if "seq" in new.columns else F.monotonically_increasing_id()
    placed = global_rank(new.select("raw", seq.alias("__seq")), [F.col("__seq"), F.col("raw")], "at").crossJoin(F.broadcast(last))
    return rows.select("row_id", "raw", "dirty").unionByName(placed.select((F.col("last") + 1 + F.col("at")).alias("row_id"), "raw", F.lit(True).alias("dirty")))


def reset_rows(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    """(row_id, raw, dirty) of the loaded snapshot for rows that are edited; the rest as they are."""
    before = loaded.select(F.col("row_id").alias("__id"), F.col("raw").alias("__old"))
    out = rows.select("row_id", "raw", "dirty").join(before, F.col("row_id") == F.col("__id"), "left")
    back = F.col("dirty") & F.col("__id").isNotNull()
    return out.select("row_id", F.when(back, F.col("__old")).otherwise(F.col("raw")).alias("raw"), (F.col("dirty") & ~back).alias("dirty"))
