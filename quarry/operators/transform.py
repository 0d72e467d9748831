"""Format conversion and declarative transforms of rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.edits import apply_edits, check, edited, redact_json
from quarry.functions.jsontext import alone

#: The format that each conversion reads.
CONVERSIONS = {"sharegpt-to-openai": ("sharegpt",), "openai-to-sharegpt": ("openai-chat", "openai-chat-loose"), "alpaca-to-openai": ("alpaca",), "completion-to-openai": ("completion",)}
#: Tag of the pipeline file form.
PIPELINE_TAG, PIPELINE_VERSION = "quarry-pipeline", 1


def _directions(direction: str) -> dict[str, str]:
    """The conversion of each format that a direction reads; `any-to-openai` takes each row by its own format."""
    names = [d for d in CONVERSIONS if d.endswith("to-openai")] if direction == "any-to-openai" else [direction]
    return {fmt: d for d in names for fmt in CONVERSIONS[d]}


def convert(rows: DataFrame, direction: str) -> DataFrame:
    """(row_id, fmt, before, after) of the live rows in the direction's formats, in one pass."""
    by = _directions(direction)
    live = rows.where("not deleted and not error").where(F.col("fmt").isin(*by)).select("row_id", "fmt", F.col("json").alias("before"))
    after = F.coalesce(*[F.when(F.col("fmt") == f, edited(F.col("before"), {"op": d})) for f, d in by.items()], F.col("before"))
    return live.select("*", alone(after).alias("after"))


def convert_counts(rows: DataFrame, direction: str) -> DataFrame:
    """(converted, skipped) over live rows."""
    fits = F.col("fmt").isin(*_directions(direction))
    return rows.where("not deleted").agg(F.count_if(fits).alias("converted"), F.count_if(~fits).alias("skipped"))


def read_pipeline(text: str, tag: str = PIPELINE_TAG) -> list[dict]:
    """The edits of a pipeline file: its tag, version and list of ops are checked."""
    found = json.loads(text)
    if not isinstance(found, dict) or found.get("format") != tag or found.get("schemaVersion") != PIPELINE_VERSION or not isinstance(found.get("ops"), list):
        raise ValueError("no pipeline: format, schemaVersion and ops are needed")
    return check(found["ops"])


def write_pipeline(ops: list[dict], tag: str = PIPELINE_TAG) -> str:
    """The file form of a list of edits."""
    return json.dumps({"format": tag, "schemaVersion": PIPELINE_VERSION, "ops": check(ops)}, indent=2)


def apply_ops(rows: DataFrame, ops: list[dict]) -> DataFrame:
    """(row_id, before, after, changed, failed) of the live rows that are no error rows."""
    live = rows.where("not deleted and not error").select("row_id", F.col("json").alias("before"))
    out = apply_edits(live, "before", ops, "e")
    failed = F.col("e.refused") > 0
    return out.select("row_id", "before", F.when(failed, F.col("before")).otherwise(F.col("e.json")).alias("after"), (~failed & (F.col("e.json") != F.col("e.plain"))).alias("changed"), failed.alias("failed"))


def dry_run(rows: DataFrame, ops: list[dict], limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(touched, errors) counts, and the first rows before and after."""
    done = apply_ops(rows, ops)
    return done.agg(F.count_if("changed").alias("touched"), F.count_if("failed").alias("errors")), done.orderBy("row_id").limit(limit)


def apply_all(rows: DataFrame, ops: list[dict]) -> DataFrame:
    """(row_id, raw, dirty) with changed rows replaced and dirty; rows on which an edit fails stay."""
    done = apply_ops(rows, ops).where("changed").select(F.col("row_id").alias("__id"), "after")
    out = rows.select("row_id", "raw", "dirty").join(done, F.col("row_id") == F.col("__id"), "left")
    return out.select("row_id", F.coalesce("after", "raw").alias("raw"), (F.col("dirty") | F.col("__id").isNotNull()).alias("dirty"))


def redact_all(rows: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    """(row_id, before, after, matches) of the live rows in which something is redacted: string values of the JSON, the raw text of error rows."""
    from quarry.operators.pii import redacted

    live = rows.where("not deleted")
    good = live.where("not error").select("row_id", F.col("json").alias("before"), redact_json(F.col("json"), enabled).alias("r")).select("row_id", "before", F.col("r.json").alias("after"), "r.matches")
    bad = live.where("error").select("row_id", F.col("raw").alias("before"), redacted(F.col("raw"), enabled).alias("r")).select("row_id", "before", F.col("r.text").alias("after"), "r.matches")
    return good.unionByName(bad).where("matches > 0")
