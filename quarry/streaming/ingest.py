"""JSONL as a stream, and the audit of what arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.features import row_tokens, rows_table
from quarry.functions.json import SPACE
from quarry.operators.audit import pii_rows_light
from quarry.operators.lint import issues


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each stretch of a file that a task reads."""
    at, n = None, 0
    for batch in batches:
        places = []
        for where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = n + 1 if where == at else 0
            at = where
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "start", "raw", "line"])


def stream_read_jsonl(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streaming rows table of the JSONL files of a folder: same rows as read_jsonl, without numbers across the stream.

    row_id is a hash of the file, the stretch of it that a task reads, and the line's number there, so equal lines have ids of their own.
    """
    text = spark.readStream.options(lineSep="\n", **options).text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", r"\r$", "").alias("raw"))
    lines = lines.mapInArrow(_numbered, "file string, start long, raw string, line long").where(~F.col("raw").rlike(f"^{SPACE}*$"))
    return rows_table(lines.select("file", "raw", F.xxhash64("file", "start", "line").alias("row_id")))


def row_findings(rows: DataFrame) -> DataFrame:
    """(row_id, file, fmt, row_tokens, issues): row-level audit, in batch or stream."""
    return rows.select("row_id", "file", "fmt", row_tokens().alias("row_tokens"), issues().alias("issues"))


def audit_on_arrival(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write findings of each micro-batch under path (rows, pii, formats), each batch once by its number; runs over what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        row_findings(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        pii_rows_light(batch).write.mode("overwrite").parquet(f"{path}/pii/batch={number}")
        batch.groupBy("fmt").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/formats/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_audit(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counters of the audit of all rows that have come in, and write those that a micro-batch changes under path, by its number; runs over what is there and ends.

    The state of the stream is keyed by counter: totals, formats, numbers of tokens and the digest of each text, so duplicates are found across
    batches and restarts. It holds one number a key, in the checkpoint. A batch that is run again overwrites its own output.
    """
    from quarry.operators.upkeep import contributions, counters

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counted = counters(contributions(rows))
    return counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counters(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value, n): the latest value of each counter of running_audit; feed it to upkeep.summary."""
    written = spark.read.parquet(path)
    return written.groupBy("kind", "value").agg(F.max_by("n", "batch").alias("n"))
