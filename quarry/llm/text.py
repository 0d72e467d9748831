"""Text helpers shared by the operators: words of UTF-8 bytes inside tasks, and their Spark twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: a word is a run outside space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that are stripped or split at.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches of whole texts small, so that very long documents fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same on a text without other characters, and is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def utf8(text: Column) -> Column:
    """The text's bytes; null is empty. bytes.split() and bytes.lower() then follow WORD and A-Z exactly."""
    return F.coalesce(text, F.lit("")).cast("binary")


def carried(df: DataFrame) -> Column:
    """A row of df as one struct `row`, so that none of its columns can clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(rows: DataFrame, df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """rows (with the struct `row` of df's rows) as the columns of df and the added ones, which replace those of the same name."""
    fields = [F.col("row")[c].alias(c) for c in df.columns if c not in added] + [c.alias(n) for n, c in added.items()]
    # one struct and its star: as single columns, an alias `row` would shadow the struct
    return rows.select(F.struct(*fields).alias("all")).select("all.*")
