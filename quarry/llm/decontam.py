"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quarry.llm.text import carried, small_batches, unpacked, utf8
from quarry.plans.lineage import bounded, cut

#: Fixed by the contract: words are runs of digits, letters a-z and all bytes of other characters.
_DELIMITERS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Words of a block, from which shifts and buckets are looked up.
BLOCK = 2


def item_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a text."""
    return text.lower().translate(_DELIMITERS).split()


#: Search tables for the windows of one length: (length, block size, shift: a block's words -> how far the window
#: may move on, bucket: last block of a window -> first block -> [(words, items)]). Plain values, as they are broadcast.
Patterns = tuple[int, int, dict, dict]


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of `size` words; a shorter text is one window, an empty one none."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build(found: dict[tuple[bytes, ...], set[str]]) -> list[Patterns]:
    """Tables for {window: items}, one set for each length."""
    out = []
    for n in sorted({len(w) for w in found}):
        b = min(BLOCK, n)
        shift: dict = {}
        bucket: dict = {}
        for w, items in found.items():
            if len(w) == n:
                for end in range(b, n + 1):
                    part = w[end - b : end]
                    shift[part] = min(shift.get(part, n), n - end)
                bucket.setdefault(w[n - b :], {}).setdefault(w[:b], []).append((list(w), sorted(items)))
        out.append((n, b, shift, bucket))
    return out


def search(words: list[bytes], tables: list[Patterns]) -> tuple[list[int], set[str]]:
    """Starts and ends (alternating, merged within a length) of all windows that occur, and their items."""
    spans: list[int] = []
    items: set[str] = set()
    n = len(words)
    for length, b, shift, bucket in tables:
        far, at, mine = length - b + 1, length, []
        move = shift.get
        while at <= n:
            end = tuple(words[at - b : at])
            step = move(end, far)
            if step:
                at += step
                continue
            first = at - length
            for pattern, ids in bucket[end].get(tuple(words[first : first + b]), ()):
                if words[first:at] == pattern:
                    items.update(ids)
                    if mine and first <= mine[-1]:
                        mine[-1] = at
                    else:
                        mine += [first, at]
            at += 1
        spans += mine
    return spans, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[dict]:
    """{window: items} in blocks of about `most` windows; the driver holds one block at a time."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in benchmark.select(F.col(id_col).cast("string"), utf8(F.col(text_col))).toLocalIterator():
        for w in windows(item_words(bytes(text)), size):
            block.setdefault(w, set()).update([item] if item is not None else [])
        if len(block) >= most:
            yield block
            block = {}
    if block:
        yield block


def hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_windows: int = 100_000) -> DataFrame:
    """(digest, n_hit, items) of each different text of df in which a window occurs; digest is the binary md5 of the text.

    The benchmark is the stated query set. Its windows are searched in blocks of
    block_windows: a block is broadcast as Wu-Manber tables, run against every document, and taken
    down again before the next, so one block is the most that a worker holds. Only what is found is written.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = StructType([StructField("spans", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])
    arrow = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def finder(tables) -> Column:
        @F.arrow_udf(kind)
        def find(texts: pa.Array) -> pa.Array:
            found = [search(item_words(t.as_py()), tables.value) for t in texts]
            return pa.array([{"spans": spans, "items": sorted(items)} for spans, items in found], arrow)

        # a filter on what it finds would otherwise be pushed below, with a second pass over the texts
        return find.asNondeterministic()(utf8(F.col(text_col)))

    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, size, block_windows):
        tables = spark.sparkContext.broadcast(build(block))
        part = df.select(text_digest(text_col).alias("digest"), finder(tables).alias("f")).where(F.size("f.spans") > 0)
        parts.append(cut(part.select("digest", "f.*"), "found"))
        tables.destroy()
    if not parts:
        return spark.createDataFrame([], "digest binary, n_hit long, items array<string>")
    found = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    spans = F.col("spans")
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, i * 2).alias("s"), F.get(spans, i * 2 + 1).alias("e"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    merged = F.aggregate(
        pairs,
        start,
        lambda a, p: F.struct(F.greatest(a["end"], p["e"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), p["e"] - F.greatest(a["end"], p["s"]))).cast("long").alias("hit")),
    )
    return cut(found.select("digest", merged["hit"].alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items")), "hits")


def text_digest(text_col: str) -> Column:
    """Binary md5 of a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def find_items(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_windows: int = 100_000) -> DataFrame:
    """df with n_words, n_hit (words inside an occurrence of a window), items (sorted ids as strings) and contaminated added.

    Null text has no words. A benchmark text of fewer than `size` words is one window; null or without words, none.
    A null item id marks hits but is not listed. Repeated rows and items change nothing. Columns named like the added ones are replaced. Empty tables work.
    """
    found = hits(df, benchmark, text_col, item_col, item_text_col, size, block_windows)

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(item_words(t.as_py())) for t in texts], pa.int64())

    rows = df.select(carried(df), text_digest(text_col).alias("digest"), count(utf8(F.col(text_col))).alias("n_words"))
    rows = rows.join(bounded(found), "digest", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return unpacked(rows, df, {"n_words": F.col("n_words"), "n_hit": n_hit, "items": F.coalesce("items", F.array().cast("array<string>")), "contaminated": n_hit > 0})


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of df in which no window of the benchmark occurs, with its columns."""
    found = hits(df, benchmark, text_col, item_col, item_text_col, size).select(F.col("digest"))
    return df.select(carried(df), text_digest(text_col).alias("digest")).join(bounded(found), "digest", "left_anti").select("row.*")
