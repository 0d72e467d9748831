"""Source divergence audit by single-pass in-memory indexing: block postings, term-sorted runs, heap merges, pair corrections."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import small_batches, utf8
from quarry.plans.lineage import bounded, cut

#: Fixed by the contract: terms are runs of letters, of which only A-Z are lower-cased, and of all bytes of other characters. 0 is no term.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Fixed by the contract: added to each count, and the scale of the shares.
PRIOR, SCALE = 2, 1_000_000_000
#: Bytes of postings that a block holds before it is spilled as a run, postings of a piece of a run, those that a merge gathers before it puts out what is complete, and runs that are merged at once.
BLOCK_BYTES, PIECE, GATHER, FAN = 64 << 20, 1024, 1 << 17, 4096
#: A piece of a run: consecutive terms with their postings. Keys are a language and a term with a zero between; sizes: how many of the postings (source, docs, n) each has.
_PIECES = "shard int, run long, first string, keys array<string>, sizes array<int>, sources array<string>, docs array<long>, counts array<long>"
_READ = ["first", "keys", "sizes", "sources", "docs", "counts"]
_COUNTS = "lang string, term string, source string, n long, lang_n long"


def word_counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, documents, occurrences) of a batch of binary texts, each of which belongs to a group (a number)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    letters = _LETTERS[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    begin = offsets[:-1] - offsets[0]
    inside = letters != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    full = begin[begin < len(letters)]
    start[full] = inside[full]
    at = np.flatnonzero(start)
    ends = np.append((np.cumsum(inside) - 1)[at], inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters[inside])).dictionary_encode()
    size = max(len(words.dictionary), 1)
    doc = np.searchsorted(begin, at, side="right") - 1
    seen, times = np.unique(doc * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    key = groups[seen // size] * size + seen % size
    order = np.argsort(key, kind="stable")
    found, first = np.unique(key[order], return_index=True)
    docs = np.diff(np.append(first, len(order)))
    n = np.add.reduceat(times[order], first) if len(found) else np.empty(0, np.int64)
    return found // size, words.dictionary.take(pa.array(found % size)), docs, n


def combined(tables: list[pa.Table]) -> pa.Table:
    """Postings (key, source, docs, n) with those of one key and source added up, in order of key and source."""
    sums = pa.concat_tables(tables).group_by(["key", "source"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return sums.rename_columns(["key", "source", "docs", "n"]).sort_by([("key", "ascending"), ("source", "ascending")]).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def pieces_of(table: pa.Table, run: int, shard_of: np.ndarray, codes: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
    """Rows of _PIECES of a run (sorted postings; codes: place of each one's key in keys; shard_of: each key's shard). A piece ends with a term."""
    order = np.argsort(shard_of[codes], kind="stable")
    codes = codes[order]
    term = np.flatnonzero(np.diff(codes, prepend=-1))  # where each term's postings begin
    shard = shard_of[codes[term]]
    begin = term[np.searchsorted(shard, shard)]  # where each term's shard begins
    piece = np.flatnonzero(np.diff(shard.astype(np.int64) * (len(codes) + 1) + (term - begin) // PIECE, prepend=-1))  # first term of each piece
    of_terms = pa.array(np.append(piece, len(term)), pa.int32())
    of_postings = pa.array(np.append(term[piece], len(codes)), pa.int32())
    names = keys.take(pa.array(codes[term]))
    sizes = pa.array(np.diff(np.append(term, len(codes))), pa.int32())
    rows = table.take(pa.array(order))
    lists = [pa.ListArray.from_arrays(of_terms, names), pa.ListArray.from_arrays(of_terms, sizes), *(pa.ListArray.from_arrays(of_postings, _column(rows, c)) for c in ("source", "docs", "n"))]
    columns = [pa.array(shard[piece], pa.int32()), pa.array(np.full(len(piece), run), pa.int64()), names.take(pa.array(piece)), *lists]
    return pa.RecordBatch.from_arrays(columns, ["shard", "run", *_READ])


def _in_rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def runs(df: DataFrame, shards: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Term-sorted runs (_PIECES) of the texts of df: each task indexes its documents into a block, and spills that whenever it is full and at the end.

    A run is dealt into hash shards by language and term. A null text has no terms; null languages and sources are ''.
    """

    def spill(block: list[pa.Table], run: int) -> Iterator[pa.RecordBatch]:
        table = combined(block)
        coded = _column(table, "key").dictionary_encode()
        shard_of = np.fromiter((zlib.crc32(k.encode()) % shards for k in coded.dictionary.to_pylist()), np.int64)
        yield from _in_rows(pieces_of(table, run, shard_of, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary), 256)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, run = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            places: dict[tuple[str, str], int] = {}
            groups = np.array([places.setdefault(g, len(places)) for g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], np.int64)
            group, terms, docs, n = word_counts(batch.column(0), groups)
            if not len(group):
                continue
            langs, sources = (pa.array([g[k] for g in places]).take(pa.array(group)) for k in (0, 1))
            table = pa.table({"key": pc.binary_join_element_wise(langs, terms, "\0"), "source": sources, "docs": pa.array(docs, pa.int64()), "n": pa.array(n, pa.int64())})
            block.append(table)
            held += table.nbytes
            if held > block_bytes:
                yield from spill(block, run)
                block, held, run = [], 0, run + 1
        if block:
            yield from spill(block, run)

    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(utf8(F.col(text_col)).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source")).mapInArrow(index, _PIECES)


def _postings(keys: pa.Array, sizes: pa.Array, sources: pa.Array, docs: pa.Array, n: pa.Array) -> pa.Table:
    return pa.table({"key": keys.take(pa.array(np.repeat(np.arange(len(keys)), sizes.to_numpy(zero_copy_only=False)))), "source": sources, "docs": docs, "n": n})


def merged(pieces: Iterator[tuple], gather: int = GATHER) -> Iterator[pa.Table]:
    """Heap merge of pieces (first, keys, sizes, sources, docs, counts) that arrive by their first key: sorted postings, added up, no key in two tables.

    Open pieces wait in a heap by their last key. Whenever about `gather` postings are open, what lies before the next piece's first
    key is complete: pieces that end before it leave the heap whole, and of the others that part. So of each run little more than one piece is open at a time.
    """
    heap: list[tuple[str, int, pa.Table]] = []
    held, count, limit = 0, 0, gather

    def complete(bound: str | None) -> list[pa.Table]:
        out = []
        while heap and (bound is None or heap[0][0] < bound):
            out.append(heapq.heappop(heap)[2])
        for i, (last, number, table) in enumerate(heap):  # the rest keeps its last key, so the heap keeps its order
            ready = pc.sum(pc.less(table["key"], bound)).as_py()
            out.append(table.slice(0, ready))
            heap[i] = last, number, table.slice(ready)
        return out

    for first, *columns in pieces:
        if held > limit:
            ready = complete(first)
            size = sum(t.num_rows for t in ready)
            if size:
                yield combined(ready)
            held -= size
            limit = max(gather, 2 * held)
        table = _postings(*columns)
        heapq.heappush(heap, (columns[0][-1].as_py(), count, table))
        held += table.num_rows
        count += 1
    if heap:
        yield combined(complete(None))


def _arrived(batches: Iterator[pa.RecordBatch], skip: int = 0) -> Iterator[tuple]:
    """Pieces of batches whose columns are _READ behind `skip` others: the first key as text, the lists as Arrow arrays."""
    for batch in batches:
        lists = [batch.column(skip + k) for k in range(1, 6)]
        for i, first in enumerate(batch.column(skip).to_pylist()):
            yield first, *(c[i].values for c in lists)


def merge_runs(pieces: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """The pieces with at most `fan` runs left: `fan` runs of a shard are merged into one, in as many rounds as it takes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[tuple[tuple, tuple]]:
            for batch in batches:
                names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield from zip(names, _arrived(iter([batch]), 2))

        for (shard, run), group in groupby(ranges(), lambda r: r[0]):
            for table in merged(r[1] for r in group):
                coded = _column(table, "key").dictionary_encode()
                yield from _in_rows(pieces_of(table, run, np.full(len(coded.dictionary), shard), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary), 256)

    while (n := pieces.select("run").distinct().count()) > fan:
        names = cut(pieces.groupBy("run").agg(F.count("*").alias("n")).select("run", F.pmod(F.xxhash64("run"), F.lit(-(-n // (fan // 2)))).alias("next")), "names")
        grouped = pieces.join(bounded(names), "run").drop("run").withColumnRenamed("next", "run").select("shard", "run", *_READ)
        pieces = cut(grouped.repartition(parts, "shard", "run").sortWithinPartitions("shard", "run", "first").mapInArrow(merge, _PIECES), "runs")
    return pieces


def frequencies(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(lang, term, source, n, lang_n): occurrences of each term found in at least min_docs documents of its language, by source (above 0 only) and in the whole language."""
    spark = df.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = merge_runs(cut(runs(df, 8 * parts, text_col, lang_col, source_col, block_bytes), "runs"), parts, fan)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(_arrived(batches)):
            coded = _column(table, "key").dictionary_encode()
            codes, n = coded.indices.to_numpy(zero_copy_only=False), table["n"].to_numpy()
            begin = np.flatnonzero(np.diff(codes, prepend=-1))
            kept = np.add.reduceat(table["docs"].to_numpy(), begin) >= min_docs
            sizes = np.diff(np.append(begin, len(codes)))
            at = pa.array(np.flatnonzero(np.repeat(kept, sizes)))
            if not len(at):
                continue
            names = [k.rpartition("\0") for k in coded.dictionary.take(pa.array(np.flatnonzero(kept))).to_pylist()]
            times = sizes[kept]
            lang, term = (pa.array([x[k] for x in names]).take(pa.array(np.repeat(np.arange(len(names)), times))) for k in (0, 2))
            total = pa.array(np.repeat(np.add.reduceat(n, begin)[kept], times), pa.int64())
            rows = table.take(at)
            yield from _in_rows(pa.RecordBatch.from_arrays([lang, term, _column(rows, "source"), _column(rows, "n"), total], ["lang", "term", "source", "n", "lang_n"]), 8192)

    sorted_ = pieces.select("shard", *_READ).repartition(parts, "shard").drop("shard").sortWithinPartitions("first")
    return cut(sorted_.mapInArrow(merge, _COUNTS), "frequencies")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exactly; null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = wide(F.lit(SCALE)) * wide(n + PRIOR), wide(total + F.lit(PRIOR) * kept)
    return F.lit(1) + F.when(below > 0, F.call_function("div", above, below))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its `top` terms.

    Part `pair`: the divergences of all kept terms, summed. With the shares of terms that neither source has, that sum is known from the
    numbers of kept terms; each term that one of them has corrects it by the source's count alone, and each that both have by both counts.
    So only terms in both sources are joined, and their corrections are summed before they are shuffled. Part `term`: terms of which the source has more than its language.

    Null texts have no terms; null languages and sources are ''. Each row is a document, repeated ones too. A language without kept terms gives pairs of value 0.
    Other columns are not read. Empty table: no rows.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    counts = frequencies(df, text_col, lang_col, source_col, min_docs, block_bytes, fan)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = df.select(named(lang_col).alias("lang"), named(source_col).alias("source")).distinct().join(sums, ["lang", "source"], "left").join(bounded(cut(kept, "kept")), "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.select("lang", "source", zero("total"), zero("kept"), zero("lang_total"))
    groups = cut(groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0).cast("long"))), "groups")
    rows = cut(counts.join(bounded(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))), "shares")

    f = lambda p, q: divergence(F.col(p), F.col(q))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = groups.select("lang", "source", "p0", "kept").join(other, "lang").where("source <> item")
    base = F.when(F.col("kept") > 0, F.col("kept") * f("p0", "q0")).otherwise(0)
    # a source's terms by their count: its corrections against a source without them depend on nothing else
    alone = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")).join(bounded(cut(other, "other")), "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (f("p", "q0") - f("p0", "q0"))).alias("add"))
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "add")
    left = rows.select("lang", "term", "source", "p", "p0")
    right = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(f("p", "q") - f("p", "q0") - f("p0", "q") + f("p0", "q0")).alias("add"))
    shared = cut(shared, "shared")
    mirrored = shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "add")
    sums_ = both.select("lang", "source", "item", base.cast("long").alias("add")).unionByName(alone).unionByName(turned).unionByName(shared).unionByName(mirrored)
    pairs = sums_.groupBy("lang", "source", "item").agg(F.sum("add").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    terms = rows.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), f("p", "q").alias("value")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.select(*names))
