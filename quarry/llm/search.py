"""Ranked lexical search by norm buckets of impact vectors (LEMP): Cauchy-Schwarz and coordinate bounds prune, survivors are scored in integers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import small_batches, utf8
from quarry.plans.lineage import bounded, cut

#: Fixed by the contract: terms are runs of digits, letters a-z and all bytes of other characters.
_DELIMITERS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Fixed by the contract: scales of weights and impacts, and how much of a document's length counts (in percent).
WEIGHT, IMPACT, LENGTH = 1000, 1_000_000_000, 75
#: Share of the documents in the first round, those of the longest vectors, and the rows of a bucket.
FIRST, BUCKET = 1 / 32, 4096
#: Bounds are computed in doubles: they are widened by this much, so that none is too low.
SLACK = 1 + 1e-9


def terms_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) terms of a text."""
    return text.lower().translate(_DELIMITERS).split()


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """(id, {term: occurrences}) of the items, in blocks of about `most` terms; the driver holds one block at a time. Items without terms are left out."""
    block: list[tuple] = []
    held = 0
    for item, text in items.select(F.col(id_col), utf8(F.col(text_col))).toLocalIterator():
        counts: dict[bytes, int] = {}
        for w in terms_of(bytes(text)):
            counts[w] = counts.get(w, 0) + 1
        if counts:
            block.append((item, counts))
            held += len(counts)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def term_vectors(df: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of every row: number of all its terms, and occurrences of those in `terms`, by place there. Whole texts are read, in one scan."""
    spark = df.sparkSession
    small_batches(spark)
    place = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    @F.arrow_udf("struct<n:bigint,terms:array<int>,tfs:array<int>>")
    def of(texts: pa.Array) -> pa.Array:
        find, ns, at, tf, ends = place.value.get, [], [], [], [0]
        for text in texts:
            words = terms_of(text.as_py())
            found = np.fromiter((i for w in words if (i := find(w)) is not None), np.int32)
            which, times = np.unique(found, return_counts=True)
            ns.append(len(words))
            at.append(which)
            tf.append(times.astype(np.int32))
            ends.append(ends[-1] + len(which))
        flat = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int32), pa.int32()))
        return pa.StructArray.from_arrays([pa.array(ns, pa.int64()), flat(at), flat(tf)], names=["n", "terms", "tfs"])

    return df.select(F.col(id_col).alias("id"), of.asNondeterministic()(utf8(F.col(text_col))).alias("v")).select("id", "v.*")


def impacts(vectors: DataFrame) -> tuple[DataFrame, int, int, dict[int, int]]:
    """(id, norm, terms, impacts) of the documents with any of the terms, by falling norm, and N, L and the number of documents of each term.

    Ranges of the norm are the partitions, sorted, so a file of the written table holds one stretch of lengths, and a filter on the norm skips the others.
    """
    spark = vectors.sparkSession
    docs, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = dict(map(tuple, vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()))  # terms of one block at most
    m = F.lit(100 - LENGTH) + F.call_function("div", F.lit(LENGTH).cast("long") * F.col("n") * F.lit(docs).cast("long"), F.lit(max(length, 1)).cast("long"))
    long = lambda x: x.cast("long")
    impact = F.transform("tfs", lambda tf: F.call_function("div", F.lit(IMPACT).cast("long") * long(tf), long(tf) * 1000 + F.col("m") * 8))
    rows = vectors.where(F.size("terms") > 0).withColumn("m", m).select("id", "terms", impact.alias("impacts"))
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("norm", norm).withColumn("lot", F.xxhash64("id"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal lengths are dealt by hash, so that copies do not make one large stretch
    rows = rows.repartitionByRange(parts, F.col("norm").desc(), "lot").sortWithinPartitions(F.col("norm").desc(), "lot").drop("lot")
    return cut(rows, "impacts"), docs, length, found


#: A query: place in the block, terms by falling weight, weights, norm, norm of the weights behind each number of leading ones, and the score to reach.
Query = tuple[int, np.ndarray, np.ndarray, float, np.ndarray, int]


def queries_of(block: list[tuple], place: dict[bytes, int], docs: int, found: dict[int, int]) -> list[Query]:
    """The block's items as vectors of weight times occurrences; terms of weight 0 or without documents are left out."""
    out = []
    for k, (_, counts) in enumerate(block):
        weighted = [(place[t], math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * found[place[t]] + 1))) * n) for t, n in counts.items() if place[t] in found]
        weighted = sorted(((t, w) for t, w in weighted if w > 0), key=lambda x: (-x[1], x[0]))
        if weighted:
            terms, weights = np.array([t for t, _ in weighted], np.int32), np.array([w for _, w in weighted], np.int64)
            squares = np.concatenate([np.cumsum((weights[::-1].astype(float)) ** 2)[::-1], [0.0]])
            out.append((k, terms, weights, math.sqrt(squares[0]), np.sqrt(squares), 1))
    return out


def _focus(rest: np.ndarray, share: float = 0.3) -> int:
    """How many leading terms leave less than `share` of the query's norm behind them."""
    return int(np.argmax(rest <= share * rest[0]))


def bucket_best(norms: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: list[Query], least: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) of a bucket's vectors that reach the query's least score. Entries are (row, term, value).

    A query whose norm times the bucket's longest one stays below its score is skipped. Else its leading terms
    are summed for each row, and what the rest can add is bounded by the norms of what is left of both; the rows that
    may still reach the score are summed exactly.
    """
    order = np.argsort(terms, kind="stable")
    sorted_terms = terms[order]
    for k, q_terms, weights, norm, rest, _ in queries:
        goal = least[k]
        long_enough = norms * norm * SLACK >= goal
        if not long_enough.any():
            continue
        lead = _focus(rest)
        starts, ends = np.searchsorted(sorted_terms, q_terms, side="left"), np.searchsorted(sorted_terms, q_terms, side="right")

        def entries(a: int, b: int, starts=starts, ends=ends, weights=weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.concatenate([order[s:e] for s, e in zip(starts[a:b], ends[a:b])] or [np.empty(0, np.int64)])
            return rows[at], values[at], np.repeat(weights[a:b], (ends - starts)[a:b])

        row, value, weight = entries(0, lead)
        size = len(norms)
        partial = np.bincount(row, value.astype(float) * weight, size)
        left = np.sqrt(np.maximum(norms**2 * SLACK - np.bincount(row, value.astype(float) ** 2, size), 0.0))
        alive = long_enough & ((partial + rest[lead] * left) * SLACK >= goal)
        if not alive.any():
            continue
        row, value, weight = entries(0, len(q_terms))
        keep = alive[row]
        total = np.zeros(size, np.int64)
        np.add.at(total, row[keep], value[keep] * weight[keep])
        hit = np.flatnonzero(alive & (total >= goal))
        if len(hit):
            yield k, hit, total[hit]


def _search(vectors: DataFrame, queries: list[Query], top: int, id_type: str) -> DataFrame:
    """(query, id, score) of each task's best rows of vectors (norm, id, terms, impacts), `top` a query; a query's score to reach rises as a task goes on."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        least = {q[0]: q[5] for q in queries}
        held: dict[int, list[tuple]] = {}
        kind = None
        for batch in (b.slice(at, BUCKET) for b in batches for at in range(0, b.num_rows, BUCKET)):
            norms, ids = batch.column(0).to_numpy(), batch.column(1)
            kind = ids.type
            sizes = batch.column(2).value_lengths().to_numpy()
            rows = np.repeat(np.arange(len(norms)), sizes)
            for k, hit, scores in bucket_best(norms, rows, batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), queries, least):
                mine = held.get(k, []) + list(zip((-scores).tolist(), [i is None for i in ids.take(pa.array(hit)).to_pylist()], ids.take(pa.array(hit)).to_pylist()))
                mine.sort(key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))
                held[k] = mine[:top]
                if len(mine) >= top:
                    least[k] = max(least[k], -held[k][-1][0])
        if held:
            flat = [(k, i, -s) for k, mine in held.items() for s, _, i in mine]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], pa.int64())], ["query", "id", "score"])

    return vectors.select("norm", "id", "terms", "impacts").mapInArrow(best, f"query int, id {id_type}, score long")


def _top(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def rank(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10, block_terms: int = 200_000) -> DataFrame:
    """(item, rank, id, score): for each row of items its `top` best rows of df by score, above 0, equal scores by ascending id, null last.

    A score is the product of the item's vector (weights of terms times occurrences) with the document's impact vector. Impact vectors
    are ordered by length. The first round takes the longest of them, and its results are scores that each item has to reach; the second
    reads only the rest that is long enough for any item (a filter on the norm), and each bucket of it only for the items that it can serve.
    Items are searched in blocks of about block_terms terms, each a scan of df.

    Null texts have no terms; items without terms or hits give no rows. Each row of df and of items counts, repeated ones too. Other columns are not read. Empty tables: no rows.
    """
    spark = df.sparkSession
    id_type, item_type = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    parts = []
    for block in _blocks(items, item_col, item_text_col, block_terms):
        terms = sorted({t for _, counts in block for t in counts})
        vectors = cut(term_vectors(df, terms, id_col, text_col), "vectors")
        table, docs, _, found = impacts(vectors)
        queries = queries_of(block, {t: i for i, t in enumerate(terms)}, docs, found)
        if not queries:
            continue
        small_batches(spark, BUCKET)
        edge = table.agg(F.percentile_approx("norm", 1 - FIRST, 1000)).first()[0] or 0.0
        first = cut(_top(_search(table.where(F.col("norm") >= edge), queries, top, id_type), top).drop("rank"), "first")
        reached = {k: s for k, s, n in first.groupBy("query").agg(F.min("score"), F.count("*")).collect() if n >= top}
        queries = [(*q[:5], reached.get(q[0], 1)) for q in queries]
        least = min(q[5] / (q[3] * SLACK) for q in queries)
        rest = table.where((F.col("norm") < edge) & (F.col("norm") >= least))
        best = _top(first.unionByName(_search(rest, queries, top, id_type)), top)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], f"query int, item {item_type}")
        parts.append(cut(best.join(bounded(names), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score long")
    return reduce(DataFrame.unionByName, parts)
