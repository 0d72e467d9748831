"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm.text import small_batches
from quarry.plans.lineage import bounded, cut

#: Hash functions of a filter, cells for each n-gram, and the largest filter (cells): 128 MB for 64 languages, the bound of what is broadcast.
HASHES, CELLS_PER_GRAM, MOST_CELLS = 3, 12, 1 << 24
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def trigrams(text: str | None) -> np.ndarray:
    """Letter trigrams of a lower-cased text as uint64 (21 bits a code point); runs of other characters are one space, also at both ends. Empty without letters."""
    if not text:
        return np.empty(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = np.r_[True, letter[1:] | letter[:-1]]
    code = np.r_[np.uint64(32), code[keep], np.uint64(32)]
    code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]
    return (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]


def cells_of(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cell numbers of n-grams, one array for each hash function."""
    out = []
    for m in _MULTIPLIERS[:HASHES]:
        x = (grams ^ (grams >> np.uint64(31))) * np.uint64(m)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_MULTIPLIERS[0])
        out.append((x >> np.uint64(64 - bits)).astype(np.int64))
    return out


def gram_counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): documents of each language with each trigram. Tasks add up what they see, at most `flush` n-grams at a time."""
    flush = 500_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, int]] = {}

        def rows() -> pa.RecordBatch:
            langs = [k for k, v in seen.items() for _ in v]
            grams = [g for v in seen.values() for g in v]
            n = [c for v in seen.values() for c in v.values()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(np.unique(trigrams(text)))
            for lang, grams in by.items():
                mine = seen.setdefault(lang, {})
                values, counts = np.unique(np.concatenate(grams), return_counts=True)
                for g, c in zip(values.astype(np.int64).tolist(), counts.tolist()):
                    mine[g] = mine.get(g, 0) + c
            if sum(map(len, seen.values())) > flush:
                yield rows()
        yield rows()

    found = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Languages and their bit-sliced Bloom filter: row c of `cells` has bit l of its word l // 64 set if language l set cell c."""

    def __init__(self, langs: list[str], bits: int, cells: np.ndarray, false: np.ndarray | None = None):
        self.langs, self.bits, self.cells = langs, bits, cells
        #: Chance that an n-gram that a language does not have looks as if it had. It takes a pass over all cells, once.
        self.false = false if false is not None else np.array([self._has(cells, i).mean() ** HASHES for i in range(len(langs))])

    @staticmethod
    def _has(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language has: its popcount, corrected for false positives."""
        first, *rest = cells_of(grams, self.bits)
        masks = self.cells[first]
        for c in rest:
            masks = masks & self.cells[c]
        hits = np.array([self._has(masks, i).sum() for i in range(len(self.langs))], float)
        return np.clip((hits / len(grams) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 0.02) -> Filter | None:
    """Filter of the trigrams found in at least `share` of a language's documents (two or more, if it has more than one).

    Counts are taken over all training rows. The filter's cells are made by Spark; at
    most MOST_CELLS reach the driver. None if nothing can be learned.
    """
    spark = train.sparkSession
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = cut(gram_counts(train, text_col, lang_col), "grams")
    sizes = cut(train.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("docs")), "sizes")
    least = F.greatest(F.ceil(F.col("docs") * share), F.least(F.col("docs"), F.lit(2)))
    common = counts.join(bounded(sizes), F.col("lang") == F.col("l")).where(F.col("n") >= least).select("lang", "gram")
    common = cut(common, "common")
    langs = [r[0] for r in common.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    bits = min(MOST_CELLS.bit_length() - 1, max(10, int(common.count() * CELLS_PER_GRAM).bit_length()))
    number = spark.createDataFrame(list(enumerate(langs)), "at long, l string")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            at = batch.column(1).to_numpy(zero_copy_only=False)
            for c in cells_of(grams, bits):
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at // 64), pa.array(np.left_shift(np.uint64(1), (at % 64).astype(np.uint64)).astype(np.int64))], ["cell", "word", "mask"])

    placed = common.join(bounded(number), F.col("lang") == F.col("l")).select("gram", "at").mapInArrow(place, "cell long, word long, mask long")
    table = placed.groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    cells = np.zeros((1 << bits, (len(langs) + 63) // 64), np.uint64)
    cells[table["cell"].to_numpy(), table["word"].to_numpy()] = table["mask"].to_numpy().astype(np.uint64)
    return Filter(langs, bits, cells)


def predict(text: Column, found: Filter | None, spark) -> Column:
    """Struct (lang, score): the language with the highest corrected share, ties to the first by name; its part of all shares.

    Null, or no letters, or nothing learned: `und`, 0. Letters but no known n-gram: the first language, 0.
    """
    known = spark.sparkContext.broadcast(found and (found.langs, found.bits, found.cells, found.false))

    @F.arrow_udf(StructType([StructField("lang", StringType()), StructField("score", DoubleType())]))
    def of(texts: pa.Array) -> pa.Array:
        f, names, scores = known.value and Filter(*known.value), [], []
        for t in texts:
            grams = trigrams(t.as_py())
            if f is None or not len(grams):
                names.append("und")
                scores.append(0.0)
                continue
            s = f.shares(grams)
            best = int(s.argmax())
            names.append(f.langs[best])
            scores.append(float(s[best] / s.sum()) if s.sum() else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return of(text)


def held_out(id_: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of df; learns from the rows that are not held out.

    Repeated rows come back each (and count each in training). Rows without a language are not learned from. Empty table: no rows.
    """
    small_batches(df.sparkSession)
    found = learn(df.where(~held_out(F.col(id_col))), text_col, lang_col)
    guess = predict(F.col(text_col), found, df.sparkSession)
    rows = df.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), guess.alias("g"))
    return rows.select(id_col, "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))
