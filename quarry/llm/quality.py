"""Quality rules: base limits and robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quarry.llm.text import small_batches, utf8
from quarry.plans.lineage import bounded, cut

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Standard deviation that is added to each coordinate's own. It is far below theirs, and only lets a matrix of fewer rows than coordinates, or of equal ones, be inverted.
FLOOR = 1e-3
#: Share of the rows in the core; concentration steps end once no determinant's logarithm moves by more than SETTLED, MOST_STEPS at the latest.
HALF, SETTLED, MOST_STEPS = 0.5, 1e-2, 40
#: Rows of a language's estimate that count in that of one of its cells, and the most that the cell's own counts: many near copies may leave it hardly any spread.
PRIOR, OWN = 100, 0.75
#: Chance that a document of a normal population is rejected.
LEVEL = 1e-9


def chi_squared(x: float, degrees: int) -> float:
    """Share of a chi-squared distribution of an odd number of degrees at or below x."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, degrees, 2):
        total -= term
        term *= x / (k + 2)
    return total


def chi_quantile(share: float, degrees: int, above: bool = False) -> float:
    """The x up to which (above: beyond which) that share lies."""
    low, high = 0.0, 200.0
    for _ in range(200):
        x = (low + high) / 2
        at = chi_squared(x, degrees)
        low, high = (x, high) if (1 - at > share if above else at < share) else (low, x)
    return x


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """STATS of one text's bytes."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, b"#*$%&|<>")), 0, 0
    chars = sum(map(len, words)) - (len(text) - len(text.decode("utf-8", "replace")))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        _, two = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
        _, where, counts = np.unique(two[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
        hit = counts[where] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= hit
        repeat = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def stats(text: Column) -> Column:
    """Struct of STATS (long) of a text; null has no words."""

    @F.arrow_udf(StructType([StructField(c, LongType()) for c in STATS]))
    def of(texts: pa.Array) -> pa.Array:
        rows = [text_stats(t.as_py()) for t in texts]
        cols = list(zip(*rows)) or [[]] * len(STATS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=STATS)

    # a filter on the statistics would otherwise be pushed below them, with a second pass over the texts
    return of.asNondeterministic()(utf8(text))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def vector(digest: Column) -> Column:
    """The transformed statistics, near-normal for prose.

    Counts are whole numbers, and most documents have the same, none, of several of them. A fraction is added to each, uniform from 0 to 1 and drawn from
    the text's digest, so that a statistic spreads by its own resolution at least, and no estimate of spread is zero. A repeated window has some six words, so these are counted by six.
    """
    part = lambda k: F.pmod(F.shiftrightunsigned(digest, 12 * k), F.lit(1 << 12)) / (1 << 12)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    of = lambda count, k: F.sqrt((count + part(k)) / n)
    return F.array(F.log(n + part(0)), F.log((F.greatest(F.col("word_chars"), F.lit(1)) + part(1)) / n), of(F.col("n_symbols"), 2), of(F.col("n_dup_lines"), 3), of(F.col("n_repeat_words") / 6, 4))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from mean under the row-major precision matrix."""
    d = len(STATS)
    diff = [F.get("x", F.lit(i)) - F.get("mean", F.lit(i)) for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + diff[i] * diff[j] * F.get("precision", F.lit(i * d + j)) * (1 if i == j else 2)
    return total


_ESTIMATE = StructType([StructField("mean", ArrayType(DoubleType())), StructField("cov", ArrayType(DoubleType())), StructField("precision", ArrayType(DoubleType())), StructField("det", DoubleType())])
_ESTIMATES = pa.struct([("mean", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64())), ("det", pa.float64())])


def consistency(half: float, d: int) -> float:
    """What the scatter of the nearest `half` of normal rows is multiplied with to be that of all."""
    return half / chi_squared(chi_quantile(half, d), d + 2)


def _matrices(n: Column, sums: Column, products: Column, factor: float) -> Column:
    """Struct (mean, cov, precision, det) from a group's sums: cov is the scatter times `factor`, plus FLOOR squared; det its determinant's logarithm."""
    d = len(STATS)

    @F.arrow_udf(_ESTIMATE)
    def of(count: pa.Array, s: pa.Array, p: pa.Array) -> pa.Array:
        out = []
        for c, a, b in zip(count.to_pylist(), s.to_pylist(), p.to_pylist()):
            mean = np.array(a) / c
            cov = np.zeros((d, d))
            cov[np.triu_indices(d)] = np.array(b) / c
            cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
            cov = factor * cov + FLOOR**2 * np.eye(d)
            out.append({"mean": mean.tolist(), "cov": cov.ravel().tolist(), "precision": np.linalg.inv(cov).ravel().tolist(), "det": float(np.linalg.slogdet(cov)[1])})
        return pa.array(out, _ESTIMATES)

    return of(n, sums, products)


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, mean, cov, precision, det) from rows (keys, x): grouped sums only."""
    d = len(STATS)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = F.array(*[F.sum(v) for v in x])
    products = F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)])
    sums_ = rows.groupBy(*keys).agg(F.count("*").alias("n"), sums.alias("s"), products.alias("p"))
    return sums_.withColumn("e", _matrices(F.col("n"), F.col("s"), F.col("p"), factor)).select(*keys, "e.*")


def _starts(keyed: DataFrame) -> DataFrame:
    """(group, start, mean, precision): three starts that withstand outliers in nearly half of a group, about its coordinate medians.

    Scatters of the rows scaled by their median deviations: diagonal, of their directions (spatial signs), and of their hyperbolic tangents.
    """
    d = len(STATS)
    middle = lambda x: F.percentile_approx(x, 0.5, 1000)
    medians = cut(keyed.groupBy("group").agg(F.array(*[middle(F.get("x", F.lit(i))) for i in range(d)]).alias("mean")), "medians")
    off = [middle(F.abs(F.get("x", F.lit(i)) - F.get("mean", F.lit(i)))) for i in range(d)]
    scale = F.array(*[F.sqrt(F.pow(m * 1.4826, F.lit(2.0)) + FLOOR**2) for m in off])
    scales = cut(keyed.join(bounded(medians), "group").groupBy("group").agg(F.first("mean").alias("mean"), scale.alias("scale")), "scales")
    z = F.transform("x", lambda v, i: (v - F.get("mean", i)) / F.get("scale", i))
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    kinds = F.array(F.transform("z", lambda v: v * 0), F.transform("z", lambda v: v / F.greatest(length, F.lit(1e-9)) * math.sqrt(d)), F.transform("z", F.tanh))
    rows = keyed.join(bounded(scales), "group").select("group", z.alias("z")).select("group", F.posexplode(kinds).alias("start", "x"))
    shapes = _moments(rows, ["group", "start"], 1.0)

    @F.arrow_udf(ArrayType(DoubleType()))
    def precision(cov: pa.Array, scale: pa.Array, start: pa.Array) -> pa.Array:
        out = []
        for c, s, k in zip(cov.to_pylist(), scale.to_pylist(), start.to_pylist()):
            shape = np.eye(d) if k == 0 else np.array(c).reshape(d, d) - FLOOR**2 * np.eye(d) + 0.01 * np.eye(d)
            out.append(np.linalg.inv(np.outer(s, s) * shape).ravel().tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return shapes.select("group", "start", "cov").join(bounded(scales), "group").select("group", "start", "mean", precision(F.col("cov"), F.col("scale"), F.col("start")).alias("precision"))


def mcd(keyed: DataFrame, half: float = HALF) -> DataFrame:
    """(group, mean, cov) by minimum covariance determinant over all rows (group, x).

    From each of three starts, a step keeps the `half` of a group's rows nearest by Mahalanobis
    distance and estimates anew, which never raises the determinant; after two steps the start with the least
    determinant goes on alone, until the determinants stay. Every step is a grouped sum and a mergeable quantile
    sketch, so no group is brought together. The scatter is made consistent with the normal distribution.
    """
    factor = consistency(half, len(STATS))
    now = cut(_starts(keyed), "starts")
    for k in range(MOST_STEPS):
        if k == 2:
            now = cut(now.groupBy("group").agg(F.min_by(F.struct("start", "mean", "precision", "cov", "det"), "det").alias("e")).select("group", "e.*"), "best")
        far = keyed.join(bounded(now.select("group", "start", "mean", "precision")), "group").select("group", "start", "x", _distance().alias("d2"))
        limit = cut(far.groupBy("group", "start").agg(F.percentile_approx("d2", half, 10000).alias("most")), "limit")
        last, now = now, cut(_moments(far.join(bounded(limit), ["group", "start"]).where("d2 <= most"), ["group", "start"], factor), "estimate")
        if k >= 2:
            before = last.select("group", F.col("det").alias("before"))
            moved = now.join(bounded(before), "group").agg(F.max(F.abs(F.col("det") - F.col("before")))).first()[0]
            if moved is None or moved <= SETTLED:
                break
    return now.groupBy("group").agg(F.min_by(F.struct("mean", "cov"), "det").alias("e")).select("group", "e.*")


def _shrunk(levels: list[tuple[Column, Column, Column]]) -> Column:
    """Struct (mean, precision) of (n, mean, cov) from all rows down to a cell: each level counts with weight n against PRIOR rows of the one above, OWN at most."""
    d = len(STATS)

    @F.arrow_udf(StructType([StructField("mean", ArrayType(DoubleType())), StructField("precision", ArrayType(DoubleType()))]))
    def of(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            mean, cov = np.array(row[1]), np.array(row[2]).reshape(d, d)
            for k in range(3, len(row), 3):
                w = min(row[k] / (row[k] + PRIOR), OWN)
                m, c = np.array(row[k + 1]), np.array(row[k + 2]).reshape(d, d)
                cov = w * c + (1 - w) * cov + w * (1 - w) * np.outer(m - mean, m - mean)
                mean = w * m + (1 - w) * mean
            out.append({"mean": mean.tolist(), "precision": np.linalg.inv(cov).ravel().tolist()})
        return pa.array(out, pa.struct([("mean", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64()))]))

    return of(*[c for level in levels for c in level])


def estimate(passing: DataFrame, half: float = HALF, level: float = LEVEL) -> DataFrame:
    """(lang, source, mean, precision, most) from the passing rows (lang, source, x): robust estimates of each cell of language and source.

    Equal vectors of a cell are those of copies, and count once.
    Estimates are made of cells, languages and all rows; a cell's is drawn towards its language's, and that towards the one of all, the more the fewer rows it has.
    most: the squared distance beyond which a row is an outlier. It is the chi-squared quantile of `level`; where
    a language's own median distance is larger than the chi-squared one, it is larger in proportion.
    """
    d = len(STATS)
    passing = cut(passing.select("lang", "source", "x").distinct(), "passing")
    names = [F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("all")]
    keyed = cut(passing.select(F.explode(F.array(*names)).alias("group"), "x"), "vectors")
    found = cut(mcd(keyed, half).join(bounded(cut(keyed.groupBy("group").agg(F.count("*").alias("n")), "sizes")), "group"), "mcd")
    cells = passing.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    parts = []
    for k, name in enumerate(reversed(names)):
        mine = found.select(F.col("group").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("mean").alias(f"m{k}"), F.col("cov").alias(f"c{k}"))
        cells = cells.join(bounded(mine), name == F.col(f"g{k}"))
        parts.append((F.col(f"n{k}"), F.col(f"m{k}"), F.col(f"c{k}")))
    cells = cut(cells.select("lang", "source", _shrunk(parts).alias("e")).select("lang", "source", "e.*"), "cells")
    lang, source = F.col("lang").alias("__lang"), F.col("source").alias("__source")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    far = passing.select("lang", "source", "x").join(bounded(cells.select(lang, source, "mean", "precision")), same)
    spread = cut(far.groupBy("lang").agg(F.percentile_approx(_distance(), 0.5, 1000).alias("middle")), "spread")
    most = chi_quantile(level, d, above=True) * F.greatest(F.lit(1.0), F.col("middle") / chi_quantile(0.5, d))
    return cut(cells.join(bounded(spread.withColumnRenamed("lang", "__lang")), F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", "source", "mean", "precision", most.alias("most")), "estimates")


def judged(df: DataFrame, estimates: DataFrame) -> DataFrame:
    """df (lang, source, STATS, x and others) with base_failed, d2 and kept added; a row of no estimated cell is kept unless it fails the base."""
    e = estimates.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "mean", "precision", "most")
    out = df.join(bounded(e), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("d2", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("most"), F.lit(True))).drop("__lang", "__source", "mean", "precision", "most")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, STATS, base_failed, d2, kept) for every row of df, over whole texts.

    Null text: no words, fails the base. Null language or source: a cell like others. Repeated rows come back each.
    Other columns are not read. Empty table: no rows.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("digest"), stats(F.col(text_col)).alias("s"))
    rows = cut(rows.select("id", "lang", "source", "digest", "s.*").withColumn("x", vector(F.col("digest"))).drop("digest"), "stats")
    return judged(rows, estimate(rows.where(~base_failed()))).drop("lang", "source", "x").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that quality() keeps, with its columns. Texts are read twice rather than shuffled: the estimates are a small lookup."""
    small_batches(df.sparkSession)
    named = [F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("digest"), stats(F.col(text_col)).alias("s")]
    rows = df.select(*named).select("lang", "source", "digest", "s.*")
    rows = cut(rows.where(~base_failed()).select("lang", "source", vector(F.col("digest")).alias("x")), "stats")
    columns = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    again = df.select(columns, *named).select("row", "lang", "source", "digest", "s.*").withColumn("x", vector(F.col("digest")))
    return judged(again, estimate(rows)).where("kept").select("row.*")
