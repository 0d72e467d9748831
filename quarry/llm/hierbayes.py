"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from quarry.llm.text import small_batches, utf8
from quarry.plans.lineage import bounded, cut

#: Feature buckets, and the bound of labelled rows that the document classifier is fitted on.
BUCKETS, SAMPLE_ROWS = 1 << 18, 20_000


def features(text: bytes) -> np.ndarray:
    """Sorted hashed features of a text: its distinct lower-cased words, their first four characters, trailing signs, and bands of case, signs and repetition."""
    words = text.split()
    if not words:
        return np.array([zlib.crc32(b"empty") % BUCKETS], np.int32)
    lower = [w.lower() for w in words]
    kinds = set(lower)
    stems = {w.decode("utf-8", "replace")[:4] for w in kinds}
    tails = {w[-1:] for w in kinds}
    capital = sum(w.isupper() for w in words) * 4 // len(words)
    signs = (len(text) - len(text.translate(None, b"#*$%&|<>!"))) * 8 // len(words)
    marks = [f"capital {capital}", f"signs {min(signs, 16)}", f"new {len(kinds) * 5 // len(words)}", f"length {len(words).bit_length()}"]
    keys = [b"w" + w for w in kinds] + [b"s" + s.encode() for s in stems] + [b"t" + t for t in tails] + [m.encode() for m in marks]
    return np.unique(np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) % BUCKETS).astype(np.int32)


def feature_list(text: Column) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return of(utf8(text))


def fit(at: np.ndarray, row: np.ndarray, labels: np.ndarray, steps: int = 150, ridge: float = 1e-4, least: int = 4, strange: float = 3.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by adaptive gradient steps over all rows; feature at[k] is in row row[k].

    Only features of at least `least` rows whose rows stray `strange` standard deviations
    from the share of positive rows take part, so a row's own rare words teach nothing.
    """
    rows = len(labels)
    share = min(max(labels.mean(), 1e-4), 1 - 1e-4)
    n, good = np.bincount(at, minlength=BUCKETS), np.bincount(at, labels[row], BUCKETS)
    odd = (n >= least) & (np.abs(good - n * share) >= strange * np.sqrt(n * share * (1 - share)))
    mine = odd[at]
    at, row = at[mine], row[mine]
    weights, bias = np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    past, past_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.bincount(row, weights[at], rows) - bias)) - labels) / rows
        grad = np.bincount(at, error[row], BUCKETS) + ridge * weights
        past += grad**2
        past_bias += error.sum() ** 2
        weights -= 0.3 * grad / np.sqrt(past)
        bias -= 0.1 * error.sum() / np.sqrt(past_bias)
    return weights, bias


def evidence(text: Column, models: list[tuple[np.ndarray, float]], spark) -> Column:
    """Array of logits, one for each model."""
    shared = spark.sparkContext.broadcast([(w.astype(np.float32), b) for w, b in models])

    @F.arrow_udf(ArrayType(DoubleType()))
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            f = features(t.as_py())
            out.append([float(w[f].sum() + b) for w, b in shared.value])
        return pa.array(out, pa.list_(pa.float64()))

    return of(utf8(text))


def known_labels(labels: DataFrame, id_col: str, targets: tuple[str, ...]) -> DataFrame:
    """(id, targets) of the documents with all labels; of repeated ones the larger counts."""
    known = labels.where(F.col(id_col).isNotNull()).where(" and ".join(f"{t} is not null" for t in targets))
    return cut(known.groupBy(F.col(id_col).alias("id")).agg(*[F.max(t).alias(t) for t in targets]), "labels")


def learn(df: DataFrame, known: DataFrame, id_col: str, text_col: str, targets: tuple[str, ...]) -> list[tuple[np.ndarray, float]]:
    """One model for each target column (0 or 1) of known, fitted on at most SAMPLE_ROWS labelled rows, those of least hash."""
    lot = F.xxhash64("id", F.lit(3))
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(known.count(), 1))
    chosen = known.where(F.pmod(lot, F.lit(1 << 20)) < int((1 << 20) * share)).orderBy(F.pmod(lot, F.lit(1 << 20)), "id").limit(SAMPLE_ROWS)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(bounded(cut(chosen, "chosen")), "id").select("id", feature_list(F.col("text")).alias("f"), *targets)
    table = cut(rows, "sample").orderBy(lot, F.xxhash64("f")).limit(SAMPLE_ROWS).toArrow()
    if not len(table):
        return [(np.zeros(BUCKETS), 0.0) for _ in targets]
    lists = table["f"].combine_chunks()
    at = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(table), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    return [fit(at, row, table[t].to_numpy().astype(float)) for t in targets]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _shrink(sites: DataFrame, prior: Column, weight: str = "n") -> float:
    """Strength (in documents) of the prior of a level, by moments: how far site means stray beyond what their sizes explain."""
    rate = F.col("good") / F.col(weight)
    spread, noise, base = sites.where(f"{weight} > 1").agg(F.sum(F.col(weight) * F.pow(rate - prior, F.lit(2.0))) / F.sum(weight), F.count("*") / F.sum(weight), F.sum(F.col(weight) * prior * (1 - prior)) / F.sum(weight)).first()
    if not spread or not base:
        return 1000.0
    between = max(spread - base * noise, 1e-9)
    return float(min(max(base / between - 1, 1.0), 1000.0))


def sites(rows: DataFrame, col: str) -> tuple[DataFrame, float, float, float]:
    """Sums of each path (host, path, n, good, host_n, host_good) of rows (host, path, `col`: 0 to 1), the overall rate, and the prior strengths of hosts and paths.

    A host's mean is drawn towards the overall one, a path's towards its host's, so a
    sparse site follows its parent. Sums by path come first; those by host and in all are made from them.
    """
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(col).alias("good")), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (good or 0.0) / n if n else 0.5
    strong = _shrink(hosts, F.lit(overall))
    mine = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    found = cut(paths.join(bounded(mine), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    return found, overall, strong, _shrink(found, (F.col("host_good") + strong * overall) / (F.col("host_n") + strong))


def _rates(overall: float, host_strength: float, path_strength: float, own: Column) -> tuple[Column, Column]:
    """(host rate, path rate) for a document whose own value is left out, so that its evidence does not count twice."""
    host = (F.col("host_good") - own + host_strength * overall) / (F.col("host_n") - 1 + host_strength)
    return host, (F.col("good") - own + path_strength * host) / (F.col("n") - 1 + path_strength)


def classify(df: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, quality_doc, host_quality, path_quality, quality, toxic, kept) for every row of df.

    quality_doc is the document classifier's probability, host_quality and path_quality the shrunk site
    rates, quality the posterior from the document's evidence under its path's rate;
    toxic likewise. kept: quality at least 0.5 and toxic below 0.5. Site sums cover all rows: labels where there are
    any, else the classifier's probability; a document's own part is left out of the rates that it is judged by.

    Null text is empty. Null hosts and paths are sites of their own. Labels with nulls are not learned from; of repeated labels the larger counts.
    Without labels everything is 0.5 and kept is false. Repeated rows come back each. Empty table: no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    targets = ("quality", "toxic")
    known = known_labels(labels, id_col, targets)
    models = learn(df, known, id_col, text_col, targets)
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), evidence(F.col(text_col), models, spark).alias("z"))
    rows = cut(rows, "evidence")
    rows = rows.join(bounded(known), "id", "left").select("id", "host", "path", "z", *[F.col(t).alias(f"{t}_label") for t in targets])
    for i, t in enumerate(targets):
        rows = rows.withColumn(f"{t}_doc", 1 / (1 + F.exp(-F.get("z", F.lit(i)))))
        rows = rows.withColumn(f"{t}_own", F.coalesce(F.col(f"{t}_label").cast("double"), F.col(f"{t}_doc")))
    rows = cut(rows, "values")
    for t in targets:
        found, overall, host_strength, path_strength = sites(rows, f"{t}_own")
        rows = rows.join(bounded(found.withColumnsRenamed({"host": "h", "path": "p"})), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        host_rate, path_rate = _rates(overall, host_strength, path_strength, F.col(f"{t}_own"))
        rows = rows.withColumns({f"host_{t}": host_rate, f"path_{t}": path_rate})
        logit = _logit(F.col(f"{t}_doc")) + _logit(F.col(f"path_{t}")) - _logit(F.lit(overall))
        rows = rows.withColumn(t, 1 / (1 + F.exp(-logit))).drop("h", "p", "n", "good", "host_n", "host_good")
    kept = (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)
    return rows.select(F.col("id").alias(id_col), "quality_doc", "host_quality", "path_quality", "quality", "toxic", kept.alias("kept"))
