"""Profiles, statistics and scores of the rows table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, ShortType

from quarry.functions.features import row_tokens
from quarry.plans.lineage import cut, lookup, running_sum


def profile(rows: DataFrame) -> DataFrame:
    """(fmt, n, total, share, place): live rows by format, most frequent first, ties in order of first row."""
    counts = rows.where("not deleted").groupBy("fmt").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    total = F.sum("n").over(Window.partitionBy())  # a dozen formats
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "first"))
    return counts.select("fmt", "n", total.alias("total"), (F.col("n") / total).alias("share"), place.alias("place"))


def key_counts(rows: DataFrame) -> DataFrame:
    """(key, n): live rows with each top-level key."""
    return rows.where("not deleted").select(F.explode("top_keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


#: Shares whose percentiles a summary gives.
SHARES = (0.5, 0.9, 0.99)
#: Size of the quantile sketches (2 ** 10 items; ranks are off by some 0.3 %), half the share of a bracket around a percentile, and values of a bracket that are counted one by one.
SKETCH, MARGIN, FEW = 1024, 0.006, 20_000
#: Steps of the ranks that a sketch is asked for (Spark takes fixed ranks only).
GRID = 256


def summarize(values: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, sum, p50, p90, p99 of a column, for each group of `by`. Nulls are left out; no values: zeros.

    A percentile p is the value at place floor(p n) of the sorted values, the last at most, and exact. The column is written once. Mergeable
    quantile sketches propose two values around each percentile, and the next pass counts what lies below, on, between and above them: that decides for
    sure in which of these five zones the percentile is, and sketches each zone for the pass after. A zone of FEW values at most is counted
    value by value. So nothing is sorted, and what is shuffled (sketches and at most FEW counts a group) does not grow with the values.
    Types other than whole numbers and doubles go through counts of all distinct values.
    """
    by = by or []
    kind = values.schema[col].dataType
    given = values.where(F.col(col).isNotNull())
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        wide, sketch, quantile, held_by = "long", F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint, F.kll_sketch_get_n_bigint
    elif isinstance(kind, DoubleType):
        wide, sketch, quantile, held_by = "double", F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double, F.kll_sketch_get_n_double
    else:
        return summarize_counts(given.groupBy(*by, F.col(col).alias("x")).agg(F.count("*").alias("c")), by)
    # groups by a struct, as nulls in a struct are equal in joins
    rows = cut(given.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(col).cast(wide).alias("x")), "values")
    x = F.col("x")
    totals = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"), sketch("x", SKETCH).alias("sketch")), "totals")
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).alias("k")) for i, p in enumerate(SHARES)])
    none = F.lit(None).cast(wide)
    # lo and hi: the open interval that holds the percentile (null: no bound), n values in it, the percentile at place k of them
    state = totals.select("g", "n", "sketch", F.explode(places).alias("p")).select("g", "p.i", "p.k", "n", none.alias("lo"), none.alias("hi"), none.alias("value"), "sketch")
    state = cut(state, "brackets")
    inside = lambda b: (b["lo"].isNull() | (x > b["lo"])) & (b["hi"].isNull() | (x < b["hi"]))

    def placed(rows: DataFrame, state: DataFrame, *more: str) -> DataFrame:
        """(g, x): values that any bracket of their group holds; or (g, x, b), with each of these brackets and more of its columns."""
        open_ = cut(state.groupBy("g").agg(F.collect_list(F.struct("i", "lo", "hi", *more)).alias("bs")), "open")
        met = lookup(rows, open_, "g").select("g", "x", F.filter("bs", inside).alias("bs")).where(F.size("bs") > 0)
        return met.select("g", "x", F.explode("bs").alias("b")) if more else met.select("g", "x")

    while state.where(F.col("value").isNull() & (F.col("n") > FEW)).limit(1).count():
        wide_ones = state.where(F.col("value").isNull() & (F.col("n") > FEW))
        grid = F.when(held_by("sketch") > 0, quantile("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
        at = lambda place: F.get("grid", F.least(F.greatest(place, F.lit(0)), F.lit(GRID)).cast("int"))
        share = (F.col("k") + 0.5) / F.col("n")
        # NaN, the last of all doubles, is in no sketch
        proposed = [F.coalesce(at(p), F.lit(float("nan")).cast(wide)) for p in (F.floor((share - MARGIN) * GRID), F.ceil((share + MARGIN) * GRID))]
        wide_ones = wide_ones.withColumn("grid", grid)
        wide_ones = cut(wide_ones.select("g", "i", "k", "n", "lo", "hi", proposed[0].alias("q"), proposed[1].alias("r")), "proposed")
        held = placed(rows, wide_ones, "q", "r")
        zone = F.when(x < F.col("b.q"), 0).when(x == F.col("b.q"), 1).when(x < F.col("b.r"), 2).when(x == F.col("b.r"), 3).otherwise(4)
        zones = held.groupBy("g", F.col("b.i").alias("i"), zone.alias("zone")).agg(F.count("*").alias("n"), sketch("x", SKETCH).alias("sketch"))
        zones = zones.groupBy("g", "i").agg(F.map_from_entries(F.collect_list(F.struct("zone", F.struct("n", "sketch")))).alias("z"))
        zones = zones.select(F.col("g").alias("zg"), F.col("i").alias("zi"), "z")
        n_of = lambda z: F.coalesce(F.col("z")[z]["n"], F.lit(0))
        upto = [sum((n_of(z) for z in range(1, e + 1)), n_of(0)) for e in range(5)]
        hit = F.lit(4)
        for z in (3, 2, 1, 0):
            hit = F.when(F.col("k") < upto[z], z).otherwise(hit)
        left = F.when(F.col("hit") == 0, F.lit(0)).otherwise(F.coalesce(*[F.when(F.col("hit") == z, upto[z - 1]) for z in (1, 2, 3, 4)]))
        found = wide_ones.join(zones, (F.col("g") == F.col("zg")) & (F.col("i") == F.col("zi"))).withColumn("hit", hit)
        found = found.select(
            "g", "i", (F.col("k") - left).alias("k"), F.col("z")[F.col("hit")]["n"].alias("n"),
            F.when(F.col("hit") == 2, F.col("q")).when(F.col("hit") == 4, F.col("r")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("hit") == 0, F.col("q")).when(F.col("hit") == 2, F.col("r")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("hit") == 1, F.col("q")).when(F.col("hit") == 3, F.col("r")).alias("value"),
            F.col("z")[F.col("hit")]["sketch"].alias("sketch"),
        )
        state = cut(found.unionByName(state.where(F.col("value").isNotNull() | (F.col("n") <= FEW))), "brackets")
        # only values of brackets that are still open are read again
        rows = cut(placed(rows, state.where("value is null")), "left")
    counted = placed(rows, state.where("value is null"), "k").groupBy("g", F.col("b.i").alias("i"), F.col("b.k").alias("k"), "x").agg(F.count("*").alias("c"))
    cum = F.sum("c").over(Window.partitionBy("g", "i").orderBy("x"))  # FEW rows at most
    few = counted.select("g", "i", "k", "x", cum.alias("cum")).where("cum > k").groupBy("g", "i").agg(F.min("x").alias("value"))
    names = [f"p{round(p * 100)}" for p in SHARES]
    picked = state.where("value is not null").select("g", "i", "value").unionByName(few).groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).cast(kind).alias(n) for i, n in enumerate(names)])
    out = totals.join(picked, "g").select(
        *[F.col("g")[c].alias(c) for c in by], F.col("n").alias("count"), F.col("min").cast(kind).alias("min"), F.col("max").cast(kind).alias("max"), (F.col("sum") / F.col("n")).alias("mean"), "sum", *names
    )
    return out if by else out.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in out.columns])


def summarize_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from counts of distinct values (columns x and c)."""
    by = by or []
    steps = running_sum(counts, by, "x", "c")
    at = lambda p: F.min(F.when(F.col("cum") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col("x")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return steps.groupBy(*by).agg(
        zero(F.sum("c")).alias("count"),
        zero(F.min("x")).alias("min"),
        zero(F.max("x")).alias("max"),
        F.coalesce(F.sum(F.col("x") * F.col("c")) / F.sum("c"), F.lit(0.0)).alias("mean"),
        zero(F.sum(F.col("x") * F.col("c"))).alias("sum"),
        zero(at(0.5)).alias("p50"),
        zero(at(0.9)).alias("p90"),
        zero(at(0.99)).alias("p99"),
    )


def bucketize(values: DataFrame, col: str, k: int) -> DataFrame:
    """(bucket, lo, hi, count): k buckets of equal width over the values' range, half-open, the last closed; one if all are equal, none without values."""
    x = values.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    range_ = x.agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least is not null")
    width = (F.col("most") - F.col("least")) / k
    edge = lambda i: F.col("least") + width * i
    grid = range_.select("least", "most", F.explode(F.sequence(F.lit(0), F.when(F.col("least") == F.col("most"), 0).otherwise(k - 1))).alias("bucket"))
    last = (F.col("bucket") == k - 1) | (F.col("least") == F.col("most"))
    grid = grid.select("bucket", edge(F.col("bucket")).alias("lo"), F.when(last, F.col("most")).otherwise(edge(F.col("bucket") + 1)).alias("hi"), last.alias("last"))
    # one pass over the values: each goes to the bucket whose bounds hold it, by the same arithmetic
    guess = x.join(F.broadcast(range_)).select("x", "least", "most", F.when(F.col("least") == F.col("most"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("least")) / width), F.lit(k - 1))).cast("int").alias("g"))
    low, high = edge(F.col("g")), edge(F.col("g") + 1)
    exact = F.when(F.col("x") < low, F.col("g") - 1).when((F.col("x") >= high) & (F.col("g") < k - 1) & (F.col("least") < F.col("most")), F.col("g") + 1).otherwise(F.col("g"))
    counts = guess.groupBy(exact.alias("g")).agg(F.count("*").alias("count"))
    return grid.join(F.broadcast(counts), grid.bucket == counts.g, "left").select("bucket", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))


def role_counts(rows: DataFrame) -> DataFrame:
    """(role, n): turns of live rows by role."""
    return rows.where("not deleted and not error").select(F.explode("turns.role").alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def stats(rows: DataFrame) -> dict[str, DataFrame]:
    """Statistics of live rows: overview (n, parse_err, chat_rows), tokens and turns summaries, token and turn histograms, role counts."""
    live = rows.where("not deleted").select("row_id", "error", F.size("turns").alias("turns_n"), row_tokens().alias("row_tokens"))
    turns = live.where("not error and turns_n > 0")
    return {
        "overview": live.agg(F.count("*").alias("n"), F.count_if("error").alias("parse_err"), F.count_if(~F.col("error") & (F.col("turns_n") > 0)).alias("chat_rows")),
        "tokens": summarize(live, "row_tokens"),
        "turns": summarize(turns, "turns_n"),
        "token_buckets": bucketize(live, "row_tokens", 10),
        "turn_buckets": bucketize(turns, "turns_n", 8),
        "roles": role_counts(rows),
    }


def quality_score(dominant: Column, parse_err: Column, lint_err: Column, pii: Column, dup: Column) -> Column:
    """0 to 100 from shares: 40 for the dominant format, 15 each for being free of parse errors, lint errors, personal data and duplicates; half rounds up."""
    free = lambda c: 1 - F.coalesce(c, F.lit(0.0))
    raw = 0.40 * F.coalesce(dominant, F.lit(0.0)) + 0.15 * free(parse_err) + 0.15 * free(lint_err) + 0.15 * free(pii) + 0.15 * free(dup)
    return F.floor(100 * F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) + 0.5).cast("long")


def score_tier(score: Column) -> Column:
    """good from 80, warn from 60, else bad."""
    return F.when(score >= 80, "good").when(score >= 60, "warn").otherwise("bad")


def review_counts(rows: DataFrame) -> DataFrame:
    """(review, n) of live rows; `none` without one."""
    return rows.where("not deleted").groupBy(F.coalesce("review", F.lit("none")).alias("review")).agg(F.count("*").alias("n"))


def tag_counts(rows: DataFrame, hidden: bool = False) -> DataFrame:
    """(tag, n) of live rows; tags that begin with _ only if asked for."""
    tags = rows.where("not deleted").select(F.explode("tags").alias("tag"))
    return (tags if hidden else tags.where(~F.col("tag").startswith("_"))).groupBy("tag").agg(F.count("*").alias("n"))


def dirty_counts(rows: DataFrame) -> DataFrame:
    """(edited, deleted): changed live rows, and deleted ones."""
    return rows.agg(F.count_if(F.col("dirty") & ~F.col("deleted")).alias("edited"), F.count_if("deleted").alias("deleted"))


def recommendations(summary: DataFrame) -> DataFrame:
    """(place, action) for a one-row summary (total, dominant, dominant_share, lint_err_rows, pii_rows, dup_rows)."""
    rules = [
        ("resolve duplicates", F.col("dup_rows") > 0),
        ("redact personal data", F.col("pii_rows") > 0),
        ("fix lint errors", F.col("lint_err_rows") > 0),
        ("convert to the dominant format", (F.col("dominant_share") < 0.95) & (F.col("dominant") != "unknown") & (F.col("total") > 1)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(a)) for a, c in rules]))
    return summary.select(F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).alias("place", "action"))
