"""Every operator on a table with every name that its modules use as an extra column, and with very long and degenerate texts."""

import inspect
import re

import pytest
from conftest_rows import SCHEMA, prose
from pyspark.sql import functions as F

from quarry.llm import bitfilter, decontam, hierbayes, langid, linededup, mixing, quality, sharding, simhash, suffix, text, toolchat
from quarry.operators import graph
from quarry.plans import lineage

ITEM = prose(7)
FILTERS = ("take", "keep_first", "keep_good", "keep_clean")


def bench(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": (mixing, lambda s, d: mixing.mix(d)),
    "take": (mixing, lambda s, d: mixing.take(d)),
    "near_duplicates": (simhash, lambda s, d: simhash.near_duplicates(d)),
    "keep_first": (simhash, lambda s, d: simhash.keep_first(d)),
    "shard": (sharding, lambda s, d: sharding.shard(d)),
    "drop_frequent_lines": (linededup, lambda s, d: linededup.drop_frequent_lines(d)),
    "quality": (quality, lambda s, d: quality.quality(d)),
    "keep_good": (quality, lambda s, d: quality.keep_good(d)),
    "identify": (langid, lambda s, d: langid.identify(d)),
    "find_items": (decontam, lambda s, d: decontam.find_items(d, bench(s))),
    "keep_clean": (decontam, lambda s, d: decontam.keep_clean(d, bench(s))),
    "remove_repeats": (suffix, lambda s, d: suffix.remove_repeats(d)),
    "classify": (hierbayes, lambda s, d: hierbayes.classify(d, labels(s), F.col("source"), F.col("lang"))),
    "link_calls": (toolchat, lambda s, d: toolchat.link_calls(toolchat.parse_messages(d.select("*", F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"))), {})),
}


def names_of(*modules):
    """Every string of the modules that could name a column, with and without the mark of inner names."""
    found = {n for m in modules for n in re.findall(r'["\'`]([A-Za-z_][A-Za-z0-9_]*)["\'`]', inspect.getsource(m))}
    return sorted(found | {f"__{n.strip('_')}" for n in found})


@pytest.fixture(scope="module")
def table(spark):
    """Rows with nulls, copies and ties, one text of 5 MB and one run of a character as long."""
    rows = [(i, prose(i % 30), "xa" if i % 3 else "yb", f"s{i % 2}", 1) for i in range(40)]
    rows += [(40, None, None, None, None), (41, "", "xa", "s0", 0), (None, prose(3), "xa", "s1", 1), (5, prose(5), "xa", "s1", 1), (6, prose(9), "xa", "s1", 1), (43, prose(50) + "\n" + ITEM, "xa", "s0", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    extra = spark.range(2).select((F.col("id") + 50).alias("doc_id"), F.when(F.col("id") == 0, words).otherwise(F.repeat(F.lit("a"), F.lit(5_000_000))).alias("text"), F.lit("xa").alias("lang"), F.lit("s0").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    return lineage.cut(df.unionByName(extra), "odd")


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, table, name):
    module, operator = OPERATORS[name]
    skip = {*table.columns, "conv_id", "turn", "role"}
    df = table.withColumns({n: F.lit(i) for i, n in enumerate(names_of(module, text, graph, lineage, bitfilter)) if n not in skip and n.lower() == n})
    out = operator(spark, df)
    got = out.count()
    if name in FILTERS:
        assert out.columns == df.columns and 0 < got
        assert out.select(*[F.sum(c) for c in df.columns if c.startswith("__")]).first() is not None
    else:
        assert got == df.count()
    if name == "remove_repeats":
        run = out.where("doc_id = 51").first()
        assert (run["n_bytes"], run["n_removed"], run["n_spans"]) == (5_000_000, 4_999_999, 1)
    if name in ("drop_frequent_lines", "remove_repeats", "find_items"):
        assert {"__id", "__row"} & set(df.columns) <= set(out.columns)
