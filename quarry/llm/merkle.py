"""Document fingerprints: Merkle trees over paragraphs and sections (DataFrame functions only)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.lineage import cut, global_rank

#: A paragraph: up to the end of a sentence, a cell or a line, and of at most 200 characters, so that a text in one line has several.
PARAGRAPH = r"[^.!?|\n]{1,200}[.!?|\n]*|[.!?|\n]+"
#: A section ends with a paragraph whose hash begins with one of these digits, one in eight, so an edit moves the borders near it only.
ENDS = ["0", "8"]
#: Most ranges of ids into which documents are dealt to meet the next one.
MOST_PARTS = 100_000


def _step(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f may use its argument several times: as the element of an array it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tree(text: Column) -> Column:
    """Struct (root, sections, ends, paragraphs) of a text; null is empty.

    paragraphs: MD5 (hex) of each paragraph; sections: MD5 of the hashes of each section's paragraphs; ends: place
    of the last paragraph of each section; root: MD5 of the hashes of the sections. Paragraphs cover the whole text, so equal roots mean equal texts.
    """
    hashed = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PARAGRAPH})")), F.md5)
    last = lambda p: F.size(p) - 1

    def ended(p: Column) -> Column:
        inner = F.filter(F.transform(p, lambda h, i: F.when(F.substring(h, 1, 1).isin(ENDS) | (i == last(p)), i)), lambda i: i.isNotNull())
        return F.struct(p.alias("paragraphs"), inner.alias("ends"))

    def cut_up(t: Column) -> Column:
        start = lambda i: F.when(i > 0, F.get(t["ends"], i - 1) + 1).otherwise(0)
        hashes = F.transform(t["ends"], lambda e, i: F.md5(F.array_join(F.slice(t["paragraphs"], start(i) + 1, e - start(i) + 1), "")))
        return F.struct(hashes.alias("sections"), t["ends"].alias("ends"), t["paragraphs"].alias("paragraphs"))

    def rooted(t: Column) -> Column:
        return F.struct(F.md5(F.array_join(t["sections"], "")).alias("root"), t["sections"].alias("sections"), t["ends"].alias("ends"), t["paragraphs"].alias("paragraphs"))

    return _step(_step(_step(hashed, ended), cut_up), rooted)


def nodes(t: Column) -> Column:
    """The different hashes of a tree: its root, sections and paragraphs."""
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("r"), t["root"])), F.transform(t["sections"], lambda s: F.concat(F.lit("s"), s)), t["paragraphs"]))


def likeness(a: Column, b: Column) -> Column:
    """How alike two trees are, 0 to 1: twice the nodes in both over the nodes of each. 1 only for equal roots, which are looked at first."""
    share = lambda s: F.lit(2.0) * F.size(F.array_intersect(s["mine"], s["other"])) / (F.size(s["mine"]) + F.size(s["other"]))
    return F.when(a["root"] == b["root"], 1.0).otherwise(_step(F.struct(nodes(a).alias("mine"), nodes(b).alias("other")), share))


def changes(a: Column, b: Column) -> Column:
    """Array of (section, paragraph): the paragraphs of tree b, in sections that tree a does not have, that a does not have either.

    Equal roots are not looked into, nor are sections that both have. What was only taken out shows when the trees are given the other way round.
    """
    start = lambda i: F.when(i > 0, F.get(b["ends"], i - 1) + 1).otherwise(0)
    differing = F.filter(F.sequence(F.lit(0), F.size(b["ends"]) - 1), lambda i: ~F.array_contains(a["sections"], F.get(b["sections"], i)))
    places = F.flatten(F.transform(differing, lambda i: F.transform(F.sequence(start(i), F.get(b["ends"], i)), lambda p: F.struct(i.alias("section"), p.alias("paragraph")))))
    found = F.filter(places, lambda x: ~F.array_contains(a["paragraphs"], F.get(b["paragraphs"], x["paragraph"])))
    return F.when((a["root"] == b["root"]) | (F.size(b["ends"]) == 0), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)


def paragraphs(text: Column) -> Column:
    """The paragraphs that a tree hashes, in order; joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PARAGRAPH})"))


def _literal(value, kind: str) -> Column:
    """A value as a constant of the plan, however long its lists are."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, default=str)), kind)


def _place(key: Column, bounds: list[dict], kind: str) -> Column:
    """Number of bounds (ascending) at or below the key, looked up by two short lists."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    lists = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    count = lambda items: F.size(F.filter(items, lambda b: b <= key))
    coarse = count(_literal([x[0] for x in lists], f"array<{kind}>"))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + count(F.get(_literal(lists, f"array<array<{kind}>>"), coarse - 1)))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, tree, next_text, next_tree, ...) of every row of df: the row's own, and those of the row behind it by id; the last is followed by the first.

    Null text is empty, null ids come last, rows of one id by the hash of their text. Ids and hashes alone are ranked; the ids at equal
    steps bound ranges, and documents are dealt into these, so texts are shuffled once. The first row of a range is sent to the one before, too.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.struct(F.col("id").isNull().alias("void"), F.col("id").alias("id"), F.xxhash64("text").alias("h")))
    order = cut(keyed.select("key"), "ids")
    total = order.count()
    parts = max(1, min(MOST_PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total))
    step = max(1, -(-total // parts))
    ranked = global_rank(order, [F.col("key")], "at").where(F.col("at") % step == 0)
    bounds = [r.key.asDict() for r in ranked.orderBy("at").select("key").collect()]  # MOST_PARTS rows at most
    kind = order.schema["key"].dataType.simpleString()
    first, own = bounds[:1], [b for a, b in zip(bounds, bounds[1:]) if a != b]
    keyed = keyed.withColumn("part", _place(F.col("key"), own, kind))
    same = lambda b: F.coalesce(F.col("key") == b, F.lit(False))
    at_bound = same(F.get(_literal(own, f"array<{kind}>"), F.col("part") - 1))
    is_first = same(F.get(_literal(first, f"array<{kind}>"), F.lit(0)))
    ghost = lambda p, g: F.struct(p.alias("part"), F.lit(g).alias("ghost"))
    none = F.array().cast("array<struct<part:int,ghost:int>>")
    copies = F.concat(
        F.array(ghost(F.col("part"), 0)),
        F.when(at_bound, F.array(ghost(F.col("part") - 1, 1))).otherwise(none),
        F.when(is_first, F.array(ghost(F.lit(len(own)), 2))).otherwise(none),
    )
    dealt = keyed.withColumn("copy", F.explode(copies)).select("id", "text", "key", "copy.part", "copy.ghost")
    by = Window.partitionBy("part").orderBy("ghost", "key")
    behind = dealt.withColumn("next_text", F.lead("text").over(by)).withColumn("tree", tree(F.col("text")))
    return behind.withColumn("next_tree", F.lead("tree").over(by)).where("ghost = 0").drop("part", "ghost", "key")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by as many first ones of the following text, or all of it."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, tree, edited, edited_tree, next_tree, near_edited, near_next) of every row of df.

    Null text is empty; its tree has a root and no branches. Equal texts have equal trees. A single row is its own next one. Repeated rows
    and ids come back each. Other columns are not read. Empty table: no rows.
    """
    rows = with_next(df, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_tree", tree(F.col("edited")))
    near = lambda t: likeness(F.col("tree"), F.col(t))
    return rows.withColumn("near_edited", near("edited_tree")).withColumn("near_next", near("next_tree")).withColumnRenamed("id", id_col)
