"""JSON trees as tables: nodes, paths, edits and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.edits import apply_edits
from quarry.functions.trees import difference_rows, node_rows, string_rows


def explode_nodes(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """(row_id, path, parent, key, type, size, value) of every node of v (columns row_id, v), at any depth, or down to `depth` containers.

    Paths read $.a[0]["b c"]. size: children of a container; value: JSON of a leaf.
    """
    return node_rows(rows.where("v is not null").select("row_id", F.to_json("v").alias("text")), depth)


def string_leaf_paths(rows: DataFrame) -> DataFrame:
    """(row_id, path, text) of string values of the rows without turns, at any depth."""
    plain = rows.where((F.size("turns") == 0) & ~F.col("error"))
    return string_rows(plain.select("row_id", F.col("json").alias("text")))


def get_path(v: Column, path: str) -> Column:
    """JSON of the value or subtree at a path ($.a[0]["b c"]); null if it is not there."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def edit(rows: DataFrame, edits: list[dict], json_col: str = "json") -> DataFrame:
    """rows with `edited` (JSON after the edits) and `refused` (number of edits that did not fit) added; see functions.edits."""
    return apply_edits(rows, json_col, edits, "__e").withColumns({"edited": F.col("__e.json"), "refused": F.col("__e.refused")}).drop("__e")


def diff_json(pairs: DataFrame) -> DataFrame:
    """(row_id, path, kind, from, to) for columns row_id, a, b (variants): change, add or remove, at any depth.

    A change of type is one change, nothing below it is listed; arrays are compared by index. Both sides are walked together, so nothing is shuffled.
    """
    return difference_rows(pairs.select("row_id", F.to_json("a").alias("a"), F.to_json("b").alias("b")))


def row_diff(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    """diff_json of dirty rows against the loaded snapshot (row_id, v)."""
    pairs = rows.where("dirty").select("row_id", F.col("v").alias("b")).join(loaded.select("row_id", F.col("v").alias("a")), "row_id")
    return diff_json(pairs)
