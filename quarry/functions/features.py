"""Row features of chat-like JSON: format, turns, texts, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.json import minified, strict_variant, top_keys, utf16_length
from quarry.functions.rowscan import CHAT_FORMATS, bound_batches, scanned
from quarry.functions.trees import string_leaves


def est_tok(text: Column) -> Column:
    """Tokens of a text: UTF-16 length over 4, rounded up; null or empty has none."""
    return F.coalesce(F.ceil(utf16_length(text) / 4), F.lit(0)).cast("long")


def estimate_tokens(chars: Column) -> Column:
    """Tokens of a row of so many characters: a quarter, half rounded up, 1 at least; 0 for none."""
    return F.when(chars == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(chars / 4 + 0.5))).cast("long")


def row_text() -> Column:
    """`role: content` lines of a chat-like row, else its JSON; raw text of an error row."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return F.when(F.col("error"), F.col("raw")).when(F.size("turns") > 0, lines).otherwise(F.col("json"))


def row_assistant_text() -> Column:
    """Contents of assistant or gpt turns, joined by line ends; empty for an error row."""
    own = F.filter("turns", lambda t: t["role"].isin("assistant", "gpt"))
    return F.when(F.col("error"), "").otherwise(F.array_join(F.transform(own, lambda t: t["content"]), "\n"))


def row_tokens() -> Column:
    """Tokens of a row: of its turns, with 4 for each, or of its JSON or raw text."""
    turns = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + est_tok(t["content"]) + 4)
    return F.when(F.col("error"), est_tok(F.col("raw"))).when(F.size("turns") > 0, turns).otherwise(est_tok(F.col("json")))


def rows_table(df: DataFrame, raw_col: str = "raw", id_col: str = "row_id") -> DataFrame:
    """The rows table of JSON texts: v, error, json, turns, fmt, form_issues, char_count, tokens, top_keys, and annotation columns where df has none. Other columns pass through.

    Format, turns and what is odd about them come from one Arrow pass (functions.rowscan); the other columns are expressions, and what is not used is not computed.
    Arrow batches of the session are bound by bytes from here on.
    """
    bound_batches(df.sparkSession)
    out = df.withColumnsRenamed({raw_col: "raw", id_col: "row_id"}).withColumn("__s", scanned(F.col("raw")))
    out = out.withColumns({"error": F.col("__s.error"), "fmt": F.col("__s.fmt"), "turns": F.col("__s.turns"), "form_issues": F.col("__s.issues")}).drop("__s")
    plain = minified(F.col("raw"))
    out = out.withColumns(
        {
            "v": strict_variant(F.col("raw")),
            "json": F.when(~F.col("error"), plain),
            "char_count": F.coalesce(utf16_length(F.when(F.col("error"), F.col("raw")).otherwise(plain)), F.lit(0)).cast("long"),
            "top_keys": F.when(F.col("error"), F.array().cast("array<string>")).otherwise(top_keys(F.col("raw"))),
        }
    )
    out = out.withColumn("tokens", estimate_tokens(F.col("char_count")))
    for name, value in (("deleted", F.lit(False)), ("excluded", F.lit(False)), ("dirty", F.lit(False)), ("tags", F.array().cast("array<string>")), ("review", F.lit(None).cast("string"))):
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out


def search_text() -> Column:
    """Lower-cased serialised row."""
    return F.lower(F.when(F.col("error"), F.col("raw")).otherwise(F.col("json")))


def chat_view(rows: DataFrame) -> DataFrame:
    """(row_id, turn_no, role, content) of the rows in a chat format."""
    return rows.where(F.col("fmt").isin(*CHAT_FORMATS)).select("row_id", F.posexplode("turns").alias("turn_no", "t")).select("row_id", "turn_no", "t.role", "t.content")


def stratum_key(kind: str) -> Column:
    """Stratum of a row by `review`, `role` (of the first turn) or `tag` (the first)."""
    if kind == "review":
        return F.coalesce("review", F.lit("none"))
    if kind == "role":
        return F.when(F.col("error"), "parse-error").otherwise(F.coalesce(F.get("turns", F.lit(0))["role"], F.lit("unknown")))
    if kind == "tag":
        return F.coalesce(F.get("tags", F.lit(0)), F.lit("untagged"))
    raise ValueError(f"no stratum {kind!r}: review, role or tag")


def row_chunks() -> Column:
    """Texts to compare of a row: raw text of an error row, contents of non-empty turns, else all non-empty strings, at any depth."""
    turns = F.transform("turns", lambda t: t["content"])
    plain = ~F.col("error") & (F.size("turns") == 0)
    found = F.when(F.col("error"), F.array("raw")).when(F.size("turns") > 0, turns).otherwise(string_leaves(F.when(plain, F.col("raw"))))
    return F.filter(found, lambda s: s != "")


def snippet(text: Column, start: Column, end: Column, context: int = 40) -> Column:
    """Struct (before, match, after, more_left, more_right) around text[start:end] (0-based)."""
    left = F.greatest(start - context, F.lit(0))
    return F.struct(
        F.substring(text, left + 1, start - left).alias("before"),
        F.substring(text, start + 1, end - start).alias("match"),
        F.substring(text, end + 1, F.lit(context)).alias("after"),
        (left > 0).alias("more_left"),
        (end + context < F.length(text)).alias("more_right"),
    )


def truncated(text: Column, most: int = 120) -> Column:
    """text, or its first `most` characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def norm(text: Column) -> Column:
    """Lower-cased text with runs of white space as one space, trimmed. Single spaces, most of all white space, are left where they stand."""
    from quarry.functions.json import SPACE

    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}{{2,}}|(?! ){SPACE}", " "))
