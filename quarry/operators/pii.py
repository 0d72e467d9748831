"""Personal data: scanning and redaction."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.edits import BORDER
from quarry.functions.jsontext import alone, bound
from quarry.functions.rowscan import sliced

#: Name, pattern and replacement, in the order in which redaction applies them.
PATTERNS: dict[str, tuple[str, str]] = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    "phone": (r"(?:\+?\d[\d -]{8,}\d)", "<PHONE>"),
    "ipv4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    "ipv6": (r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b", "<IP6>"),
    "cc": (r"\b(?:\d[ -]?){13,19}\b", "<CC>"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "<SSN>"),
    "apikey": (
        r"\b(?:sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{30,}|ghp_[A-Za-z0-9]{30,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})\b",
        "<APIKEY>",
    ),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b", "<JWT>"),
    "url": (r"\bhttps?:\/\/[^\s)\]\"']+", "<URL>"),
}
#: The patterns of each preset.
PRESETS: dict[str, tuple[str, ...]] = {
    "standard": ("email", "phone", "cc", "ssn", "apikey", "jwt", "ipv4"),
    "strict": tuple(PATTERNS),
    "permissive": ("cc", "ssn", "apikey", "jwt"),
}


#: What a text must hold for a pattern to be tried on it: a cheap test, which no match can do without.
_NEEDS: dict[str, re.Pattern] = {
    "email": re.compile("@"),
    "phone": re.compile(r"\d[\d -]{8}", re.ASCII),
    "ipv4": re.compile(r"\d\.\d", re.ASCII),
    "ipv6": re.compile(r"[A-Fa-f0-9]:"),
    "cc": re.compile(r"\d[ -]?\d", re.ASCII),
    "ssn": re.compile(r"\d-\d", re.ASCII),
    "apikey": re.compile(r"sk[-_]|AIza|ghp_|xox|AKIA"),
    "jwt": re.compile("eyJ"),
    "url": re.compile("://"),
}


def enabled_names(enabled: str | list[str] | None) -> list[str]:
    """Names of the enabled patterns in order: a preset's, those listed, or all."""
    chosen = PATTERNS if enabled is None else PRESETS[enabled] if isinstance(enabled, str) else enabled
    if unknown := set(chosen) - set(PATTERNS):
        raise ValueError(f"no such patterns: {sorted(unknown)}")
    return [n for n in PATTERNS if n in chosen]


def luhn_ok(match: str) -> bool:
    """13 to 19 digits, without spaces and hyphens, that pass the Luhn check."""
    digits = [int(c) for c in match if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def _find(rules: list[tuple], text: str) -> list[tuple[str, int, int, str]]:
    """(id, start, end, match) over the rules' patterns, each on its own, so that overlaps are reported; offsets in characters from 0."""
    return [(n, m.start(), m.end(), m[0]) for n, need, p in rules if need.search(text) for m in p.finditer(text) if n != "cc" or luhn_ok(m[0])]


def scan_positions(text: Column, enabled: str | list[str] | None = None) -> Column:
    """Array of (id, start, end, match) with 0-based character offsets, in one Arrow pass; empty for null."""
    names = enabled_names(enabled)
    kind = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())]))

    @F.arrow_udf("array<struct<id:string,start:int,end:int,match:string>>")
    def of(texts: pa.Array) -> pa.Array:
        rules = [(n, _NEEDS[n], re.compile(PATTERNS[n][0], re.ASCII)) for n in names]
        found = lambda t: [] if t is None else [dict(zip(("id", "start", "end", "match"), x)) for x in _find(rules, t)]
        return sliced(texts, lambda ts: [found(t) for t in ts], kind)

    # a filter on what it finds would otherwise be pushed below, with a second pass over the texts
    return of.asNondeterministic()(text)


def scan(text: Column, enabled: str | list[str] | None = None) -> Column:
    """Array of (id, match) over all enabled patterns, each on its own, so that overlaps are reported."""
    return F.transform(scan_positions(text, enabled), lambda x: F.struct(x["id"].alias("id"), x["match"].alias("match")))


def _java(name: str) -> str:
    """A pattern with borders between ASCII words, as scanning has them."""
    return PATTERNS[name][0].replace(r"\b", BORDER)


def _needed(text: Column, name: str) -> Column:
    """Whether a text holds what a match cannot do without: a cheap test before a pattern is tried."""
    marks = {"email": ["@"], "apikey": ["sk-", "sk_", "AIza", "ghp_", "xox", "AKIA"], "jwt": ["eyJ"], "url": ["://"]}.get(name)
    if marks is None:
        return text.rlike(_NEEDS[name].pattern)
    out = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        out = out | F.contains(text, F.lit(mark))
    return out


def _changed(name: str) -> Callable[[Column], Column]:
    """A struct (text, matches) after one pattern: its matches are replaced, of card numbers those that pass the Luhn check."""
    pattern, token = _java(name), PATTERNS[name][1]
    # candidates have 13 to 19 digits; what lies between comes as single characters
    valid = lambda p: (F.length(p) >= 13) & F.call_function("luhn_check", F.regexp_replace(p, "[ -]", ""))

    def cards(text: Column) -> Column:
        of = lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.when(valid(p), token).otherwise(p)), "").alias("text"), F.size(F.filter(ps, valid)).cast("long").alias("n"))
        return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(f"({pattern}|(?s:.))")), of))

    def plain(text: Column) -> Column:
        return bound(F.regexp_count(text, F.lit(pattern)), lambda n: F.when(n > 0, F.struct(F.regexp_replace(text, pattern, token).alias("text"), n.cast("long").alias("n"))))

    def of(s: Column) -> Column:
        found = F.when(_needed(s["text"], name), (cards if name == "cc" else plain)(s["text"]))
        return bound(found, lambda f: F.when(f.isNull(), s).otherwise(F.struct(f["text"].alias("text"), (s["matches"] + f["n"]).alias("matches"))))

    return of


def redacted_inside(text: Column, enabled: str | list[str] | None = None) -> Column:
    """redacted() for use inside a lambda."""
    state = F.struct(text.alias("text"), F.lit(0).cast("long").alias("matches"))
    for name in enabled_names(enabled):
        state = bound(state, _changed(name))
    return state


def redacted(text: Column, enabled: str | list[str] | None = None) -> Column:
    """Struct (text, matches): the text with matches replaced where they stand, pattern after pattern, and their number; null stays null.

    With phone on, card and social security numbers are phones by the time that their patterns are tried.
    """
    return alone(redacted_inside(text, enabled))


def redact(text: Column, enabled: str | list[str] | None = None) -> Column:
    """text with matches replaced; see redacted."""
    return redacted(text, enabled)["text"]


def pii_rows(rows: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    """(row_id, id, start, end, match) over the serialised live rows, raw text for error rows."""
    text = F.when(F.col("error"), F.col("raw")).otherwise(F.col("json"))
    return rows.where("not deleted").select("row_id", F.explode(scan_positions(text, enabled)).alias("f")).select("row_id", "f.*")


def pii_fields(rows: DataFrame, leaves: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    """(row_id, field, id, start, end, match): rawText of error rows, `turn i (role)` of rows with turns, else the path of a string.

    leaves: (row_id, path, text) of string values of the rows without turns.
    """
    live = rows.where("not deleted")
    raw = live.where("error").select("row_id", F.lit("rawText").alias("field"), F.col("raw").alias("text"))
    turns = live.where("not error").select("row_id", F.posexplode("turns").alias("i", "t"))
    turns = turns.select("row_id", F.format_string("turn %d (%s)", "i", "t.role").alias("field"), F.col("t.content").alias("text"))
    texts = raw.unionByName(turns).unionByName(leaves.select("row_id", F.col("path").alias("field"), "text"))
    return texts.select("row_id", "field", F.explode(scan_positions(F.col("text"), enabled)).alias("f")).select("row_id", "field", "f.*")


def pii_counts(findings: DataFrame) -> DataFrame:
    """(id, matches, rows) for each pattern."""
    return findings.groupBy("id").agg(F.count("*").alias("matches"), F.count_distinct("row_id").alias("rows"))


def redacted_report(findings: DataFrame) -> DataFrame:
    """Findings with positions and lengths, without the matched text."""
    return findings.withColumn("len", F.col("end") - F.col("start")).drop("match")


def redact_rows(rows: DataFrame, enabled: str | list[str] | None = None) -> DataFrame:
    """(row_id, before, after, matches) of the live rows in which something is redacted, over row text or raw text."""
    from quarry.functions.features import row_text

    found = rows.where("not deleted").select("row_id", row_text().alias("before")).withColumn("r", redacted(F.col("before"), enabled))
    return found.select("row_id", "before", F.col("r.text").alias("after"), "r.matches").where("matches > 0")
