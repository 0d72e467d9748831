"""Removal of repeated 100-byte strings: Spark brings equal strings together, suffix arrays by linear grouping find them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quarry.llm import bitfilter
from quarry.llm.text import carried, small_batches, unpacked, utf8
from quarry.plans.lineage import bounded, cut, lookup

#: Length of the strings, and of the anchor in each of them by which equal ones meet.
LENGTH, ANCHOR = 100, 32
_TABLE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


# --- suffix array -------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of ints whose last element is smaller than all others and occurs once.

    Linear grouping. Suffixes start in groups of equal first symbol. From the highest
    group down, each member's previous smaller suffix (the nearest one to the left in a lower
    group, reached over pointers) takes on the member's Lyndon prefix: it moves to a new group just
    above its old one, those that took it on more often higher. Then every suffix is in
    the group of its Lyndon prefix, and one pass upwards over the groups puts each suffix at the front of its
    group when the one behind its prefix has been placed. No names are given and no recursion is needed.
    """
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable").tolist()  # a radix sort
    where = [0] * n  # place of a suffix in order
    group = [0] * n  # first place of a suffix's group, its name
    size = [0] * n  # by first place
    start, last = 0, None
    for place, i in enumerate(order):
        if text[i] != last:
            start, last = place, text[i]
        where[i], group[i] = place, start
        size[start] += 1
    before = list(range(-1, n - 1))  # previous smaller suffix of handled ones
    low = n
    while low > 0:
        low = group[order[low - 1]]  # the highest group not handled yet
        members = order[low : low + size[low]]
        members.sort()
        took: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:  # handled, or a member further left: its pointer is known
                p = before[p]
            before[i] = p
            took[p] = took.get(p, 0) + 1
        took.pop(-1, None)
        if not took:
            continue
        by: dict[int, list[int]] = {}
        for p, k in took.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            end: dict[int, int] = {}
            for p in by[k]:  # to the end of its group
                g = group[p]
                e = end[g] = end.get(g, g + size[g]) - 1
                q, at = order[e], where[p]
                order[at], where[q] = q, at
                order[e], where[p] = p, e
            for p in by[k]:
                g = group[p]
                group[p] = end[g]
            for g, e in end.items():
                whole = size[g]
                if e > g:  # else all of the group moved, and it keeps its name
                    size[g], size[e] = e - g, g + whole - e
    free = list(range(n))  # by group: the place that its next suffix gets
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for place in range(n):
        j = out[place] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            placed[j] = True
            free[g] += 1
            j = before[j]
    return out


#: Bytes of a block, and whole blocks inside every window wherever it starts.
BLOCK = 8
WHOLE = (LENGTH - BLOCK + 1) // BLOCK


def _blocks(pieces: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first): the pieces as one text of whole blocks, laid out from each piece's anchor on, and the place of each piece's first block.

    Symbols are ranks of the blocks' bytes; a 1 ends each piece, a 0 the text.
    """
    values, first, n = [], np.empty(len(pieces), np.int64), 0
    for k, p in enumerate(pieces):
        at = p["anchor"] % BLOCK
        whole = np.frombuffer(p["bytes"], np.uint64, (len(p["bytes"]) - at) // BLOCK, at)
        values.append(whole)
        first[k] = n
        n += len(whole) + 1
    sizes = np.array([len(v) for v in values])
    _, ranks = np.unique(np.concatenate(values), return_inverse=True)
    symbols = np.ones(n + 1, np.int64)
    symbols[-1] = 0
    symbols[np.arange(sizes.sum()) + np.repeat(np.arange(len(pieces)), sizes)] = ranks + 2
    return symbols, first


def repeated_windows(pieces: list[dict]) -> list[tuple[int, int, int, int]]:
    """(doc, m, start, end) of the bytes of every window of LENGTH that also starts earlier among the pieces.

    A piece is {bytes, doc, m, start, windows, anchor}: its first `windows` offsets begin
    windows; `anchor` is where its anchor lies. Equal windows lie alike to their anchors, so
    their blocks are equal. Suffix-array neighbours that agree on WHOLE blocks form a run; a
    window is named by the run of its first whole block and by the bytes around those blocks. All its places but
    the first by (doc, m, offset) are repeats.
    """
    symbols, first = _blocks(pieces)
    order = np.array(suffix_array(symbols.tolist()))
    view = np.lib.stride_tricks.sliding_window_view(np.r_[symbols, np.zeros(WHOLE, np.int64)], WHOLE)
    new = np.ones(len(order), np.int64)
    for k in range(1, len(order), 65536):
        part = order[k - 1 : k + 65536]
        new[k : k + 65536] = (view[part[1:]] != view[part[:-1]]).any(1)
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new)
    # every window, piece after piece
    count = np.array([p["windows"] for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), count)
    i = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.frombuffer(b"".join(p["bytes"] for p in pieces), np.uint8)
    sizes = np.array([len(p["bytes"]) for p in pieces])
    base = (np.cumsum(sizes) - sizes)[piece] + i
    head = (np.array([p["anchor"] for p in pieces])[piece] - i) % BLOCK
    block = first[piece] + (i + head - np.array([p["anchor"] % BLOCK for p in pieces])[piece]) // BLOCK
    edge = LENGTH - WHOLE * BLOCK  # bytes outside the whole blocks
    around = np.zeros((len(piece), (edge + 7) // 8 * 8), np.uint8)
    for k in range(edge):
        around[:, k] = flat[base + k + np.where(k < head, 0, WHOLE * BLOCK)]
    keys = [run[block], head, *around.view(np.uint64).T]
    doc, m = (np.array([p[c] for p in pieces], np.int64)[piece] for c in ("doc", "m"))
    at = np.array([p["start"] for p in pieces])[piece] + i
    by = np.lexsort((at, m, doc, *keys))
    differ = lambda cols: np.any([np.diff(c[by]) != 0 for c in cols], axis=0)
    starts = np.r_[True, differ(keys)]  # first place of each string
    lead = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    repeat = (doc[by] != doc[by][lead]) | (m[by] != m[by][lead]) | (at[by] != at[by][lead])
    found: dict[tuple[int, int], list[int]] = {}
    for d, k, a in zip(*(x[by][repeat].tolist() for x in (doc, m, at))):
        found.setdefault((d, k), []).append(a)
    return [(d, k, s, e) for (d, k), starts in found.items() for s, e in merged([(a, a + LENGTH) for a in starts])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that meet or overlap joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


# --- bringing equal strings together --------------------------------------------


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, windows, place) of the runs of consecutive windows that share an anchor: the window's ANCHOR bytes of least hash, the first of equals. place: where in the run's text the anchor lies.

    Equal windows have equal anchors, wherever they are, so they fall in runs of equal hash.
    """
    n = len(data) - LENGTH + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, factor, step = _TABLE[np.frombuffer(data, np.uint8)], 0x9E3779B97F4A7C15, 1
    while step < ANCHOR:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % 2**64, step * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, step = LENGTH - ANCHOR + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[start]], start, np.diff(np.r_[start, n]), at[start] - start


def _hashes(data: bytes) -> list[np.ndarray]:
    """Anchor hashes of a text; of a long one's chunks at most two of equal ones, which tell that a hash repeats."""
    if len(data) <= CHUNK:
        return [anchors(data)[0]]
    out = []
    for offset in range(0, len(data) - LENGTH + 1, CHUNK):
        h, n = np.unique(anchors(data[offset : offset + CHUNK + LENGTH - 1])[0], return_counts=True)
        out.append(np.repeat(h, np.minimum(n, 2)))
    return out


def _repeated_filter(docs: DataFrame) -> np.ndarray:
    """Bit filter of the anchor hashes that occur twice or more in docs (column data)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for x in batch.column(0) for h in _hashes(x.as_py())]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(h, np.uint64).view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return bitfilter.repeated(docs.select("data").mapInArrow(count, "h long, n long"))


#: Windows whose anchors are looked for at a time, so that the arrays of a very long text stay bounded.
CHUNK = 1 << 21


def _cut_out(data: bytes, wanted) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, stretches) of a text: rows (h, start, windows, anchor) of the pieces whose anchor is wanted, and (start, windows) of windows that repeat the piece just before.

    In a run of one byte, or of a short period, each piece equals the one before it: such pieces are given as one stretch of
    windows that start earlier, so the run costs no more than its length.
    """
    parts = []
    for offset in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
        h, start, windows, place = anchors(data[offset : offset + CHUNK + LENGTH - 1])
        ok = wanted(h)
        parts.append(np.stack([h[ok].view(np.int64), start[ok] + offset, windows[ok], place[ok]], axis=1))
    rows = np.concatenate(parts)
    again = np.zeros(len(rows), bool)
    for k in np.flatnonzero((rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 2] == rows[:-1, 2])) + 1:
        s, t, size = rows[k - 1, 1], rows[k, 1], rows[k, 2] + LENGTH - 1
        again[k] = data[s : s + size] == data[t : t + size]
    if not again.any():
        return rows, np.empty((0, 2), np.int64)
    start, end = rows[again, 1], rows[again, 1] + rows[again, 2]
    new = np.flatnonzero(np.r_[True, start[1:] != end[:-1]])
    return rows[~again], np.stack([start[new], end[np.r_[new[1:], len(end)] - 1] - start[new]], axis=1)


def _passes(known):
    return lambda h: bitfilter.passes(known.value, h)


def _named_pieces(docs: DataFrame, known) -> DataFrame:
    """(doc, m, h, p, start, windows) of the pieces of docs (doc, m, data) whose anchor passes the filter; p is the XXH3 (128 bits) of the bytes, null for stretches."""
    names, kinds = ["doc", "m", "h", "p", "start", "windows"], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for doc, m, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                rows, stretches = _cut_out(data, _passes(known))
                n = len(rows)
                if not n:
                    continue
                ends = (rows[:, 1] + rows[:, 2] + LENGTH - 1).tolist()
                p = [xxh3_128_digest(data[s:e]) for s, e in zip(rows[:, 1].tolist(), ends)] + [None] * len(stretches)
                places = np.concatenate([rows[:, 1:3], stretches])
                h = np.r_[rows[:, 0], np.zeros(len(stretches), np.int64)]
                columns = np.full(len(h), doc), np.full(len(h), m), h, p, places[:, 0], places[:, 1]
                held.append([pa.array(c, t) for c, t in zip(columns, kinds)])
                if sum(len(c[0]) for c in held) > 50_000:
                    yield joined()
            if held:
                yield joined()

    held: list[list[pa.Array]] = []

    def joined() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names)
        held.clear()
        return out

    return docs.select("doc", "m", "data").mapInArrow(of, "doc long, m long, h long, p binary, start int, windows int")


def _piece_bytes(docs: DataFrame, known) -> DataFrame:
    """(doc, m, start, windows, anchor, bytes) of the same pieces."""
    names, kinds = ["doc", "m", "start", "windows", "anchor", "bytes"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, m, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = data.as_py()
                rows, _ = _cut_out(data, _passes(known))
                for k in range(0, len(rows), 5000):
                    part = rows[k : k + 5000]
                    pieces = [data[s : s + w + LENGTH - 1] for s, w in part[:, 1:3].tolist()]
                    columns = np.full(len(part), doc), np.full(len(part), m), part[:, 1], part[:, 2], part[:, 3], pieces
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select("doc", "m", "data").mapInArrow(of, "doc long, m long, start int, windows int, anchor int, bytes binary")


_SPAN = StructType([StructField("doc", LongType()), StructField("m", LongType()), StructField("s", LongType()), StructField("e", LongType())])
#: Bytes that one suffix array is built over, about; and different pieces of one anchor that are brought to one task at most.
ARRAY_BYTES, GROUP_PIECES = 1 << 21, 20_000


def _group_spans(groups: Column) -> Column:
    """Spans of repeated windows in lists of pieces; several lists share a suffix array."""

    @F.arrow_udf(ArrayType(_SPAN))
    def of(lists: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        held: list[dict] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                out[-1].extend({"doc": d, "m": m, "s": s, "e": e} for d, m, s, e in repeated_windows(held))
            held, size = [], 0

        for group in lists:
            out.append([])
            held += group.as_py()
            size += sum(len(p["bytes"]) for p in group.as_py())
            if size > ARRAY_BYTES:
                flush()
        flush()
        return pa.array(out, pa.list_(pa.struct([(c, pa.int64()) for c in ("doc", "m", "s", "e")])))

    return of(groups)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, m, s, e) of bytes covered by windows that start earlier, for docs (doc, m, data) of different data.

    1. Anchor hashes are counted; a filter of fixed size keeps the repeated ones. 2. Their
    pieces are named by a digest of their bytes. Equal pieces of an anchor are one, at its first place; every
    other place is a repeat as a whole. 3. Only the first places of anchors with different pieces are cut out with their bytes; those of an anchor go through a
    suffix array together. An anchor with over GROUP_PIECES different pieces is not brought together:
    its windows are grouped one by one.
    """
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(_repeated_filter(docs))
    named = cut(_named_pieces(docs, known), "pieces")
    pieces, within = named.where("p is not null"), named.where("p is null")
    place = F.struct("doc", "m", "start")
    kinds = cut(pieces.groupBy("h", "p").agg(F.min(place).alias("first"), F.count("*").alias("n")), "kinds")
    again = lookup(pieces, kinds.where("n > 1").select("h", "p", "first"), ["h", "p"], small=0).where(place != F.col("first"))
    whole = lambda rows: rows.select("doc", "m", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("windows") + LENGTH - 1).cast("long").alias("e"))
    spans = whole(again).unionByName(whole(within))
    several = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    firsts = cut(lookup(kinds.select("h", "first"), several, "h", small=0).select("first.*", "h", "kinds"), "firsts")
    mixed_anchors = sc.broadcast(bitfilter.repeated(several.select("h", F.lit(2).cast("long").alias("n"))))
    # a first place is one row on either side, so no key is hot
    mixed = cut(_piece_bytes(docs, mixed_anchors).join(firsts, ["doc", "m", "start"]).select("h", "kinds", "doc", "m", "start", "windows", "anchor", "bytes"), "mixed")
    groups = mixed.where(F.col("kinds") <= GROUP_PIECES).groupBy("h").agg(F.collect_list(F.struct("bytes", "doc", "m", "start", "windows", "anchor")).alias("pieces"))
    spans = spans.unionByName(groups.select(F.explode(_group_spans(F.col("pieces"))).alias("x")).select("x.*"))
    single = mixed.where(F.col("kinds") > GROUP_PIECES).select("doc", "m", "start", "bytes", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
    single = single.select("doc", "m", (F.col("start") + F.col("i")).cast("long").alias("s"), F.substring("bytes", F.col("i") + 1, F.lit(LENGTH)).alias("w"))
    at = F.struct("doc", "m", "s")
    firsts = single.groupBy("w").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    return spans.unionByName(single.join(firsts, "w").where(at != F.col("first")).select("doc", "m", "s", (F.col("s") + LENGTH).alias("e")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with n_bytes, n_removed, n_spans and kept_sha256 added: bytes covered by a 100-byte string that also starts earlier are removed.

    Ids are integers; a null id comes last. Copies of a whole text are settled first: all but
    the first lose everything (from 100 bytes), and take no part in the search.

    Null text is empty. Rows that repeat an id and a text are one document and get the same result; rows that
    share an id only are ordered by a hash of their text. Columns named like the added ones are replaced. Empty table: no rows.
    """
    small_batches(df.sparkSession)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = F.xxhash64(text).alias("m")
    names = cut(df.select(doc, m, F.unhex(F.md5(text)).alias("digest"), F.octet_length(text).cast("long").alias("e")), "names")
    firsts = cut(names.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("digest", "first"), "firsts")
    copies = cut(lookup(names, firsts, "digest").where(F.col("doc") > F.col("first")).select("doc", "m", "e").distinct(), "copies")
    docs = df.select(doc, m, utf8(F.col(text_col)).alias("data"))
    spans = repeated_spans(docs.join(bounded(copies.select("doc", "m")), ["doc", "m"], "left_anti"))
    spans = spans.unionByName(copies.where(F.col("e") >= LENGTH).select("doc", "m", F.lit(0).cast("long").alias("s"), "e"))
    spans = spans.groupBy("doc", "m").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = df.select(carried(df), doc, m, utf8(F.col(text_col)).alias("data")).join(spans.hint("shuffle_hash"), ["doc", "m"], "left")

    kind = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])

    @F.arrow_udf(kind)
    def keep(data: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, x in zip(data, lists):
            raw, runs = t.as_py(), merged([(y["s"], y["e"]) for y in x.as_py() or ()])
            digest, at = hashlib.sha256(), 0
            for s, e in runs:
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            out.append({"n_removed": sum(e - s for s, e in runs), "n_spans": len(runs), "kept_sha256": digest.hexdigest()})
        return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    rows = joined.select("row", F.octet_length("data").cast("long").alias("n_bytes"), keep(F.col("data"), F.col("spans")).alias("kept"))
    return unpacked(rows, df, {"n_bytes": F.col("n_bytes"), **{c: F.col(f"kept.{c}") for c in ("n_removed", "n_spans", "kept_sha256")}})
