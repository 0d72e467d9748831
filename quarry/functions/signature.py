"""FNV-1a and 64-bit token signatures."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Offset basis and prime of 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
_TOKEN = re.compile(r"[a-z0-9]+")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-16 code units, as long (DataFrame functions only)."""
    data = F.encode(text, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(data, i * 2 + 1, F.lit(2))), 16, 10).cast("long")
    units = F.when(F.octet_length(data) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(data) / 2).cast("int") - 1), unit)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(units, F.lit(FNV_BASIS).cast("long"), lambda h, c: ((h.bitwiseXOR(c)) * FNV_PRIME).bitwiseAND(4294967295))


def _fnv_tokens(tokens: list[str]) -> np.ndarray:
    """FNV-1a of ASCII tokens, all at once: one step for each position."""
    longest = max(map(len, tokens))
    chars = np.frombuffer("".join(t.ljust(longest, "\0") for t in tokens).encode("ascii"), np.uint8).reshape(len(tokens), longest)
    h = np.full(len(tokens), FNV_BASIS, np.uint64)
    for i in range(longest):
        c = chars[:, i].astype(np.uint64)
        h = np.where(c > 0, ((h ^ c) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF), h)
    return h


def simhash_of(text: str | None) -> int:
    """Signed 64-bit signature: a bit is set if more tokens than not have it in their hash; the upper half hashes token + '!'."""
    tokens = _TOKEN.findall((text or "").lower())
    if not tokens:
        return 0
    kinds = {}
    for t in tokens:
        kinds[t] = kinds.get(t, 0) + 1
    names = list(kinds)
    low = _fnv_tokens(names)
    high = ((low ^ np.uint64(33)) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    bits = np.unpackbits((low | (high << np.uint64(32))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.array([kinds[n] for n in names]) @ bits.astype(np.int64)
    return int(np.packbits(ones * 2 > len(tokens), bitorder="little").view(np.int64)[0])


def simhash64(text: Column) -> Column:
    """64-bit token signature as long; Arrow batches, one signature a text."""

    @F.arrow_udf(LongType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash_of(t.as_py()) for t in texts], pa.int64())

    return of(text)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two signatures."""
    return F.bit_count(a.bitwiseXOR(b))
