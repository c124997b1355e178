"""Byte statistics of texts and payloads.

Counts of bytes need one pass over a value and no shuffle: an Arrow UDF returns a histogram of
256 counts, and everything else is an expression on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 4096


def payload(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def sample(data: Column, size: int = SAMPLE) -> Column:
    """The first bytes, which the detectors look at."""
    return F.substring(data, 1, size)


def slices(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Neighbouring values of about ``most`` bytes together, or a single larger one."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _values(data: pd.Series) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The values with null as empty, their sizes, and which are null."""
    none = data.isna().to_numpy()
    own = [b"" if x else bytes(b) for b, x in zip(data, none, strict=True)]
    return own, np.fromiter(map(len, own), np.int64, len(own)), none


@F.pandas_udf(T.ArrayType(T.LongType()))
def histogram(data: pd.Series) -> pd.Series:
    """How often each of the 256 bytes occurs; many values are counted at once."""
    values, sizes, none = _values(data)
    out: list = []
    for own in slices(sizes):
        n = own.stop - own.start
        at = np.repeat(np.arange(n) << 8, sizes[own]) + np.frombuffer(b"".join(values[own]), np.uint8)
        out += list(np.bincount(at, minlength=n << 8).reshape(n, 256))
    return pd.Series([None if x else h for h, x in zip(out, none, strict=True)], dtype=object)


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def entropy(counts: Column) -> Column:
    """Shannon entropy of counts in bits, log2(n) - sum(c log2(c)) / n; 0 of nothing."""
    n = total(counts)
    logs = F.aggregate(F.filter(counts, lambda c: c > 1), F.lit(0.0), lambda s, c: s + c * F.log2(c))
    return F.when(n > 0, F.greatest(F.log2(n) - logs / n, F.lit(0.0))).otherwise(0.0)


def variety(counts: Column) -> Column:
    return F.size(F.filter(counts, lambda c: c > 0))


def nibbles(counts: Column, high: bool) -> Column:
    """Counts of the 16 values of the high or low halves of the bytes."""
    at = (lambda k: [16 * k + i for i in range(16)]) if high else (lambda k: [16 * i + k for i in range(16)])
    return F.array(*[reduce(lambda a, b: a + b, [counts[i] for i in at(k)]) for k in range(16)])


def counted(counts: Column, values: bytes | range) -> Column:
    """How many bytes are one of the values."""
    return F.aggregate(F.array(*[counts[i] for i in sorted(set(values))]), F.lit(0).cast("long"), lambda s, x: s + x)


#: Bytes of a match's key and of the longest match, and how much of a value is looked at.
KEY, LONGEST, LOOKED = 4, 256, 64 * 1024


def agreement(b: bytes, i: int, j: int, most: int) -> int:
    """How many bytes from two places on are equal, at most so many."""
    n, step = 0, 32
    while n < most:
        x = int.from_bytes(b[i + n : i + n + step], "little") ^ int.from_bytes(b[j + n : j + n + step], "little")
        if x:
            return min(most, n + ((x & -x).bit_length() - 1 >> 3))
        n += step
    return most


def repeated(values: list[bytes]) -> list[int]:
    """Bytes of each value that lie in repeats: a key seen before is followed to where it came last outside a repeat, without overlap.

    The keys of all values are sorted at once, by key and place. A place whose key is new to its
    value is outside of a repeat, or among the last bytes of one (``inside``), so that only places
    whose keys came before are looked at one by one.
    """
    data = b"".join([*values, bytes(16)])
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    ends, n = np.cumsum(sizes), len(data) - 16
    words = np.empty(n, np.uint64)  # the eight bytes from each place on
    for k in range(min(8, n)):
        words[k::8] = np.frombuffer(data, "<u8", len(words[k::8]), k)
    both = np.sort(words << np.uint64(32) | np.arange(n, dtype=np.uint64))
    at, begins = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), np.repeat(ends - sizes, sizes)
    new = np.ones(n, bool)
    new[1:] = (both[1:] ^ both[:-1]) >> np.uint64(32) != 0
    new[1:] |= at[:-1] < begins[at[1:]]
    group, before = np.empty(n, np.int32), np.zeros(n, np.uint8)
    group[at], before[at] = np.cumsum(new) - 1, ~new
    group, last, words = memoryview(group), memoryview(at[new]), memoryview(words)
    following, inside, marks = before.tobytes().find, bytearray(n), b"\1" * (KEY - 1)
    totals = []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        total, stop = 0, end - KEY + 1
        i = following(1, begin, stop)
        while i >= 0:
            g = group[i]
            seen = last[g]
            if i - seen >= KEY and not inside[seen]:
                x = words[seen] ^ words[i]
                size = min((x & -x).bit_length() - 1 >> 3 if x else agreement(data, seen, i, LONGEST), end - i, i - seen)
                total, i = total + size, i + size
                inside[i - KEY + 1 : i] = marks
            else:
                last[g] = i
                i += 1
            i = following(1, i, stop)
        totals.append(total)
    return totals


def repeated_bytes(b: bytes) -> int:
    return repeated([b])[0]


@F.pandas_udf(T.DoubleType())
def lz_match_ratio(data: pd.Series) -> pd.Series:
    """The part of the first 64 KiB that repeats; 0 of less than two keys."""
    heads, sizes, none = _values(data.map(lambda b: b[:LOOKED], na_action="ignore"))
    total = np.array([n for own in slices(sizes, 1 << 17) for n in repeated(heads[own])], np.float64)
    return pd.Series(np.where(none, np.nan, np.where(sizes >= 2 * KEY, total / np.maximum(sizes, 1), 0.0))).astype(object).where(~none, None)


#: Depths that are tried for the best one, and that are compared.
DEPTHS = (3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 45, 60, 90, 120, 180)
COMPARED = (1, 2, 3, 4, 5, 6, 9, 12)
#: What counts as nothing, and how far angles reach.
NOTHING, REACH = 1e-10, 3 * np.pi


def resultants(values: list[bytes], depths: tuple[int, ...]) -> np.ndarray:
    """(values, depths): how much the bytes point in one direction, 0 of nothing and 1 of one byte value.

    A byte's deviation in standard deviations, over its relative place to the power of the
    depth, is scaled to the largest one and taken as an angle; the score is the length of the
    mean of all unit vectors. Values are the rows of a matrix, so each step is one operation.
    """
    n = np.fromiter(map(len, values), np.int64, len(values))
    inside = np.arange(n.max(initial=1)) < n[:, None]
    count = np.maximum(n, 1)[:, None]
    x = np.zeros(inside.shape)
    x[inside] = np.frombuffer(b"".join(values), np.uint8)
    off = np.where(inside, x - x.sum(axis=1, keepdims=True) / count, 0)
    spread = np.sqrt((off**2).sum(axis=1, keepdims=True) / count)
    flat = spread[:, 0] < NOTHING
    unit, place = off / np.where(spread < NOTHING, 1, spread), np.minimum(np.arange(1, x.shape[1] + 1) / count, 1)
    out = np.empty((len(values), len(depths)))
    for k, depth in enumerate(depths):
        weight = place ** min(max(depth, 1), 180)
        turned = unit / np.where(weight < NOTHING, 1, weight)
        top = np.abs(turned).max(axis=1, keepdims=True)
        angle = REACH * turned / np.where(top < NOTHING, 1, top)
        east, north = ((f(angle) * inside).sum(axis=1) / count[:, 0] for f in (np.cos, np.sin))
        out[:, k] = np.where(flat | (top[:, 0] < NOTHING), 1.0, np.hypot(east, north))
    out[n == 0] = 0
    return out


def structure_scores(data: Column, tried: tuple[int, ...]) -> Column:
    """Scores of the first 4 KiB at each of the depths, in one pass."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        values, _, none = _values(batch.map(lambda b: b[:SAMPLE], na_action="ignore"))
        out = [row for k in range(0, len(values), 64) for row in resultants(values[k : k + 64], tried)]
        return pd.Series([None if x else row for row, x in zip(out, none, strict=True)], dtype=object)

    return run(data)


def structure_at(data: Column, depth: int = 3) -> Column:
    return structure_scores(data, (depth,))[0]


def depths(data: Column, tried: tuple[int, ...] = COMPARED) -> Column:
    """(depth, score) at each depth."""
    return F.zip_with(F.array(*map(F.lit, tried)), structure_scores(data, tried), lambda d, s: F.struct(d.alias("depth"), s.alias("score")))


def best_depth(scores: Column) -> Column:
    """The depth with the highest score, the first of equal ones; 3 if no score is above 0."""
    none = F.struct(F.lit(3).alias("depth"), F.lit(0.0).alias("score"))
    return F.aggregate(scores, none, lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))


def compressibility(entropy_bits: Column, lz: Column) -> Column:
    return 0.5 * (1 - entropy_bits / 8) + 0.5 * lz


#: The levels by how well a payload compresses.
def recommended_level(score: Column) -> Column:
    return F.when(score > 0.7, 1).when(score > 0.5, 3).when(score > 0.3, 6).when(score > 0.1, 9).otherwise(1)


def would_bloat(raw: Column, compressed: Column) -> Column:
    """Whether storing the original is better: over 95 % of it is left."""
    return F.when(raw == 0, compressed > 0).otherwise(compressed / raw > 0.95)
