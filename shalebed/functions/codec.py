"""zstd over payloads, for ratios and stored payloads of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compressed(data: Column, level: int = 1, dictionary: bytes = b"") -> Column:
    """Payloads as zstd frames; one context for all batches of a task."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_ = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        c = zstandard.ZstdCompressor(level=level, **with_)
        for s in batches:
            yield s.map(lambda b: None if b is None else c.compress(bytes(b)))

    return run(data)


def decompressed(frames: Column, dictionary: bytes = b"") -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_ = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        d = zstandard.ZstdDecompressor(**with_)
        for s in batches:
            yield s.map(lambda b: None if b is None else d.decompress(bytes(b)))

    return run(frames)


def train_dictionary(payloads: DataFrame, data: str, size: int = 64 * 1024, sample_bytes: int = 10 << 20) -> bytes:
    """A dictionary from a sample of at most about ``sample_bytes``; empty if there is too little to learn from.

    The bound is a parameter of the writer; the dictionary only changes sizes, never contents.
    """
    total = payloads.agg(F.sum(F.octet_length(data))).first()[0] or 0
    part = payloads if total <= sample_bytes else payloads.sample(min(1.0, sample_bytes / total), seed=1)
    samples = [bytes(r[0]) for r in part.select(F.col(data).cast("binary")).toLocalIterator() if r[0]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""
