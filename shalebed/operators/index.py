"""The index of an archive's blocks: exact trigram bitmaps.

Indexed trigrams are lower-case and lie inside words of ``[A-Za-z0-9_]``, so there are 37^3 =
50,653 of them: a bitmap of one bit each is exact. A block's bitmap is cut by the trigrams'
first letter into 37 columns, and a search reads the columns of its own letters only.

Blocks are indexed where their lines lie, an Arrow batch at a time; a block that several
batches or tasks hold is the union of its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_"
WORD = "[A-Za-z0-9_]{3,}"
N = len(ALPHABET)
#: Bytes of one letter's bitmap, and the letters whose bitmaps lie in the first half of a block's.
LETTER_BYTES, HALF = -(-N * N // 8), 23
#: Spark's bitmap aggregates have so many bytes.
HALF_BYTES = 4096
COLUMNS = [f"tri_{c}" for c in ALPHABET]
_BLOCKS_AT_ONCE = 256
_PARTS = "block_id long, first_line long, line_count long, raw_bytes long, lo binary, hi binary"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(line: Column) -> Column:
    """The indexed words of a line, as they are written."""
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def block_words(lines: DataFrame) -> DataFrame:
    """(block_id, word) without repetitions: partial sets first, then the blocks'."""
    return lines.select("block_id", F.explode(F.array_distinct(words_of(F.col("line")))).alias("word")).distinct()


def write_words(lines: DataFrame, path: str, mode: str = "error") -> None:
    """The table (word, block_id), sorted by word in each file, so that a word's rows are read through extremes and Bloom filters."""
    own = block_words(lines).repartition("word", "block_id").sortWithinPartitions("word")
    own.write.mode(mode).option("parquet.bloom.filter.enabled#word", "true").parquet(f"{path}/words")


def word_candidates(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Ids of the blocks that have all of the words, each as a whole word in its own case."""
    wanted = sorted(set(words))
    hits = spark.read.parquet(f"{path}/words").filter(F.col("word").isin(wanted))
    return hits.groupBy("block_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("block_id")


def _digits() -> np.ndarray:
    """The number of each byte in the alphabet, in either case; N of any other byte."""
    out = np.full(256, N, np.uint8)
    for k, c in enumerate(ALPHABET):
        out[[ord(c), ord(c.upper())]] = k
    return out


def _first_bits() -> np.ndarray:
    """Where the bits of each letter begin."""
    k = np.arange(N)
    return np.where(k < HALF, 8 * LETTER_BYTES * k, 8 * HALF_BYTES + 8 * LETTER_BYTES * (k - HALF))


def trigram_bits(lines: list[bytes], block: np.ndarray, blocks: int) -> np.ndarray:
    """The bitmaps (rows of bytes) of so many blocks; block has the number of each line's."""
    data = np.frombuffer(b"\n".join([*lines, b""]), np.uint8)
    digit = _digits()[data].astype(np.int64)
    lens = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    a, b, c = digit[:-2], digit[1:-1], digit[2:]
    at = np.flatnonzero((a < N) & (b < N) & (c < N))
    bits = np.zeros((blocks, 16 * HALF_BYTES), bool)
    bits[np.repeat(block, lens)[at], _first_bits()[a[at]] + N * b[at] + c[at]] = True
    return np.packbits(bits, axis=1, bitorder="little")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        order = np.argsort(batch.column("block_id").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        ids, nth = np.unique(batch.column("block_id").to_numpy(), return_inverse=True)
        number, lines = batch.column("line_no").to_numpy(), [x or b"" for x in batch.column("line").cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        begin = np.searchsorted(nth, np.arange(len(ids) + 1))
        for k in range(0, len(ids), _BLOCKS_AT_ONCE):
            n = min(_BLOCKS_AT_ONCE, len(ids) - k)
            own, cut = slice(begin[k], begin[k + n]), begin[k : k + n]
            bits = trigram_bits(lines[own], nth[own] - k, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[k : k + n]), pa.array(np.minimum.reduceat(number[: begin[k + n]], cut)),
                pa.array(np.diff(begin[k : k + n + 1])), pa.array(np.add.reduceat(sizes[: begin[k + n]], cut)),
                pa.array([r[:HALF_BYTES].tobytes() for r in bits], pa.binary()), pa.array([r[HALF_BYTES:].tobytes() for r in bits], pa.binary()),
            ], ["block_id", "first_line", "line_count", "raw_bytes", "lo", "hi"])


def blocks_of(lines: DataFrame) -> DataFrame:
    """The index: a row for each block, with its extent and the bitmaps of its letters."""
    parts = lines.select("block_id", "line_no", "line").mapInArrow(_parts, _PARTS)
    whole = parts.groupBy("block_id").agg(F.min("first_line").alias("first_line"), F.sum("line_count").alias("line_count"), F.sum("raw_bytes").alias("raw_bytes"), F.bitmap_or_agg("lo").alias("lo"), F.bitmap_or_agg("hi").alias("hi"))
    letter = lambda k: F.substring(F.col("lo" if k < HALF else "hi"), 1 + LETTER_BYTES * (k if k < HALF else k - HALF), LETTER_BYTES)
    return whole.select("block_id", "first_line", "line_count", "raw_bytes", *(letter(k).alias(c) for k, c in enumerate(COLUMNS)))


def n_trigrams() -> Column:
    """How many trigrams a block, or a union of blocks, has."""
    return reduce(lambda a, b: a + b, (F.bitmap_count(c) for c in COLUMNS)).cast("long")


def merged(blocks: DataFrame, by: Column) -> DataFrame:
    """The union of blocks' bitmaps by another key, such as a group of blocks; each letter's bytes begin its column."""
    return blocks.groupBy(by.alias("group_id")).agg(*(F.bitmap_or_agg(c).alias(c) for c in COLUMNS))


def grams_of(term: str) -> list[str]:
    """The trigrams that every line with the term has in its words: those of the term's own runs of three or more."""
    runs = re.findall(WORD, term)
    return sorted({r.lower()[i : i + 3] for r in runs for i in range(len(r) - 2)})


def may_contain(term: str) -> Column:
    """The predicate on the index that holds for every block with a line that contains the term: a bit of its letter's column for each trigram; a null column has none."""
    tests = []
    for a, b, c in grams_of(term):
        at = N * ALPHABET.index(b) + ALPHABET.index(c)
        tests.append(f"coalesce(CAST(conv(hex(substring(tri_{a}, {at // 8 + 1}, 1)), 16, 10) AS INT) & {1 << at % 8} != 0, false)")
    return F.expr(" AND ".join(tests) or "true")
