"""Words, window hashes and the shared folder: what the text operators have in common.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 keeps these bytes
for the characters themselves, so ``bytes.split()`` finds the words of a whole text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words. Hashing again is faster than remembering where most words are rare."""

    def __getitem__(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of 64-bit hashes each lies in, in their order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def starts(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64) if len(lens) else np.zeros(0, np.int64)


def windows(hashes: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of n words that lies in one document."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = hashes[:total].copy()
    for j in range(1, n):
        acc *= _M
        acc += mix(hashes[j : total + j] + np.uint64(j)) if j == n - 1 else hashes[j : total + j]
    ends = np.repeat(starts(lens) + lens, lens)[:total]
    at = np.nonzero(np.arange(total) + n <= ends)[0]
    return at, mix(acc[at])


def per_doc(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of values for each document, zero for a document without any."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(lens)))])


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text, or a single longer text; null counts as empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at), [t or b"" for t in texts.slice(at, to - at).to_pylist()]
            at = to


def word_arrays(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of words of each."""
    split = [t.split() for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for words in split for w in words]
    return known.of(flat), lens


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences, which compress well."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_longs(values: np.ndarray) -> bytes:
    """64-bit values as byte planes, of which small ones leave most empty."""
    return np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_longs(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack_counts(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def free_names(taken: list[str], wanted: list[str] | tuple[str, ...]) -> list[str]:
    """The wanted names, each with as many underscores behind it as it takes to differ from all taken ones, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder as workers reach it, and the path in it."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, at


def write_shared(path: str, data: bytes) -> None:
    """Writes a file under another name first, so that a repeated task leaves a whole file."""
    fs, at = shared_fs(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    try:
        fs.move(part, at)
    except OSError:  # a store whose rename doesn't replace: a file of this name is a repeated task's, and the same
        if fs.get_file_info(at).size != len(data):
            raise
        fs.delete_file(part)


def map_shared(path: str, dtype: type) -> np.ndarray:
    """A shared file as a memory-mapped array, empty if there is none.

    A file in another store than a mounted one is copied to an unnamed local file first.
    """
    fs, at = shared_fs(path)
    size = fs.get_file_info(at).size
    if not size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, dtype, "r")
    own = tempfile.TemporaryFile()
    with fs.open_input_stream(at) as src:
        while block := src.read(8 << 20):
            own.write(block)
    own.flush()
    return np.memmap(own, dtype, "r", shape=(size // np.dtype(dtype).itemsize,))


def content_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row's values, as key_a and key_b: together they name its content."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(F.lit(1), *columns).alias("key_b")]


def without_content(docs: DataFrame, keys: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text isn't one of those with these keys (distinct key_a, key_b).

    Texts stay where they are: up to ``broadcast_rows`` keys (16 bytes each, counted first) are
    broadcast, more are joined by a shuffle.
    """
    named = free_names(docs.columns, ["key_a", "key_b"])
    keyed = docs.withColumns(dict(zip(named, content_key(F.coalesce(F.col("text").cast("string"), F.lit(""))), strict=True)))
    few = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
    own = keys.select(*(F.col(k).alias(n) for k, n in zip(("key_a", "key_b"), named, strict=True)))
    return keyed.join(F.broadcast(own) if few else own, named, "left_anti").select(*docs.columns)


def only_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", how: str = "left_semi", broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of df whose id is (left_semi) or isn't (left_anti) in ids, distinct longs.

    Up to ``broadcast_rows`` ids (16 MB of longs, counted first) are broadcast so that the
    texts stay where they are; more are joined by a shuffle.
    """
    small = ids.select(column).limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(ids.select(column)) if small else ids.select(column), column, how)
