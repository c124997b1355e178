"""Opens whatever a folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from . import archive, chunk_store, raw
from .lines import read_binary, read_lines

READERS = {archive.KIND: archive.Archive, chunk_store.KIND: chunk_store.ChunkArchive, raw.KIND: raw.RawArchive}


def open_archive(spark: SparkSession, path: str) -> archive.Archive | chunk_store.ChunkArchive | raw.RawArchive:
    """The reader for the kind that the folder's meta names; plain files are an error."""
    kind = archive.kind_of(spark, path)
    if kind not in READERS:
        raise ValueError(f"{path} isn't an archive")
    return READERS[kind](spark, path)


def lines_at(spark: SparkSession, path: str, block_size: int = 16_384) -> DataFrame:
    """(line_no, block_id, line) of an archive of lines or of plain text files."""
    if archive.kind_of(spark, path) == archive.KIND:
        return archive.Archive(spark, path).lines.select("line_no", "block_id", "line")
    return read_lines(spark, path, block_size, recursive=True).select("line_no", "block_id", "line")


def payloads_at(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of an archive of any kind or of plain files, which is what difference and patch take."""
    kind = archive.kind_of(spark, path)
    if kind == chunk_store.KIND:
        return chunk_store.ChunkArchive(spark, path).read()
    if kind == raw.KIND:
        return raw.RawArchive(spark, path).read().withColumnRenamed("file_name", "file")
    if kind == archive.KIND:
        a = archive.Archive(spark, path)
        text = search.reconstruct(a.lines, "block_id").orderBy("block_id")
        return text.select(F.col("block_id").cast("string").alias("file"), F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("content"))
    return read_binary(spark, path).select(F.col("file_name").alias("file"), "content")
