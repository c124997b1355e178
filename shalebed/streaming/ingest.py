"""Micro-batch ingestion: lines from a stream are appended to an archive of lines.

A micro-batch is a batch of the archive, written and committed as any other; the stream's
number of it is stored with the commit, and one that is there already is left out, so that a
batch that is run again after a failure is written once. ``Archive`` opens the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import ArchiveOptions
from ..sources.archive import KIND, Archive, kind_of, write_meta
from ..sources.lines import running_offsets
from ..storage import stored


def opened(spark: SparkSession, path: str, block_size: int, options: ArchiveOptions = ArchiveOptions()) -> Archive:
    """The archive at a path, made if there is none."""
    if kind_of(spark, path) == "plain":
        write_meta(spark, path, KIND, "overwrite", block_size=block_size, trailing_newline=True, level=options.codec_level, trigrams=options.trigrams)
    return Archive(spark, path)


def append_batch(lines: DataFrame, batch_id: int, path: str, block_size: int) -> None:
    """Appends one batch (source, line): numbers run on inside the batch by source and position."""
    spark = lines.sparkSession
    archive = opened(spark, path, block_size)
    if any(b["source_batch"] >= batch_id for b in archive.batches):
        return
    # stored once, as the numbers of a second run of the source need not be those of the first
    at = stored(lines.select("source", F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("part"), "line"), "batch")
    counts = at.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    starts = running_offsets(counts, ["part"], "n").select("part", "first", "start")
    rows = at.join(F.broadcast(starts), "part").select("source", (F.col("start") + F.col("id") - F.col("first")).cast("long").alias("line_no"), "line")
    archive.append(rows, source_batch=batch_id)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files that arrive in a folder."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def ingest(lines: DataFrame, path: str, checkpoint: str, block_size: int, once: bool = False) -> StreamingQuery:
    """Runs the stream into the archive; once: what there is now."""
    writer = lines.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path, block_size)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts(lines: DataFrame, term: str) -> DataFrame:
    """How many lines of a stream contain a term, by source, kept up by the engine's own state."""
    return lines.filter(F.contains("line", F.lit(term))).groupBy("source").agg(F.count("*").alias("n_lines"))
