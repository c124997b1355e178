"""Archives of several files: frames in the order of the files' names, so that one file's are neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators.chunks import chunks_of, joined


def checked(names: DataFrame) -> DataFrame:
    """File rows whose name stays below the folder that they are extracted to; others raise."""
    bad = F.rlike("file_name", F.lit(r"(^|/)\.\.(/|$)")) | F.startswith("file_name", F.lit("/"))
    return names.withColumn("file_name", F.when(bad, F.raise_error(F.concat(F.lit("a name outside the archive: "), F.col("file_name")))).otherwise(F.col("file_name")))


def pack(files: DataFrame, path: str, level: int = 6, dictionary_bytes: int = 128 * 1024) -> None:
    """Stores (file_name, content) as compressed chunks; names are whole relative paths."""
    dictionary = codec.train_dictionary(files, "content", dictionary_bytes)
    rows = chunks_of(checked(files), "file_name", "content")
    frames = rows.select(F.col("file").alias("file_name"), "chunk_id", "chunk_start", F.octet_length("payload").alias("raw_bytes"), codec.compressed(F.col("payload"), level, dictionary).alias("frame"))
    sizes = files.select("file_name", F.octet_length("content").cast("long").alias("original_size"))
    # neighbours come together, and a large file is cut by its size
    frames.hint("rebalance", "file_name").sortWithinPartitions("file_name", "chunk_id").write.option("compression", "none").parquet(f"{path}/frames")
    sizes.write.parquet(f"{path}/files")
    files.sparkSession.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, original_size, compressed_size, ratio), and a row with a null name for all of them."""
    frames = spark.read.parquet(f"{path}/frames").groupBy("file_name").agg(F.sum(F.octet_length("frame")).alias("compressed_size"))
    return totals(spark.read.parquet(f"{path}/files").join(frames, "file_name", "left").fillna(0, ["compressed_size"]))


def totals(sizes: DataFrame) -> DataFrame:
    """Sizes by file and in total."""
    out = sizes.rollup("file_name").agg(F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"))
    return out.withColumn("ratio", F.when(F.col("original_size") > 0, F.col("compressed_size") / F.col("original_size")))


def extract(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(file_name, content) of the files, each checked against its stored size."""
    frames, files = spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/files")
    if names is not None:
        frames, files = (df.filter(F.col("file_name").isin(names)) for df in (frames, files))
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    chunks = frames.select(F.col("file_name").alias("file"), "chunk_start", codec.decompressed(F.col("frame"), dictionary).alias("payload"))
    whole = joined(chunks).withColumnRenamed("file", "file_name")
    out = checked(files).join(whole, "file_name", "left").withColumn("content", F.coalesce("content", F.lit(b"").cast("binary")))
    right = F.octet_length("content") == F.col("original_size")
    return out.select("file_name", F.when(right, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("a wrong size: "), F.col("file_name")))).alias("content"))
