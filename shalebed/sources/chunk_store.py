"""Binary archives: payloads as stored chunks, with ranges, appends and patches on disk.

``chunks`` has the frames, (file, chunk_id, batch, raw_bytes, stored, frame), and never changes;
``layout`` says for each version of a file which frames make it up and where each begins;
``files`` has a row for each version of a file and is what makes it count. An edit writes the
new frames and the new layout of the files that it touches, so that it costs what it changes,
and readers of the version before are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import codec
from ..operators import chunks
from .archive import kind_of, write_meta

KIND = "chunks"
FRAMES = "file string, chunk_id long, batch int, raw_bytes long, stored boolean, frame binary"
LAYOUT = "file string, version int, chunk_id long, chunk_start long, raw_bytes long, batch int"
FILES = "file string, version int, size long, n_chunks long"


def write(files: DataFrame, path: str, file: str = "file", content: str = "content", size: int = chunks.CHUNK, level: int = 3) -> ChunkArchive:
    """Writes a new archive of (file, content); names are distinct, a null content is an empty file."""
    spark = files.sparkSession
    write_meta(spark, path, KIND, chunk_size=size, level=level)
    a = ChunkArchive(spark, path)
    own = files.select(F.col(file).cast("string").alias("file"), F.coalesce(F.col(content).cast("binary"), F.lit(b"").cast("binary")).alias("content"))
    a._commit(chunks.chunks_of(own, "file", "content", size), own.select("file"), 0)
    return a


@dataclass
class ChunkArchive:
    """A reader and editor."""

    spark: SparkSession
    path: str

    @cached_property
    def meta(self) -> dict:
        if kind_of(self.spark, self.path) != KIND:
            raise ValueError(f"{self.path} isn't an archive of chunks")
        return self.spark.read.parquet(f"{self.path}/meta").first().asDict()

    @property
    def files(self) -> DataFrame:
        """(file, version, size, n_chunks) of the last version of each file."""
        all_ = self.spark.read.schema(FILES).parquet(f"{self.path}/files")
        return all_.groupBy("file").agg(F.max(F.struct("version", "size", "n_chunks")).alias("v")).select("file", "v.*")

    @property
    def layout(self) -> DataFrame:
        """(file, chunk_id, chunk_start, raw_bytes, batch) of the files as they are now."""
        all_ = self.spark.read.schema(LAYOUT).parquet(f"{self.path}/layout")
        return all_.join(self.files.select("file", "version"), ["file", "version"]).drop("version")

    @property
    def chunks(self) -> DataFrame:
        """(file, chunk_id, chunk_start, payload) of all files."""
        return self.loaded(self.layout)

    def loaded(self, layout: DataFrame) -> DataFrame:
        """The chunks of some rows of the layout: frames are read, and opened, for those only."""
        frames = self.spark.read.schema(FRAMES).parquet(f"{self.path}/chunks").select("file", "chunk_id", "batch", "stored", "frame")
        own = layout.join(frames, ["file", "chunk_id", "batch"])
        payload = F.when(F.col("stored"), F.col("frame")).otherwise(codec.decompressed(F.when(~F.col("stored"), F.col("frame"))))
        return own.select("file", "chunk_id", "chunk_start", payload.alias("payload"))

    def read(self, names: list[str] | None = None) -> DataFrame:
        """(file, content) of whole files, of 2 GB at most; an empty file has an empty content."""
        files, layout = self.files, self.layout
        if names is not None:
            files, layout = (df.filter(F.col("file").isin(names)) for df in (files, layout))
        whole = chunks.joined(self.loaded(layout))
        return files.select("file").join(whole, "file", "left").select("file", F.coalesce("content", F.lit(b"").cast("binary")).alias("content"))

    def range(self, start: int, length: int) -> DataFrame:
        """(file, content) of length bytes from start; frames that don't touch the range aren't opened."""
        stop = start + max(length, 0)
        hit = self.layout.filter((F.col("chunk_start") < stop) & (F.col("chunk_start") + F.col("raw_bytes") > start))
        return chunks.byte_range(self.loaded(hit), start, length)

    def chunk_for(self, offset: int) -> DataFrame:
        """(file, chunk_id, within) of the chunk that holds a byte, from the layout alone."""
        hit = (F.col("chunk_start") <= offset) & (F.col("chunk_start") + F.col("raw_bytes") > offset)
        return self.layout.filter(hit).select("file", "chunk_id", (F.lit(offset) - F.col("chunk_start")).cast("long").alias("within"))

    def append(self, more: DataFrame) -> None:
        """Adds (file, content) at the ends of files, new ones included; a short last chunk is written anew, filled up."""
        more = more.select("file", F.col("content").cast("binary").alias("content"))
        now = self.layout.join(more.select("file"), "file", "left_semi")
        last = now.groupBy("file").agg(F.max(F.struct("chunk_id", "chunk_start", "raw_bytes", "batch")).alias("l")).select("file", "l.*")
        tail = self.loaded(last.filter(F.col("raw_bytes") < self.meta["chunk_size"]))
        self._edit(now, self._appended(last, tail, more), more.select("file"))

    def _appended(self, last: DataFrame, tail: DataFrame, more: DataFrame) -> DataFrame:
        begins = last.join(tail.select("file", F.col("payload").alias("rest")), "file", "left")
        own = more.join(begins, "file", "left")
        short = F.col("rest").isNotNull()
        own = own.select(
            "file", F.concat(F.coalesce("rest", F.lit(b"").cast("binary")), F.col("content")).alias("content"),
            F.when(short, F.col("chunk_id")).otherwise(F.coalesce(F.col("chunk_id") + 1, F.lit(0))).alias("c0"),
            F.when(short, F.col("chunk_start")).otherwise(F.coalesce(F.col("chunk_start") + F.col("raw_bytes"), F.lit(0))).alias("s0"),
        )
        cut = chunks.chunks_of(own.withColumn("at", F.struct("file", "c0", "s0")), "at", "content", self.meta["chunk_size"])
        return cut.select("file.file", (F.col("chunk_id") + F.col("file.c0")).alias("chunk_id"), (F.col("chunk_start") + F.col("file.s0")).alias("chunk_start"), "payload")

    def patch(self, changes: DataFrame) -> None:
        """Puts (file, chunk_id, payload) in the place of chunks; starts move on by the new sizes. A chunk that isn't there is an error."""
        now = self.layout.join(changes.select("file").distinct(), "file", "left_semi")
        wrong = changes.join(now, ["file", "chunk_id"], "left_anti").limit(1).collect()
        if wrong:
            raise IndexError(f"no chunk {wrong[0]['chunk_id']} of {wrong[0]['file']}")
        new = changes.select("file", "chunk_id", F.lit(None).cast("long").alias("chunk_start"), F.col("payload").cast("binary").alias("payload"))
        self._edit(now, new, changes.select("file").distinct())

    def _edit(self, now: DataFrame, new: DataFrame, touched: DataFrame) -> None:
        """A new version of the touched files: their layout with the new chunks in place of those of the same number."""
        version = self.files.agg(F.max("version")).first()[0] + 1
        kept = now.join(new.select("file", "chunk_id"), ["file", "chunk_id"], "left_anti")
        self._commit(new, touched, version, kept)

    def _commit(self, new: DataFrame, touched: DataFrame, version: int, kept: DataFrame | None = None) -> None:
        spark, level = self.spark, self.meta["level"]
        # neighbours come together, and a large file is cut by its size, not by an estimate of it
        dealt = new.hint("rebalance", "file").sortWithinPartitions("file", "chunk_id")
        frames = dealt.withColumn("frame", codec.compressed(F.col("payload"), level))
        stored = B.would_bloat(F.octet_length("payload"), F.octet_length("frame"))
        frames = frames.select("file", "chunk_id", F.lit(version).alias("batch"), F.octet_length("payload").cast("long").alias("raw_bytes"), stored.alias("stored"), F.when(stored, F.col("payload")).otherwise(F.col("frame")).alias("frame"))
        at = f"{self.path}/chunks/made={version}"
        frames.write.mode("overwrite").option("compression", "none").parquet(at)
        rows = spark.read.schema(FRAMES).parquet(at).select("file", "chunk_id", "raw_bytes", "batch")
        if kept is not None:
            rows = rows.unionByName(kept.select("file", "chunk_id", "raw_bytes", "batch"))
        # the layout of a file is numbers only: a row of 40 bytes for each 64 KiB of it
        start = chunks.starts_of(rows, F.col("raw_bytes"))
        laid = f"{self.path}/layout/made={version}"
        start.select("file", F.lit(version).alias("version"), "chunk_id", "chunk_start", "raw_bytes", "batch").write.mode("overwrite").parquet(laid)
        sums = spark.read.schema(LAYOUT).parquet(laid).groupBy("file").agg(F.sum("raw_bytes").alias("size"), F.count("*").alias("n_chunks"))
        done = touched.distinct().join(sums, "file", "left").select("file", F.lit(version).alias("version"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))
        done.write.mode("overwrite").parquet(f"{self.path}/files/made={version}")

    def stats(self) -> DataFrame:
        """(n_files, n_chunks, raw_bytes) as they are now."""
        return self.files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("raw_bytes"))
