"""An archive: a folder of Parquet tables that is searched where it lies.

``lines`` has the rows, in order of their number; ``blocks`` the index; ``meta`` what a reader
has to know; ``sketches`` the vectors of blocks and ``templates`` their templates, if asked for.

Lines and index are written by batches, each in folders of its own, and a row of ``batches``
makes a batch count: a writer that fails in between leaves nothing that a reader sees, and the
next one writes that batch anew. A stream's micro-batches are batches like those of ``append``.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..operators import index, search, templates, vectors
from ..options import ArchiveOptions

KIND = "lines"
#: Bytes of lines in a file; and how many terms the sketches of blocks are made of.
FILE_BYTES, TERMS = 256 << 20, 1 << 16
BATCH = "batch int, source_batch long, first_line long, next_line long, first_block long, next_block long"


def write_meta(spark: SparkSession, path: str, kind: str, mode: str = "error", **values) -> None:
    cells = [F.lit(v).alias(k) for k, v in {"kind": kind, **values}.items()]
    spark.range(1).select(*cells).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def kind_of(spark: SparkSession, path: str) -> str:
    """What a folder holds: lines, chunks, raw or a pack of files; plain if it isn't an archive."""
    try:
        return spark.read.parquet(f"{path}/meta").first()["kind"]
    except AnalysisException:
        return "plain"


def write(lines: DataFrame, path: str, options: ArchiveOptions = ArchiveOptions(), trailing_newline: bool = True, mode: str = "error") -> Archive:
    """Writes a new archive from (line_no, block_id, line, ...)."""
    spark = lines.sparkSession
    if mode == "overwrite":
        for name in ("lines", "blocks", "batches", "sketches", "templates"):
            _remove(spark, f"{path}/{name}")
    write_meta(spark, path, KIND, mode, block_size=options.block_size, trailing_newline=trailing_newline, level=options.codec_level, trigrams=options.trigrams)
    a = Archive(spark, path)
    a.add(lines, options)
    if options.templates:
        templates.dictionary(a.lines).write.options(**options.writer()).parquet(f"{path}/templates")
    if options.sketches:
        a.attach(block_terms(a.lines, options.sketch_dim), bits=options.sketch_bits)
    return a


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def block_terms(lines: DataFrame, dim: int) -> DataFrame:
    """(block_id, embedding): a vector for each block from the counts of its words, projected to dim."""
    terms = lines.select("block_id", F.explode(index.words_of(F.col("line"))).alias("w")).groupBy("block_id", F.pmod(F.xxhash64(F.lower("w")), F.lit(TERMS)).cast("int").alias("term_id")).agg(F.count("*").alias("weight"))
    projected = vectors.project_sparse(terms, dim, "block_id", TERMS).withColumnRenamed("projected", "embedding")
    none = lines.select("block_id").distinct().join(projected, "block_id", "left_anti").withColumn("embedding", vectors.empty(dim))
    return projected.unionByName(none)


@dataclass
class Archive:
    """A reader and editor."""

    spark: SparkSession
    path: str

    @cached_property
    def meta(self) -> dict:
        if kind_of(self.spark, self.path) != KIND:
            raise ValueError(f"{self.path} isn't an archive of lines")
        return self.spark.read.parquet(f"{self.path}/meta").first().asDict()

    @cached_property
    def batches(self) -> list:
        """The batches that count, in order: a row for each writing."""
        try:
            return sorted(self.spark.read.schema(BATCH).parquet(f"{self.path}/batches").collect())
        except AnalysisException:
            return []

    def _table(self, name: str) -> DataFrame:
        last = self.batches[-1]["batch"] if self.batches else -1
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("batch") <= last).drop("batch")

    @cached_property
    def lines(self) -> DataFrame:
        return self._table("lines")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    @property
    def sketches(self) -> DataFrame | None:
        """(block_id, norm, packed, dim, bits) of every block, or none."""
        try:
            return self.spark.read.parquet(f"{self.path}/sketches")
        except AnalysisException:
            return None

    @property
    def next_line(self) -> int:
        return self.batches[-1]["next_line"] if self.batches else 0

    @property
    def next_block(self) -> int:
        return self.batches[-1]["next_block"] if self.batches else 0

    def add(self, lines: DataFrame, options: ArchiveOptions | None = None, source_batch: int = -1) -> None:
        """Writes one batch of lines that have their numbers and blocks already."""
        options = options or ArchiveOptions(codec_level=self.meta["level"], trigrams=self.meta["trigrams"])
        spark, batch = self.spark, self.batches[-1]["batch"] + 1 if self.batches else 0
        first_block, last_block, last_line, size = lines.agg(F.min("block_id"), F.max("block_id"), F.max("line_no"), F.sum(F.octet_length("line"))).first()
        if last_block is None:
            first_block, last_block, last_line, size = self.next_block, self.next_block - 1, self.next_line - 1, 0
        blocks = max(1, last_block + 1 - first_block)
        files = min(blocks, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // FILE_BYTES)))
        each = -(-blocks // files)
        # blocks are dealt to files by their number, so that no sample of the lines is needed
        dealt = lines.repartitionById(files, F.expr(f"CAST((block_id - {first_block}) DIV {each} AS INT)")).sortWithinPartitions("line_no")
        at = f"{self.path}/lines/batch={batch}"
        dealt.write.mode("overwrite").options(**options.writer()).parquet(at)
        written = spark.read.schema(lines.schema).parquet(at)
        found = index.blocks_of(written)
        if not options.trigrams:
            found = found.withColumns({c: F.lit(None).cast("binary") for c in index.COLUMNS})
        found.write.mode("overwrite").options(**options.writer()).parquet(f"{self.path}/blocks/batch={batch}")
        row = (batch, source_batch, self.next_line, last_line + 1, self.next_block, last_block + 1)
        spark.createDataFrame([row], BATCH).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        for name in ("batches", "lines", "blocks"):
            self.__dict__.pop(name, None)

    def append(self, more: DataFrame, order: str = "line_no", source_batch: int = -1) -> None:
        """Adds lines (line_no from 0, line, ...) after the last one.

        New lines begin a new block, so that old blocks and their index stay as they are; a
        line's block is stored, not derived, for short blocks.
        """
        size, own = self.meta["block_size"], self.lines.columns if self.batches else more.columns
        new = more.withColumns({"line_no": (F.col(order) + self.next_line).cast("long"), "block_id": (F.floor(F.col(order) / size) + self.next_block).cast("long")})
        kinds = dict(self.lines.dtypes) if self.batches else {}
        self.add(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(kinds[c]).alias(c) for c in own]) if kinds else new, source_batch=source_batch)

    def stats(self) -> DataFrame:
        """Row and block counts and bytes, from the index alone."""
        return self.blocks.agg(F.sum("line_count").alias("row_count"), F.count("*").alias("block_count"), F.sum("raw_bytes").alias("raw_bytes"))

    @property
    def _asked(self) -> DataFrame:
        """The index as searches ask it; without trigrams every block may match."""
        return self.blocks if self.meta["trigrams"] else self.blocks.withColumns({c: F.unhex(F.lit("FF" * index.LETTER_BYTES)) for c in index.COLUMNS})

    def search(self, term: str) -> DataFrame:
        return search.search(self.lines, self._asked, term)

    def search_bytes(self, term: bytes) -> DataFrame:
        return search.search_bytes(self.lines, self._asked, term)

    def count(self, term: str) -> DataFrame:
        return search.count_matches(self.lines, self._asked, term)

    def first(self, term: str, n: int = 100) -> DataFrame:
        return search.first_matches(self.lines, self._asked, term, n)

    def limited(self, term: str, n: int = 100) -> DataFrame:
        return search.limited(self.lines, self._asked, term, n)

    def block_of(self, line_no: int) -> int:
        """The block that a line number lies in; -1 past the end."""
        k = bisect_right([b["first_line"] for b in self.batches], line_no) - 1
        if k < 0 or line_no >= self.next_line:
            return -1
        return self.batches[k]["first_block"] + (line_no - self.batches[k]["first_line"]) // self.meta["block_size"]

    def get_row(self, line_no: int) -> DataFrame:
        return search.get_row(self.lines, line_no, self.block_of(line_no))

    def reconstruct(self) -> DataFrame:
        """All lines in order."""
        return self.lines.orderBy("line_no")

    def payloads(self, level: int = 1) -> DataFrame:
        """(block_id, raw_bytes, payload): each block as one zstd frame of its lines, for readers outside Spark."""
        text = search.reconstruct(self.lines, "block_id").select("block_id", F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("data"))
        return text.select("block_id", F.octet_length("data").cast("long").alias("raw_bytes"), codec.compressed(F.col("data"), level).alias("payload"))

    def attach(self, sketches: DataFrame, dim: int | None = None, bits: int = 4) -> None:
        """Stores a quantised sketch of each block's vector (block_id and one array column), once and for all of them."""
        if self.sketches is not None:
            raise ValueError("the archive has vectors already")
        n, blocks = sketches.select("block_id").distinct().count(), self.blocks.count()
        if n != blocks or sketches.join(self.blocks.select("block_id"), "block_id", "left_anti").limit(1).count():
            raise ValueError(f"{n} vectors for {blocks} blocks")
        name = next(f.name for f in sketches.schema if isinstance(f.dataType, T.ArrayType))
        vectors.quantize(sketches, bits, "block_id", name, dim).drop("codes").write.parquet(f"{self.path}/sketches")

    def sketch(self, block_id: int) -> DataFrame:
        """The sketch of one block; an error where there is no such block or no vectors."""
        if not 0 <= block_id < self.next_block or self.sketches is None:
            raise IndexError(f"no sketch of block {block_id}")
        return self.sketches.filter(F.col("block_id") == block_id)

    def vector_report(self) -> DataFrame:
        """(dim, bits, n_blocks) of the attached vectors; no row without any."""
        own = self.sketches
        if own is None:
            return self.spark.createDataFrame([], "dim int, bits int, n_blocks long")
        return own.groupBy("dim", "bits").agg(F.count("*").alias("n_blocks"))

    def similar(self, query, threshold: float | None = None, k: int | None = None) -> DataFrame:
        """(block_id, score) of the blocks whose sketch is similar to a vector, best first: above a threshold, the k best, or both; nothing without vectors."""
        if self.sketches is None:
            return self.spark.createDataFrame([], "block_id long, score double")
        return vectors.similar_sketches(self.sketches, query, threshold, k, "block_id")

    def similar_lines(self, query, threshold: float | None = None, k: int | None = None) -> DataFrame:
        """(block_id, score, lines) of similar blocks."""
        return vectors.with_lines(self.similar(query, threshold, k), self.lines)

