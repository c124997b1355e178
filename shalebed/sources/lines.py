"""Lines: the rows of an archive, numbered without a global sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import partitions_for, stored

#: Splits whose starts are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def split_lines(text: Column) -> Column:
    """The lines of a text: one final newline goes, empty lines and carriage returns stay."""
    whole = F.when(F.endswith(text, F.lit("\n")), F.expr("substring(text, 1, length(text) - 1)")).otherwise(text)
    return F.split(whole, "\n", -1)


def running_offsets(counts: DataFrame, order: list[str], n: str) -> DataFrame:
    """Adds ``start``: the sum of n over all rows that come earlier in the order.

    Rows are dealt by ranges of the order, so that no range depends on how keys are spread, and
    stored; a range adds up its own rows, and only the sums of ranges meet on the driver.
    """
    dealt = counts.repartitionByRange(partitions_for(counts), *order).sortWithinPartitions(*order)
    ranged = stored(dealt.withColumn("range", F.spark_partition_id()), "offsets")
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("range").agg(F.sum(n)).collect())
    before = accumulate((s for _, s in sums), initial=0)
    bases = counts.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sums, before)], "range int, base long")
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("own", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return summed.join(F.broadcast(bases), "range").withColumn("start", F.col("base") + F.col("own")).drop("range", "base", "own")


def lines_of(docs: DataFrame, block_size: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, block_id, pos, line) of a table of texts, numbered by key and position.

    Rows of one key, and rows without one, come in the order of their texts' hashes; equal rows
    one after another. Only counts by (key, hash) are sorted for the numbers; texts meet their
    start by a join that Catalyst broadcasts where the counts are small. A null text has no lines.
    """
    rows = docs.select(F.col(key).alias("doc_id"), "text").filter("text IS NOT NULL").withColumn("tie", F.xxhash64("text"))
    counts = rows.groupBy("doc_id", "tie").agg(F.first(F.size(split_lines(F.col("text")))).alias("n"), F.count("*").alias("copies"))
    starts = running_offsets(counts.withColumn("rows", F.col("n") * F.col("copies")), ["doc_id", "tie"], "rows")
    if starts.filter("copies > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "tie"])
    own = starts.select(F.col("doc_id").alias("key"), F.col("tie").alias("of"), "n", "copies", "start")
    texts = rows.join(own, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("tie") == F.col("of")))
    each = texts.select("doc_id", "start", "n", F.posexplode(F.flatten(F.array_repeat(split_lines(F.col("text")), F.col("copies").cast("int")))).alias("at", "line"))
    line_no = (F.col("start") + F.col("at")).cast("long")
    return each.select("doc_id", line_no.alias("line_no"), F.expr(f"CAST((start + at) DIV {block_size} AS BIGINT)").alias("block_id"), F.expr("CAST(at % n AS BIGINT)").alias("pos"), "line")


def read_lines(spark: SparkSession, path: str, block_size: int, recursive: bool = False) -> DataFrame:
    """(source, line_no, block_id, line) of text files; line numbers run over the files by name.

    Files are split at newlines only. A file's lines are numbered by its splits: what a split
    holds is counted, and the counts run on over (file, start of the split).
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, lineSep="\n")
    at = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # ids ascend inside a partition, which a split never leaves
    counts = at.groupBy("source", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    starts = running_offsets(counts, ["source", "split"], "n").select("source", "split", "first", "start")
    few = starts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    numbered = at.join(F.broadcast(starts) if few else starts, ["source", "split"])
    line_no = (F.col("start") + F.col("id") - F.col("first")).cast("long")
    return numbered.select("source", line_no.alias("line_no"), F.floor(line_no / block_size).cast("long").alias("block_id"), "line")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, original_size, content) of files below a folder, one row each; a file of 2 GB or more doesn't fit in a row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_name"), F.col("length").alias("original_size"), "content")
