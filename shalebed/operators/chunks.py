"""Binary payloads as chunks: range reads, append, patch, difference and its application.

A chunk row is (file, chunk_id, chunk_start, payload). Starts are stored, so that a short last
chunk never shifts the ones after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK, DIFF = 64 * 1024, 4096


def chunks_of(files: DataFrame, file: str, data: str, size: int = CHUNK) -> DataFrame:
    """Cuts payloads; an empty one has no chunks."""
    n = F.octet_length(data)
    places = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    each = files.select(F.col(file).alias("file"), data, F.explode(places).alias("chunk_id"))
    start = F.col("chunk_id") * size
    return each.select("file", F.col("chunk_id").cast("long").alias("chunk_id"), start.cast("long").alias("chunk_start"), F.substring(F.col(data), start + 1, F.lit(size)).alias("payload"))


def end_of() -> Column:
    return F.col("chunk_start") + F.octet_length("payload")


def joined(chunks: DataFrame, name: str = "content") -> DataFrame:
    """(file, content): the chunks in order, as one payload, which has to fit in a row (2 GB)."""
    parts = chunks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chunk_start", "payload"))).alias("ps"))
    return parts.select("file", F.aggregate("ps", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["payload"])).alias(name))


def byte_range(chunks: DataFrame, start: int, length: int) -> DataFrame:
    """(file, content) of length bytes from start; only chunks that touch the range are read, clipped at both ends."""
    if length <= 0:
        return chunks.select("file", F.lit(b"").cast("binary").alias("content")).filter(F.lit(False))
    stop = start + length
    hit = chunks.filter((F.col("chunk_start") < stop) & (end_of() > start))
    first = F.greatest(F.lit(start) - F.col("chunk_start"), F.lit(0))
    last = F.least(F.lit(stop), end_of()) - F.col("chunk_start")
    cut = hit.withColumn("payload", F.substring(F.col("payload"), (first + 1).cast("int"), (last - first).cast("int")))
    return joined(cut)


def chunk_for(chunks: DataFrame, offset: int) -> DataFrame:
    """(file, chunk_id, within) of the chunk that holds a byte; no row past the end."""
    return chunks.filter((F.col("chunk_start") <= offset) & (end_of() > offset)).select("file", "chunk_id", (F.lit(offset) - F.col("chunk_start")).cast("long").alias("within"))


def patched(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks with those of changes (file, chunk_id, payload) in place of their own; starts move on by the new sizes."""
    new = chunks.join(changes.select("file", "chunk_id", F.col("payload").alias("new"), F.lit(True).alias("changed")), ["file", "chunk_id"], "left")
    out = new.select("file", "chunk_id", F.when(F.col("changed"), F.col("new")).otherwise(F.col("payload")).alias("payload"))
    return starts_of(out, F.octet_length("payload").cast("long")).select("file", "chunk_id", "chunk_start", "payload")


def starts_of(chunks: DataFrame, size: Column, together: int = 1 << 14) -> DataFrame:
    """Adds chunk_start, the sizes of a file's earlier chunks.

    Two levels, so that a file of many chunks is no single task: runs of ``together`` chunks are
    added up, the sums of a file's runs run on, and each run adds up its own.
    """
    rows = chunks.withColumn("_size", size).withColumn("_run", F.expr(f"chunk_id DIV {together}"))
    before = lambda *by: Window.partitionBy("file", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "_run").agg(F.sum("_size").alias("_sum")).select("file", "_run", F.coalesce(F.sum("_sum").over(before("_run")), F.lit(0)).alias("_base"))
    own = rows.withColumn("_own", F.coalesce(F.sum("_size").over(before("_run", "chunk_id")), F.lit(0)))
    return own.join(sums, ["file", "_run"]).withColumn("chunk_start", (F.col("_base") + F.col("_own")).cast("long")).drop("_size", "_run", "_own", "_base")


def appended(chunks: DataFrame, more: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks with the payloads of more (file, content) at the end: a short last chunk is filled up first."""
    last = chunks.groupBy("file").agg(F.max(F.struct("chunk_id", "chunk_start", "payload")).alias("l"))
    tail = more.join(last, "file", "left").select("file", F.col("l"), F.concat(F.coalesce("l.payload", F.lit(b"").cast("binary")), F.col("content")).alias("content"))
    base = tail.select("file", F.coalesce("l.chunk_id", F.lit(0)).alias("c0"), F.coalesce("l.chunk_start", F.lit(0)).alias("s0"))
    new = chunks_of(tail, "file", "content", size).join(base, "file").select("file", (F.col("chunk_id") + F.col("c0")).alias("chunk_id"), (F.col("chunk_start") + F.col("s0")).alias("chunk_start"), "payload")
    kept = chunks.join(new.select("file", "chunk_id"), ["file", "chunk_id"], "left_anti")
    return kept.select("file", "chunk_id", "chunk_start", "payload").unionByName(new)


def delta(old: DataFrame, new: DataFrame, file: str, data: str, size: int = DIFF) -> DataFrame:
    """(file, start, original_len, payload, new_size): what turns old payloads into new ones.

    Blocks are compared by a full outer join on (file, block) and neighbours that changed become
    one patch; a new payload that is shorter gives its size, so blocks beyond it need no patch.
    """
    side = lambda df, n: chunks_of(df, file, data, size).select("file", "chunk_id", F.col("payload").alias(n))
    both = side(old, "a").join(side(new, "b"), ["file", "chunk_id"], "full")
    w = Window.partitionBy("file").orderBy("chunk_id")
    changed = both.filter(F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).withColumn("island", F.col("chunk_id") - F.row_number().over(w))
    runs = changed.groupBy("file", "island").agg(F.min("chunk_id").alias("first"), F.sum(F.coalesce(F.octet_length("a"), F.lit(0))).alias("original_len"), F.array_sort(F.collect_list(F.struct("chunk_id", "b"))).alias("bs"))
    sizes = new.select(F.col(file).alias("file"), F.octet_length(data).cast("long").alias("new_size"))
    payload = F.aggregate("bs", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["b"]))
    return runs.join(sizes, "file").select("file", (F.col("first") * size).cast("long").alias("start"), F.col("original_len").cast("long").alias("original_len"), payload.alias("payload"), "new_size")


def apply_delta(old: DataFrame, patches: DataFrame, sizes: DataFrame, file: str, data: str, size: int = DIFF) -> DataFrame:
    """(file, content): old payloads at their new sizes (file, new_size) with the patches written over them."""
    cut = chunks_of(patches.withColumn("key", F.struct("file", "start")), "key", "payload", size)
    new = cut.select(F.col("file.file").alias("file"), ((F.col("file.start") + F.col("chunk_start")) / size).cast("long").alias("chunk_id"), F.col("payload").alias("new"))
    own = chunks_of(old, file, data, size).select("file", "chunk_id", "payload")
    both = own.join(new, ["file", "chunk_id"], "full").select("file", "chunk_id", (F.col("chunk_id") * size).alias("chunk_start"), F.coalesce("new", "payload").alias("payload"))
    left = F.greatest(F.lit(0), F.least(F.octet_length("payload"), F.col("new_size") - F.col("chunk_start"))).cast("int")
    clipped = both.join(sizes.select("file", "new_size"), "file").withColumn("payload", F.substring(F.col("payload"), F.lit(1), left)).filter(F.octet_length("payload") > 0)
    whole = joined(clipped.select("file", "chunk_start", "payload"))
    return sizes.select("file").join(whole, "file", "left").select("file", F.coalesce("content", F.lit(b"").cast("binary")).alias("content"))
