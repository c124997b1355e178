"""Chat formatting with cumulative-snapshot collapse.

Loggers write a conversation again whenever it grows. A rolling hash over the turns gives
every turn-prefix of every conversation an id; a conversation whose whole hash is the hash of
a shorter prefix of another one is a snapshot of it and goes by an anti-join. Of conversations
with the same turns the one with the smallest id stays. The rest is rendered.

Defined results: turns are ordered by (turn, role, text), null first; a repeated turn row
counts once; null role and text count as empty; each row without conv_id is a conversation of
one turn; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .words import content_key

BEGIN, END = "<|turn_start|>", "<|turn_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """The distinct turn rows, with null role and text as empty; key names the conversation."""
    c = F.col
    rows = conversations.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), F.coalesce(c("role").cast("string"), F.lit("")).alias("role"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    alone = F.concat_ws(" ", F.lit("row"), *(F.hex(k) for k in content_key(c("turn"), c("role"), c("text"))))
    return rows.distinct().withColumn("key", F.coalesce(c("conv_id").cast("string"), alone))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rolling, n = object(), xxhash.xxh3_128(), 0
    for batch in batches:
        ids, hashes, counts = batch.column("key").to_pylist(), [], []
        for conv, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if conv != now:
                now, rolling, n = conv, xxhash.xxh3_128(), 0
            for part in (role.encode(), text.encode()):
                rolling.update(len(part).to_bytes(8, "little"))
                rolling.update(part)
            n += 1
            hashes.append(rolling.digest())
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), batch.column("conv_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary())], ["key", "conv_id", "n", "prefix"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(key, conv_id, n, prefix): the rolling hash after each turn; a conversation is streamed turn by turn."""
    dealt = turns.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return dealt.select("key", "conv_id", "role", "text").mapInArrow(_prefixes, "key string, conv_id long, n long, prefix binary")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(key, conv_id, n_turns) of the conversations that aren't a snapshot or a repetition of another one."""
    whole = prefixes.groupBy("key").agg(F.max(F.struct("n", "prefix")).alias("w"), F.first("conv_id").alias("conv_id")).select("key", "conv_id", "w.n", "w.prefix")
    first = whole.groupBy("prefix", "n").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("f")).select("prefix", "n", "f.conv_id", "f.key")
    # a prefix that some conversation goes beyond: its rows less those that end with it
    seen = prefixes.groupBy("prefix", "n").agg(F.count("*").alias("rows"))
    ended = whole.groupBy("prefix", "n").agg(F.count("*").alias("ends"))
    longer = seen.join(ended, ["prefix", "n"]).filter(F.col("rows") > F.col("ends")).select("prefix", "n")
    return first.join(longer, ["prefix", "n"], "left_anti").select("key", "conv_id", F.col("n").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of every maximal conversation; prefixes are stored once, as four passes read them."""
    turns = turns_of(conversations)
    kept = stored(maximal(stored(prefixes(turns), "prefixes")), "maximal")
    own = turns.join(kept.select("key", "n_turns"), "key")
    texts = own.groupBy("key", "conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "\n")
    return texts.select("conv_id", "n_turns", text.alias("text"))
