"""Substring search, count, lookup and ranges over an archive.

A search asks the index first, so that only blocks that can match are read. Blocks are few
beside lines: up to ``LISTED`` candidates become a list in the filter, which prunes files, row
groups and pages by their extremes; more are a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import grams_of, may_contain

LISTED = 1_000


def candidates(blocks: DataFrame, term: str) -> DataFrame:
    """Ids of the blocks that can have a line with the term; all blocks for a term without a run of three."""
    return blocks.filter(may_contain(term)).select("block_id")


def pruned(lines: DataFrame, blocks: DataFrame, term: str) -> DataFrame:
    """The lines of candidate blocks."""
    if not grams_of(term):
        return lines
    found = candidates(blocks, term)
    ids = [r[0] for r in found.limit(LISTED + 1).collect()]
    if len(ids) > LISTED:
        return lines.join(found, "block_id", "left_semi")
    return lines.filter(f"block_id IN ({', '.join(map(str, ids)) or 'NULL'})")


def search(lines: DataFrame, blocks: DataFrame, term: str) -> DataFrame:
    """The lines that contain the term, case and all; an empty term is in every line."""
    return pruned(lines, blocks, term).filter(F.contains(F.col("line"), F.lit(term)))


def search_bytes(lines: DataFrame, blocks: DataFrame, term: bytes) -> DataFrame:
    """As search, with the line as bytes."""
    found = pruned(lines, blocks, term.decode("utf-8", "ignore")) if term.isascii() else lines
    return found.withColumn("line", F.col("line").cast("binary")).filter(F.contains(F.col("line"), F.lit(bytearray(term))))


def count_matches(lines: DataFrame, blocks: DataFrame, term: str) -> DataFrame:
    """How many lines contain the term."""
    return search(lines, blocks, term).agg(F.count("*").alias("n_lines"))


def first_matches(lines: DataFrame, blocks: DataFrame, term: str, n: int = 100) -> DataFrame:
    """The first n matching lines; sorted by tasks, merged by TakeOrderedAndProject."""
    return search(lines, blocks, term).orderBy("line_no").limit(n)


def limited(lines: DataFrame, blocks: DataFrame, term: str, n: int = 100) -> DataFrame:
    """(shown, further): how many matches a search limited to n shows, and how many more there are."""
    hits = count_matches(lines, blocks, term)
    return hits.select(F.least("n_lines", F.lit(n)).cast("long").alias("shown"), F.greatest(F.col("n_lines") - n, F.lit(0)).cast("long").alias("further"))


def highlighted(line: Column, term: str, before: str = "[", after: str = "]") -> Column:
    """The line with its first occurrence of the term marked."""
    if not term:
        return line
    at = F.instr(line, F.lit(term))
    marked = F.concat(F.substring(line, F.lit(1), at - 1), F.lit(before + term + after), F.substring(line, at + len(term), F.length(line)))
    return F.when(at > 0, marked).otherwise(line)


def get_row(lines: DataFrame, line_no: int, block_id: int) -> DataFrame:
    """One line by its number; its block prunes the scan."""
    return lines.filter((F.col("block_id") == block_id) & (F.col("line_no") == line_no))


def get_rows(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last."""
    return lines.filter(F.col("line_no").between(first, last))


def block_scan(lines: DataFrame, block_id: int) -> DataFrame:
    return lines.filter(F.col("block_id") == block_id)


def reconstruct(lines: DataFrame, by: str) -> DataFrame:
    """The text of each document or block: its lines in order, joined by newlines."""
    whole = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return whole.select(by, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
