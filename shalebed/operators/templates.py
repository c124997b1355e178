"""Log templates: typed variables by one alternation, tried in this order at every place.

Quantifiers are possessive and the alternatives ordered, so that the leftmost match is the one
that a scanner without backtracking takes. The pattern means the same in Java and in Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OCTET = r"(?:25[0-5]|2[0-4]\d|[01]\d\d|\d\d(?!\d)|\d(?!\d))"
#: The variable types and what they look like.
TYPES = {
    "Timestamp": r"\d{6} \d{6}(?!\d)|\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?!\d)",
    "Uuid": r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9-])",
    "IpAddress": rf"(?:{OCTET}\.){{3}}{OCTET}(?![\d.])",
    "Hex": r"0[xX][0-9a-fA-F]++(?![A-Za-z0-9])|(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}+(?![A-Za-z0-9])",
    "Number": r"(?:(?<![A-Za-z0-9])-)?+\d++(?:\.\d++)?+(?:[eE][+-]?\d++)?+(?![A-Za-z0-9])",
    "Path": r"/[A-Za-z0-9._][A-Za-z0-9/._-]{2,}+|[A-Za-z]:\\[A-Za-z0-9\\/._-]{2,}+",
}
VARIABLE = "|".join(f"(?:{p})" for p in TYPES.values())
NAMED = re.compile("|".join(f"(?P<{k}>{p})" for k, p in TYPES.items()), re.ASCII)
FOUND = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SLOT, MOST_VARIABLES, MOST_BYTES = "<*>", 16, 65_535


def literal(line: Column) -> Column:
    """Whether a line is too long or has too many variables to be cut up."""
    return (F.regexp_count(line, F.lit(VARIABLE)) > MOST_VARIABLES) | (F.octet_length(line) > MOST_BYTES)


#: What a line without any variable doesn't have.
HINT = r"[0-9/\\]|[a-fA-F]{8}"


def template_of(line: Column, cut: Column) -> Column:
    """The line with a slot for each variable, given what the pattern makes of it."""
    slots = (F.length(cut) - F.length(F.replace(cut, F.lit(SLOT), F.lit("")))) / len(SLOT)
    return F.when(cut.isNull() | (slots > MOST_VARIABLES), line).otherwise(cut)


def values_of(line: Column) -> Column:
    """The variables of a line, in order."""
    return F.when(literal(line), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(line, F.lit(VARIABLE), F.lit(0)))


@F.pandas_udf(T.ArrayType(FOUND))
def variables(lines: pd.Series) -> pd.Series:
    """The variables with their types and places, in characters."""

    def one(line: str | None) -> list[dict] | None:
        if line is None:
            return None
        found = list(NAMED.finditer(line))
        if len(found) > MOST_VARIABLES or len(line.encode()) > MOST_BYTES:
            return []
        kind = lambda m: m.lastgroup if m.lastgroup != "Number" else "Float" if set(m[0]) & set(".eE") else "Integer"
        return [{"type": kind(m), "value": m[0], "start": m.start(), "end": m.end()} for m in found]

    return lines.map(one)


def rebuild(template: Column, values: Column) -> Column:
    """The line that a template and its variables make; a line that holds the slot's text itself isn't cut up by mine."""
    parts = F.split(template, re.escape(SLOT), -1)
    return F.aggregate(F.sequence(F.lit(1), F.size(values)), F.element_at(parts, 1), lambda s, i: F.concat(s, F.element_at(values, i), F.element_at(parts, i + 1)))


def cut_up(lines: DataFrame) -> DataFrame:
    """Adds template: one pass of the pattern, over lines that can have a variable; lines with the slot's own text stay literal."""
    line = F.col("line")
    plain = ~F.rlike(line, F.lit(HINT)) | (F.octet_length(line) > MOST_BYTES) | F.contains(line, F.lit(SLOT))
    own = lines.withColumn("_cut", F.when(~plain, F.regexp_replace(line, VARIABLE, SLOT)))
    return own.withColumn("template", template_of(line, F.col("_cut"))).drop("_cut")


def encoded(lines: DataFrame) -> DataFrame:
    """Adds template and vars."""
    own = F.contains(F.col("line"), F.lit(SLOT))
    return cut_up(lines).withColumn("vars", F.when(own, F.array().cast("array<string>")).otherwise(values_of(F.col("line"))))


def decoded(rows: DataFrame) -> DataFrame:
    """line back from template and vars."""
    return rows.withColumn("line", F.when(F.size("vars") == 0, F.col("template")).otherwise(rebuild(F.col("template"), F.col("vars"))))


def mine(lines: DataFrame) -> DataFrame:
    """(template, n, first_line): how often each template occurs."""
    return cut_up(lines).groupBy("template").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def dictionary(lines: DataFrame) -> DataFrame:
    """(block_id, template_id, template, n): each block's templates, numbered by first appearance, keyed by their text."""
    each = cut_up(lines).groupBy("block_id", "template").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    number = F.row_number().over(Window.partitionBy("block_id").orderBy("first")) - 1
    return each.select("block_id", number.cast("long").alias("template_id"), "template", "n")


def parse_timestamp_ms(text: Column) -> Column:
    """Milliseconds since 1970 of ``yymmdd hhmmss`` (yy below 70: 20yy), an ISO time with a space, or an epoch of 10 to 13 digits; else null."""
    compact = F.regexp_extract(text, r"^(\d{6} \d{6})", 1)
    century = F.when(F.substring(compact, 1, 2) < "70", "20").otherwise("19")
    iso = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    digits = F.regexp_extract(text, r"^(\d{10,13})(?!\d)", 1)
    number = F.try_to_number(F.when(digits != "", digits), F.lit("9999999999999")).cast("long")
    # times without a zone are in UTC, whatever the session's zone is
    ms = lambda t, fmt: F.unix_millis(F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(fmt + " xx")))
    return (
        F.when(compact != "", ms(F.concat(century, compact), "yyyyMMdd HHmmss"))
        .when(iso != "", ms(iso, "yyyy-MM-dd HH:mm:ss"))
        .when(digits != "", F.when(number < 1_000_000_000_000, number * 1000).otherwise(number))
    )
