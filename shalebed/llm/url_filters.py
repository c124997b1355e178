"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries: from a day on, a domain is blocked, allowed or no longer
listed. Entries become validity intervals, one for each stretch between two entries of a
domain. An as-of join evaluates every capture against the intervals active on the day of its
fetch: the capture's host and its parent domains meet the intervals by (domain, month) and
the day decides; of the domains that match, the longest one's entry holds.

Captures are reduced to distinct (host, day) before the join, so that a hot host is evaluated
once a day however many captures it has, and the month in the key bounds how many intervals
of a domain a capture meets.

Defined results: a null url, an url without a host and a capture without a day match nothing
and are kept; two entries of a domain on one day: the one with the larger seq holds, of equal
ones block before allow before remove; domains are compared in lower case; an empty list
keeps everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIST_SCHEMA = "domain string, action string, effective date, seq int"


def host_of(url: Column) -> Column:
    """The lower-case host of an url, null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def parents(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until): each entry holds from its day until the domain's next one; until may be null."""
    e = entries.select(F.lower("domain").alias("domain"), F.lower("action").alias("action"), "effective", "seq").filter("domain IS NOT NULL AND effective IS NOT NULL")
    last = Window.partitionBy("domain", "effective").orderBy(F.col("seq").desc_nulls_last(), F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2))
    own = e.withColumn("r", F.row_number().over(last)).filter("r = 1")
    until = F.lead("effective").over(Window.partitionBy("domain").orderBy("effective"))
    return own.select("domain", "action", F.col("effective").alias("since"), until.alias("until"))


def by_month(spans: DataFrame, horizon) -> DataFrame:
    """The listed intervals once for each month that they touch, up to the month of the last capture."""
    end = F.least(F.date_sub(F.coalesce("until", F.lit(horizon)), F.when(F.col("until").isNull(), 0).otherwise(1)), F.lit(horizon))
    listed = spans.filter("action IN ('block', 'allow')").withColumn("end", end).filter("since <= end")
    return listed.withColumn("month", F.explode(F.sequence(F.trunc("since", "month"), F.trunc("end", "month"), F.expr("INTERVAL 1 MONTH")))).drop("end")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched, matched (domain), action and blocked of every capture (page_id, url, fetched)."""
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched")).withColumn("host", host_of(F.col("url")))
    horizon = rows.agg(F.max("fetched")).first()[0]
    asked = rows.select("host", "fetched").filter("host IS NOT NULL AND fetched IS NOT NULL").distinct()
    near = asked.select("host", "fetched", F.trunc("fetched", "month").alias("month"), F.explode(parents(F.col("host"))).alias("domain"))
    active = near.join(by_month(intervals(entries), horizon), ["domain", "month"]).filter("since <= fetched AND (until IS NULL OR fetched < until)")
    verdict = active.groupBy("host", "fetched").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "action")).alias("v"))
    verdict = verdict.select("host", "fetched", F.col("v.domain").alias("matched"), F.col("v.action").alias("action"))
    # captures that match nothing for want of a host or a day stay out of the join, where they would be one hot key
    asks = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    met = rows.filter(asks).join(verdict, ["host", "fetched"], "left").select("page_id", "url", "host", "fetched", "matched", "action")
    none = rows.filter(~asks).select("page_id", "url", "host", "fetched", F.lit(None).cast("string").alias("matched"), F.lit(None).cast("string").alias("action"))
    return met.unionByName(none).withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))


#: The list that the query is run with: domains of the six listed kinds under the three
#: top-level domains of the test pages, each added, some taken off and added again in 2024.
KINDS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
TOPS = ("com", "net", "org")
DATED = (("block", "2024-01-15", 0), ("remove", "2024-05-01", 1), ("block", "2024-07-20", 2), ("allow", "2024-10-05", 3), ("block", "2024-11-11", 4))


def list_rows() -> list[tuple[str, str, str, int]]:
    """Kind k has the first 2 k mod 5 + 1 dated entries of DATED."""
    rows = [(f"{kind}.example.{top}", *entry) for k, kind in enumerate(KINDS) for top in TOPS for entry in DATED[: 2 * k % 5 + 1]]
    return [*rows, ("example.org", "allow", "2024-03-01", 0), ("m.ads-track.example.com", "allow", "2024-02-01", 0)]


def list_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{d}', '{a}', DATE '{day}', {seq})" for d, a, day, seq in list_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(domain, action, effective, seq)")
