"""What a plan does: whether filters reach the scan, how often rows are dealt anew."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan as it is before it runs."""
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single|round|Single|Round)", physical(df)))


def pushed(df: DataFrame) -> list[str]:
    """Filters that the scans were given."""
    return [f for part in re.findall(r"PushedFilters: \[(.*?)\](?:, |$)", physical(df), re.M) for f in part.split(", ") if f]


def python_nodes(df: DataFrame) -> list[str]:
    return re.findall(r"(?:MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroups\w+)", physical(df))
