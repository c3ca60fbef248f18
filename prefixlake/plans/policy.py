"""Policies: named predicates on attributes or events, as columns, and verdicts over events with their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions import attributes as A

POLICIES: dict[str, Callable[[Column], Column]] = {}


def policy(name: str):
    """Registers a function from the attributes' column to a boolean column under ``name``."""

    def put(f: Callable[[Column], Column]):
        POLICIES[name] = f
        return f

    return put


policy("hidden_hop")(A.hidden_hop)


@policy("origin_is_known")
def origin_is_known(attrs: Column) -> Column:
    return A.origin_asn(attrs).isNotNull()


@policy("no_export")
def no_export(attrs: Column) -> Column:
    return A.has_community(attrs, A.NO_EXPORT)


def accepted(events: DataFrame, verdict: Column) -> DataFrame:
    """What a filter lets into the fold: session events always, routes if the verdict is true."""
    return events.where(~F.col("kind").isin("announce", "withdraw") | F.coalesce(verdict, F.lit(False)))


def rejected_announcements(events: DataFrame, verdict: Column) -> DataFrame:
    """mui and the number of announcements (not withdrawals) that a filter keeps out."""
    return events.where((F.col("kind") == "announce") & ~F.coalesce(verdict, F.lit(False))).groupBy("mui").agg(F.count("*").alias("rejected"))


def logged(events: DataFrame, topic: str, when: Column, *values: Column) -> DataFrame:
    """Output records of a policy: a row for each event that ``when`` holds for."""
    return events.where(when).select(F.lit(topic).alias("topic"), "seq", "mui", *values)


def in_list(column: Column, values: list[int] | DataFrame, rows: DataFrame | None = None):
    """Membership in an ASN list: a condition for a literal list; for a table (asn), ``rows`` semi-joined."""
    if isinstance(values, DataFrame):
        return rows.join(values, column == values["asn"], "left_semi")
    return F.coalesce(column.isin(values), F.lit(False))


def counters(increments: DataFrame) -> DataFrame:
    """name, kind, value of user metrics: counters sum up (0 is ignored), gauges keep the last by seq."""
    sums = increments.where("kind = 'counter' AND value <> 0").groupBy("name").agg(F.sum("value").alias("value")).select("name", F.lit("counter").alias("kind"), "value")
    last = increments.where("kind = 'gauge'").groupBy("name").agg(F.max_by("value", "seq").alias("value")).select("name", F.lit("gauge").alias("kind"), "value")
    return sums.unionByName(last)
