"""Route origin validation: routes against VRPs by a containment join, and what changes when VRPs do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.attributes import origin_asn
from prefixlake.functions.prefix import BITS, as_wide, covers
from prefixlake.schema import UNICAST
from prefixlake.sources.stored import stored


def fold_vrps(deltas: DataFrame) -> DataFrame:
    """The VRPs that hold after ``deltas`` (seq, action announce/withdraw/reset, BITS, asn, max_len): the last action of each; a reset drops all before it.

    A missing max_len is the prefix length.
    """
    rows = deltas.withColumn("max_len", F.coalesce("max_len", "plen"))
    reset = rows.where("action = 'reset'").agg(F.max("seq").alias("reset"))  # one row
    last = rows.where("action <> 'reset'").groupBy(*BITS, "asn", "max_len").agg(F.max(F.struct("seq", "action")).alias("last"))
    return last.join(F.broadcast(reset), F.expr("reset IS NULL OR last.seq > reset")).where("last.action = 'announce'").select(*BITS, "asn", "max_len")


def validity(prefixes: DataFrame, vrps: DataFrame) -> DataFrame:
    """BITS, origin, rov of each distinct (prefix, origin) of ``prefixes``: valid, invalid or notFound; notChecked without an origin.

    Only distinct pairs meet the VRPs, so a prefix that thousands of peers announce is checked once.
    """
    pairs = stored(prefixes.where("origin IS NOT NULL").select(*BITS, "origin").distinct())
    wide = as_wide(vrps, "asn", F.coalesce("max_len", "plen").alias("max_len"))
    met = covers(wide, pairs)
    found = met.groupBy(*BITS, "origin").agg(F.max(F.when((F.col("asn") == F.col("origin")) & (F.col("plen") <= F.col("max_len")), 1).otherwise(0)).alias("ok"))
    return pairs.join(found, [*BITS, "origin"], "left").select(*BITS, "origin", F.when(F.col("ok") == 1, "valid").when(F.col("ok") == 0, "invalid").otherwise("notFound").alias("rov"))


def with_rov(rib: DataFrame, vrps: DataFrame) -> DataFrame:
    """``rib`` and its status ``rov``; only unicast routes with an origin are checked. ``rib`` is stored, as it is used twice: select what is needed."""
    rows = stored(rib).withColumn("origin", F.when(F.col("safi") == UNICAST, origin_asn(F.col("attrs"))))
    state = validity(rows.where("origin IS NOT NULL"), vrps)
    return rows.join(state, [*BITS, "origin"], "left").withColumn("rov", F.coalesce("rov", F.lit("notChecked"))).drop("origin")


def revalidate(rib: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The routes at or under a VRP that differs between ``before`` and ``after``: previous, current, has_changed.

    As many rows as routes are affected, unchanged ones too.
    """
    names = [*BITS, "asn", "max_len"]
    delta = before.select(names).exceptAll(after.select(names)).unionByName(after.select(names).exceptAll(before.select(names)))
    rows = rib.where((F.col("safi") == UNICAST) & (F.col("status") == "active")).select(*BITS, "mui", origin_asn(F.col("attrs")).alias("origin")).where("origin IS NOT NULL")
    rows = stored(rows)
    touched = stored(covers(as_wide(stored(delta)).distinct(), rows.select(*BITS, "origin").distinct()).select(*BITS, "origin").distinct())
    state = validity(touched, before).withColumnRenamed("rov", "previous").join(validity(touched, after).withColumnRenamed("rov", "current"), [*BITS, "origin"])
    return rows.join(state, [*BITS, "origin"]).select(*BITS, "mui", "origin", "previous", "current", (F.col("previous") != F.col("current")).alias("has_changed"))


def vrp_history(deltas: DataFrame) -> DataFrame:
    """Each VRP event with the action before it on the same (prefix, asn, max_len): repeats and unknown withdrawals stand out."""
    by = Window.partitionBy(*BITS, "asn", "max_len").orderBy("seq")
    rows = deltas.withColumn("max_len", F.coalesce("max_len", "plen")).withColumn("before", F.lag("action").over(by))
    return rows.withColumn("effect", F.when(F.col("action") == F.coalesce("before", F.lit("withdraw")), F.when(F.col("action") == "withdraw", "unknown").otherwise("duplicate")).otherwise("changed"))


def accepted_deltas(deltas: DataFrame, verdict) -> DataFrame:
    """VRP events and whether they start a revalidation: all of them change the VRPs, those that ``verdict`` rejects nothing more."""
    return deltas.withColumn("revalidates", F.coalesce(verdict, F.lit(True)))


def fmt_vrp(action, prefix, asn):
    return F.concat(F.when(action == "withdraw", "withdraw").otherwise("announce"), F.lit(" VRP "), prefix, F.lit(" from AS"), asn.cast("string"))
