"""The routing table: a fold over route and session events, in batch; one shuffle on the route's key.

Rules: of each (key, mui) the last event holds. A withdrawal never makes a row; it keeps the last announced attributes
(``retain``) or empties them. ``peer_down`` marks all routes of a mui withdrawn, ``peer_down_family`` those of one
family and store; the first announcement of the mui (or the family) after that deletes what is older. For FlowSpec, an
announcement deletes only its own family's older rules. ``peer_remove`` and ``reappeared`` delete all that is older.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.schema import DOWNS, FLOWSPEC, KEY

_FAMILY = ["mui", "afi", "safi"]


def session_marks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each mui, and each (mui, afi, safi): ``erase`` (what is older goes) and ``down`` (what is older is withdrawn).

    A row for each peer and family: combined before the shuffle, and as few as there are peers.
    """
    flow = F.col("safi") == FLOWSPEC
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("seq"))
    marks = events.where(F.col("kind").isin(*DOWNS)).select("seq", "kind", "mui", "afi", "safi")
    last = events.where(F.col("kind") == "announce").groupBy(*_FAMILY).agg(F.max("seq").alias("last"))
    last_all = last.where(F.col("safi") != FLOWSPEC).groupBy("mui").agg(F.max("last").alias("last_all"))
    whole = marks.where(F.col("kind") != "peer_down_family").join(last_all, "mui", "left").groupBy("mui").agg(
        F.max(at("peer_remove", "reappeared")).alias("gone"),
        F.max(F.when((F.col("kind") == "peer_down") & (F.col("seq") < F.col("last_all")), F.col("seq"))).alias("reset"),
        F.max(at("peer_down")).alias("down"),
    )
    # FlowSpec resets by family; so do family downs
    downs = marks.where(F.col("kind") == "peer_down").select("mui", F.col("seq").alias("d"))
    flows = last.where(flow).join(downs, "mui").where("d < last").groupBy(*_FAMILY).agg(F.max("d").alias("f_reset"))
    family = marks.where(F.col("kind") == "peer_down_family").join(last, _FAMILY, "left").groupBy(*_FAMILY).agg(F.max(F.when(F.col("seq") < F.col("last"), F.col("seq"))).alias("f_reset"), F.max("seq").alias("f_down"))
    family = family.unionByName(flows.withColumn("f_down", F.lit(None).cast("long"))).groupBy(*_FAMILY).agg(F.max("f_reset").alias("f_reset"), F.max("f_down").alias("f_down"))
    return whole, family


def surviving(events: DataFrame) -> DataFrame:
    """The announcements and withdrawals that no later session event deletes, with ``session_down``: the last down that holds for them."""
    whole, family = session_marks(events)
    routes = events.where(F.col("kind").isin("announce", "withdraw")).join(whole, "mui", "left").join(family, _FAMILY, "left")
    none = F.lit(-(1 << 63))
    erase = F.greatest(F.coalesce("gone", none), F.coalesce("f_reset", none), F.when(F.col("safi") == FLOWSPEC, none).otherwise(F.coalesce("reset", none)))
    return routes.where(F.col("seq") > erase).withColumn("session_down", F.greatest("down", "f_down")).drop("gone", "reset", "down", "f_reset", "f_down")


def fold(events: DataFrame, retain: bool = True, sessions: bool = True) -> DataFrame:
    """The table after all of ``events``: KEY, mui, seq (of the last event), status, attrs. ``sessions=False`` skips session events (none are there)."""
    routes = surviving(events) if sessions else events.where(F.col("kind").isin("announce", "withdraw")).withColumn("session_down", F.lit(None).cast("long"))
    announced = F.col("kind") == "announce"
    state = routes.groupBy(*KEY, "mui").agg(
        F.max("seq").alias("seq"),
        F.max(F.when(announced, F.col("seq"))).alias("held"),
        F.max("session_down").alias("session_down"),
        F.max_by("attrs", F.when(announced, F.col("seq"))).alias("attrs"),
    )
    # the last event is an announcement if it is the last announcement; without the attributes, plain numbers are summed up by hash
    withdrawn = (F.col("held") < F.col("seq")) | F.coalesce(F.col("session_down") > F.col("seq"), F.lit(False))
    attrs = F.col("attrs") if retain else F.when(~withdrawn, F.col("attrs"))
    return state.where("held IS NOT NULL").select(*KEY, "mui", "seq", F.when(withdrawn, "withdrawn").otherwise("active").alias("status"), attrs.alias("attrs"))


def compact(events: DataFrame) -> DataFrame:
    """The least of ``events`` that folds, with any later events, to the same: what a stream keeps between batches."""
    rib_rows = surviving(events).drop("session_down")
    by = Window.partitionBy(*KEY, "mui")
    last = F.max("seq").over(by)
    held = F.max(F.when(F.col("kind") == "announce", F.col("seq"))).over(by)
    kept = rib_rows.withColumn("__last", last).withColumn("__held", held).where("__held IS NOT NULL AND (seq = __last OR seq = __held)").drop("__last", "__held")
    downs = events.where(F.col("kind").isin("peer_down", "peer_down_family"))
    scope = Window.partitionBy("kind", "mui", F.when(F.col("kind") == "peer_down_family", F.struct("afi", "safi"))).orderBy(F.col("seq").desc())
    downs = downs.withColumn("__k", F.row_number().over(scope)).where("__k = 1").drop("__k")
    return kept.unionByName(downs)


def transitions(events: DataFrame) -> DataFrame:
    """For each announcement and withdrawal: what it changes in the mui's count of active routes (``delta``) and whether it is a duplicate.

    Not active to active counts 1, active to withdrawn -1, active to active is a duplicate. A route that a session event
    since its last event deleted or withdrew isn't active any more.
    """
    by = Window.partitionBy(*KEY, "mui").orderBy("seq")
    routes = events.where(F.col("kind").isin("announce", "withdraw")).select(*KEY, "mui", "seq", "kind").withColumn("p_kind", F.lag("kind").over(by)).withColumn("p_seq", F.lag("seq").over(by))
    # a row of session events for each mui, as few as there are sessions; Catalyst sends it to all tasks if it is small
    family = lambda c: F.when(F.col("kind") == "peer_down_family", F.col(c))
    downs = events.where(F.col("kind").isin(*DOWNS)).groupBy("mui").agg(F.collect_list(F.struct("seq", family("afi").alias("afi"), family("safi").alias("safi"))).alias("downs"))
    marks = routes.join(downs, "mui", "left")
    between = lambda d: (d["seq"] > F.col("p_seq")) & (d["seq"] < F.col("seq")) & (d["afi"].isNull() | ((d["afi"] == F.col("afi")) & (d["safi"] == F.col("safi"))))
    was = F.coalesce(F.col("p_kind") == "announce", F.lit(False)) & ~F.coalesce(F.exists("downs", between), F.lit(False))
    now = F.col("kind") == "announce"
    out = marks.withColumn("delta", F.when(now & ~was, 1).when(~now & was, -1).otherwise(0)).withColumn("duplicate", now & was)
    return out.select(*KEY, "mui", "seq", "kind", "delta", "duplicate")


def first_sights(events: DataFrame) -> DataFrame:
    """For each announcement, whether it is the first of its prefix, and of its (prefix, mui)."""
    prefix, both = Window.partitionBy("safi", "afi", "plen", "p_hi", "p_lo"), Window.partitionBy(*KEY, "mui")
    rows = events.where(F.col("kind") == "announce")
    return rows.withColumn("prefix_new", F.col("seq") == F.min("seq").over(prefix)).withColumn("mui_new", F.col("seq") == F.min("seq").over(both)).select(*KEY, "mui", "seq", "prefix_new", "mui_new")
