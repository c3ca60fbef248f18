"""From messages to route events: one row for each prefix, families, and what a message counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Address families by their SAFI number.
SUPPORTED = {1: "unicast", 2: "multicast", 133: "flowspec"}
UNSUPPORTED = {4: "mplsUnicast", 65: "vpls", 70: "evpn", 128: "mplsVpn", 132: "routeTarget", 134: "flowspecVpn"}


def exploded(messages: DataFrame, *keep: str) -> DataFrame:
    """``keep``, kind, ord, nlri: a row for each entry of the arrays announced and withdrawn; announcements share the message's other columns."""
    arrays = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("list")) for k, c in (("announce", "announced"), ("withdraw", "withdrawn"))))
    return messages.select(*keep, F.explode(arrays).alias("g")).select(*keep, "g.kind", F.posexplode("g.list").alias("ord", "nlri"))


def family_of(afi: Column, safi: Column) -> Column:
    """``supported``, or the name of a family that is counted and dropped."""
    out = F.when(afi.isin(1, 2) & safi.isin(1, 133), "supported").when(afi.isin(1, 2) & safi.isin(*SUPPORTED), "supported")
    for number, name in UNSUPPORTED.items():
        out = out.when(safi == number, name)
    return out.otherwise("unknown")


def path_children(events: DataFrame) -> DataFrame:
    """``events`` (seq, mui, path_id, kind) and the child of (mui, path_id): numbered in each mui by first announcement.

    Withdrawals of a path id that the mui hasn't announced before are dropped; rows without a path id keep child null.
    """
    from pyspark.sql import Window

    first = events.where("path_id IS NOT NULL AND kind = 'announce'").groupBy("mui", "path_id").agg(F.min("seq").alias("first"))
    children = first.withColumn("child", F.row_number().over(Window.partitionBy("mui").orderBy("first")).cast("long"))
    return events.join(children, ["mui", "path_id"], "left").where("path_id IS NULL OR first <= seq").drop("first")


def counts(messages: DataFrame) -> DataFrame:
    """``messages`` and their numbers of announcements, withdrawals and hops."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return messages.withColumns({"announcements": n("announced"), "withdrawals": n("withdrawn")})


def log_counts(messages: DataFrame) -> DataFrame:
    """What a full log says of each message: hops of its path, and prefixes by how they are carried (conventional or multiprotocol, announced or withdrawn)."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    mp = lambda c, yes: F.filter(c, lambda x: (x["afi"] != 1) | (x["safi"] != 1) if yes else (x["afi"] == 1) & (x["safi"] == 1))
    return messages.withColumns({"as_path_hops": n("as_path"), "conventional_reach": n(mp("announced", False)), "mp_reach": n(mp("announced", True)), "conventional_unreach": n(mp("withdrawn", False)), "mp_unreach": n(mp("withdrawn", True))})


def bulk_kind(info: Column) -> Column:
    """What a bulk withdrawal of a session means: with the session's register entry the entry is gone, without it its routes are marked."""
    return F.when(info.isNotNull(), "peer_remove").otherwise("peer_down")
