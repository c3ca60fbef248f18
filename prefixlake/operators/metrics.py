"""Metric families as rows (name, label, value): one aggregate over what is counted, unpivoted; counts combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, label: Column, *names: str) -> DataFrame:
    """A row for each of the columns ``names``, under ``label``."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names))
    return df.select(label.cast("string").alias("label"), F.explode(pairs).alias("m")).select("m.name", "label", "m.value")


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def gate(events: DataFrame) -> DataFrame:
    """Updates that a unit passed on, and the last one's number."""
    one = events.agg(F.count("*").alias("num_updates"), F.max("seq").alias("last_update"))
    return _rows(one, F.lit("all"), "num_updates", "last_update")


def bmp_in(events: DataFrame, ingresses: DataFrame) -> DataFrame:
    """Of each router: its peers' announcements, withdrawals, ups and downs, and how many of its peers are connected."""
    kind = F.col("kind")
    per = events.groupBy("mui").agg(_n(kind == "announce").alias("announcements"), _n(kind == "withdraw").alias("withdrawals"), _n(kind.isin("peer_up", "reappeared")).alias("peer_ups"), _n(kind.isin("peer_down", "peer_remove")).alias("peer_downs"))
    peers = ingresses.where("ingress_type = 'bgpViaBmp'").select(F.col("id").alias("mui"), "parent_ingress", "state")
    names = ("announcements", "withdrawals", "peer_ups", "peer_downs")
    total = peers.join(per, "mui", "left").groupBy("parent_ingress").agg(_n(F.col("state") == "Connected").alias("peers_connected"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return _rows(total, F.col("parent_ingress"), "peers_connected", *names)


def rib(table: DataFrame) -> DataFrame:
    """Of each store and family: items, how many are withdrawn, and unique prefixes."""
    per = table.groupBy("safi", "afi", "plen", "p_hi", "p_lo").agg(F.count("*").alias("n"), _n(F.col("status") == "withdrawn").alias("w"))
    total = per.groupBy("safi", "afi").agg(F.sum("n").alias("items"), F.sum("w").alias("withdrawn"), F.count("*").alias("unique_prefixes"))
    return _rows(total, F.concat_ws("/", F.col("afi").cast("string"), F.col("safi").cast("string")), "items", "withdrawn", "unique_prefixes")


def bgp_in(changes: DataFrame) -> DataFrame:
    """Of each peer (peer, state): sessions that were established, and that were lost."""
    total = changes.groupBy("peer").agg(_n(F.col("state") == "Established").alias("connections"), _n(F.col("state") != "Established").alias("disconnects"))
    return _rows(total, F.col("peer"), "connections", "disconnects")


def rtr(deltas: DataFrame, held: DataFrame) -> DataFrame:
    """Of each family: VRPs announced, withdrawn, and held."""
    action = F.col("action")
    seen = deltas.groupBy("afi").agg(_n(action == "announce").alias("announced"), _n(action == "withdraw").alias("withdrawn"))
    now = held.groupBy("afi").agg(F.count("*").alias("held"))
    return _rows(seen.join(now, "afi", "left").na.fill(0, ["held"]), F.col("afi"), "announced", "withdrawn", "held")


def broker(records: DataFrame) -> DataFrame:
    """Of each topic: records published."""
    return _rows(records.groupBy("topic").agg(F.count("*").alias("published")), F.col("topic"), "published")
