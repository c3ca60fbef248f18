"""The register of route sources: lookups of existing entries, merges of updates, trees, and reclaiming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(ingresses: DataFrame) -> DataFrame:
    """id and its session: a path child's is its parent."""
    return ingresses.select("id", F.when(F.col("ingress_type") == "bgpPath", F.col("parent_ingress")).otherwise(F.col("id")).alias("session"))


def find_existing(candidates: DataFrame, ingresses: DataFrame, key: str, equal: tuple[str, ...], null_safe: tuple[str, ...] = (), connected: bool = False) -> DataFrame:
    """``key`` of each candidate and ``existing``: the least id that agrees in ``equal`` (null never does) and ``null_safe`` (null with null).

    Connected entries can't be taken over unless ``connected``.
    """
    rows = ingresses if connected else ingresses.where("state IS NULL OR state <> 'Connected'")
    own = rows.select(F.col("id").alias("existing"), *(F.col(c).alias(f"_{c}") for c in (*equal, *null_safe)))
    on = F.lit(True)
    for c in equal:
        on &= candidates[c] == own[f"_{c}"]
    for c in null_safe:
        on &= candidates[c].eqNullSafe(own[f"_{c}"])
    return candidates.join(own, on, "left").groupBy(key).agg(F.min("existing").alias("existing"))


def merged(updates: DataFrame) -> DataFrame:
    """The register after ``updates`` (id, seq, fields): of each field the last value that isn't null."""
    fields = [c for c in updates.columns if c not in ("id", "seq")]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"]
    return updates.groupBy("id").agg(*(last(c).alias(c) for c in fields))


def routers(ingresses: DataFrame) -> DataFrame:
    """BMP routers and the number of their peers."""
    n = ingresses.where("ingress_type = 'bgpViaBmp'").groupBy(F.col("parent_ingress").alias("id")).agg(F.count("*").alias("peers"))
    return ingresses.where("ingress_type = 'bmp'").select("id", "name").join(n, "id", "left").select("id", "name", F.coalesce("peers", F.lit(0)).alias("peers"))


def tree(ingresses: DataFrame) -> DataFrame:
    """router, remote_asn, remote_addr and the peer's views, by RIB type."""
    peers = ingresses.where("ingress_type = 'bgpViaBmp'")
    view = F.struct("peer_rib_type", "id", "state")
    return peers.groupBy(F.col("parent_ingress").alias("router"), "remote_asn", "remote_addr").agg(F.array_sort(F.collect_list(view)).alias("views"))


def neighbors(peers: DataFrame, counts: DataFrame) -> DataFrame:
    """``peers`` with what ``counts`` (mui, …) knows of them; unknown counts stay null."""
    return peers.join(counts.withColumnRenamed("mui", "id"), "id", "left")


def summary(ingresses: DataFrame) -> DataFrame:
    """One row: entries by state and type."""
    n = lambda c: F.count(F.when(c, 1))
    state, kind = F.col("state"), F.col("ingress_type")
    return ingresses.agg(
        F.count("*").alias("total"), n(state == "Connected").alias("connected"), n(state == "Disconnected").alias("disconnected"), n(state == "NonNetwork").alias("non_network"),
        n(state.isNull()).alias("unset"), n(kind == "bgpViaBmp").alias("bgp_via_bmp"), n(kind == "bgpPath").alias("bgp_path"),
    )


def reclaimable(ingresses: DataFrame) -> DataFrame:
    """id of disconnected path children, and of disconnected BMP peers and routers that no entry has as parent."""
    used = ingresses.where("parent_ingress IS NOT NULL").select(F.col("parent_ingress").alias("id")).distinct()
    gone = ingresses.where("state = 'Disconnected'")
    return gone.where("ingress_type = 'bgpPath'").select("id").unionByName(gone.where("ingress_type IN ('bgpViaBmp', 'bmp')").select("id").join(used, "id", "left_anti"))


def reclaimed(before: DataFrame, now: DataFrame) -> DataFrame:
    """What was due at the sweep before and still is."""
    return before.select("id").intersect(now.select("id"))


def down_fan_out(downs: DataFrame, ingresses: DataFrame) -> DataFrame:
    """The muis that a peer's or router's down withdraws: itself, the other views of its peer (same parent, address and ASN), and all their path children."""
    info = ingresses.select("id", "parent_ingress", "remote_addr", "remote_asn", "ingress_type")
    hit = downs.select(F.col("mui").alias("id"), "seq").join(info, "id", "left")
    views = info.where("ingress_type = 'bgpViaBmp'").select(F.col("id").alias("v"), F.col("parent_ingress").alias("p"), F.col("remote_addr").alias("a"), F.col("remote_asn").alias("n"))
    siblings = hit.where("ingress_type = 'bgpViaBmp'").join(views, F.expr("parent_ingress = p AND remote_addr = a AND remote_asn = n")).select(F.col("v").alias("mui"), "seq")
    peers = hit.where("ingress_type = 'bmp'").join(views, F.col("id") == F.col("p")).select(F.col("v").alias("mui"), "seq")
    first = hit.select(F.col("id").alias("mui"), "seq").unionByName(siblings).unionByName(peers).distinct()
    children = info.where("ingress_type = 'bgpPath'").select(F.col("id").alias("c"), F.col("parent_ingress").alias("p"))
    return first.unionByName(first.join(children, F.col("mui") == F.col("p")).select(F.col("c").alias("mui"), "seq")).distinct()


def first_listed(addresses: DataFrame, listed: list[str]) -> DataFrame:
    """``addresses`` (id, BITS) and the first entry of ``listed`` that holds each: exact addresses before prefixes, then by text. A few entries: one condition each."""
    from prefixlake.functions.prefix import literal, more_specific, same_prefix

    order = sorted(listed, key=lambda x: ("/" in x, x))
    out = F.lit(None).cast("string")
    for entry in reversed(order):
        afi, plen, _, _ = literal(entry)
        hit = same_prefix(entry) if plen == (32 if afi == 1 else 128) else same_prefix(entry) | more_specific(entry)
        out = F.when(hit, entry).otherwise(out)
    return addresses.withColumn("entry", out)
