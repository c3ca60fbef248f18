"""Searches of the routing table: prefix matches, includes and filters, all as DataFrame conditions that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions import attributes as A
from prefixlake.functions.prefix import BITS, as_wide, covers, less_specific, mask_hi, mask_lo, more_specific, same_prefix
from prefixlake.plans.policy import POLICIES
from prefixlake.schema import MULTICAST, UNICAST
from prefixlake.sources.stored import stored


@dataclass
class RouteQuery:
    """The parameters of a route search; all that are set must hold."""

    prefix: str | None = None
    include: tuple[str, ...] = ()
    ingress_id: int | None = None
    rib_type: str | None = None
    peer_asn: int | None = None
    peer_address: int | None = None
    rov_status: str | None = None
    otc: int | None = None
    community: int | None = None
    large_community: tuple[int, int, int] | None = None
    origin_asn: int | None = None
    policy: str | None = None
    safi: int = UNICAST
    withdrawn: bool = False
    fields: tuple[int, ...] | None = None

    FLOWSPEC_ONLY: tuple[str, ...] = field(default=("prefix", "include", "ingress_id", "safi", "withdrawn"), init=False, repr=False)

    def check(self) -> None:
        bad = set(self.include) - {"moreSpecifics", "lessSpecifics"}
        if bad:
            raise ValueError(f"unknown include: {', '.join(sorted(bad))}")
        if self.policy is not None and self.policy not in POLICIES:
            raise ValueError(f"unknown function: {self.policy}")
        if self.safi == 133:
            used = [k for k, v in self.__dict__.items() if k not in self.FLOWSPEC_ONLY and k != "FLOWSPEC_ONLY" and v is not None]
            if used:
                raise ValueError(f"not for FlowSpec: {', '.join(sorted(used))}")


def sections(q: RouteQuery) -> Column | None:
    """``data`` for the prefix itself, else the include that a row belongs to; null for other rows."""
    if q.prefix is None:
        return None
    out = F.when(same_prefix(q.prefix), "data")
    if "moreSpecifics" in q.include:
        out = out.when(more_specific(q.prefix), "moreSpecifics")
    if "lessSpecifics" in q.include:
        out = out.when(less_specific(q.prefix), "lessSpecifics")
    return out


def search(rib: DataFrame, ingresses: DataFrame, q: RouteQuery) -> DataFrame:
    """The rows of ``rib`` that match, with their section and ingress. Filters on the ingress keep routes whose ingress is unknown."""
    q.check()
    rows = rib.where(F.col("safi") == q.safi)
    if not q.withdrawn:
        rows = rows.where("status <> 'withdrawn'")
    section = sections(q)
    if section is None:
        rows = rows.withColumn("section", F.lit("data"))
    else:
        near = same_prefix(q.prefix)
        near = near | more_specific(q.prefix) if "moreSpecifics" in q.include else near
        near = near | less_specific(q.prefix) if "lessSpecifics" in q.include else near
        rows = rows.where(near).withColumn("section", section)
    attrs = F.col("attrs")
    if q.ingress_id is not None:
        rows = rows.where(F.col("mui") == q.ingress_id)
    if q.otc is not None:
        rows = rows.where(attrs["otc"] == q.otc)
    if q.community is not None:
        rows = rows.where(A.has_community(attrs, q.community))
    if q.large_community is not None:
        rows = rows.where(A.has_large_community(attrs, *q.large_community))
    if q.origin_asn is not None:
        rows = rows.where(A.origin_is(attrs, q.origin_asn))
    if q.rov_status is not None:
        rows = rows.where(F.col("rov") == q.rov_status)
    rows = decorated(rows, ingresses)
    for value, name in ((q.rib_type, "peer_rib_type"), (q.peer_asn, "remote_asn"), (q.peer_address, "remote_addr")):
        if value is not None:
            rows = rows.where(F.col("ingress.id").isNull() | (F.col(f"ingress.{name}") == value))
    if q.policy is not None:
        rows = rows.where(POLICIES[q.policy](attrs))
    if q.fields is not None:
        rows = rows.withColumn("attrs", attrs.withField("codes", A.selected(attrs["codes"], list(q.fields))))
    return rows


def decorated(rows: DataFrame, ingresses: DataFrame) -> DataFrame:
    """``rows`` and the struct ``ingress`` of their mui, null if it is unknown."""
    ing = ingresses.select(F.col("id").alias("__mui"), F.struct(*ingresses.columns).alias("ingress"))
    return rows.join(ing, F.col("mui") == F.col("__mui"), "left").drop("__mui")


def source(rows: DataFrame) -> DataFrame:
    """``rows`` (decorated) and ``source``: a path child names its session, its path id and itself; others themselves."""
    child = F.col("ingress.ingress_type") == "bgpPath"
    return rows.withColumn("source", F.struct(F.when(child, F.col("ingress.parent_ingress")).otherwise(F.col("mui")).alias("id"), F.when(child, F.col("ingress.path_id")).alias("path_id"), F.when(child, F.col("mui")).alias("internal_id")))


def longest_match(rib: DataFrame, targets: DataFrame) -> DataFrame:
    """For each distinct prefix of ``targets`` (BITS): m_plen of the longest unicast prefix with an active route that covers it, and its routes."""
    active = stored(rib.where((F.col("safi") == UNICAST) & (F.col("status") == "active")).select(*BITS, "mui", "attrs"))
    best = longest_prefix(active, targets)
    routes = active.select(F.col("afi").alias("r_afi"), F.col("plen").alias("r_plen"), F.col("p_hi").alias("r_hi"), F.col("p_lo").alias("r_lo"), "mui", "attrs")
    return best.join(routes, F.expr("afi = r_afi AND m_plen = r_plen AND m_hi = r_hi AND m_lo = r_lo")).drop("r_afi", "r_plen", "r_hi", "r_lo")


def longest_prefix(active: DataFrame, targets: DataFrame) -> DataFrame:
    """For each distinct prefix of ``targets`` (BITS): m_plen, m_hi, m_lo of the longest prefix of ``active`` that covers it."""
    prefixes = stored(as_wide(active).distinct())
    # the widths of one target's prefixes are all different, so the longest one is the one of the largest number
    met = covers(prefixes, targets.select(*BITS).distinct()).groupBy(*BITS).agg(F.max("w_plen").alias("m_plen"))
    length = F.col("m_plen")
    return met.select(*BITS, length, mask_hi(F.col("afi"), F.col("p_hi"), length).alias("m_hi"), mask_lo(F.col("afi"), F.col("p_lo"), length).alias("m_lo"))


def with_fallback(rib: DataFrame, prefix: str) -> DataFrame:
    """Active routes of a prefix: unicast ones, or multicast ones if there are none."""
    rows = rib.where(same_prefix(prefix) & (F.col("status") == "active") & F.col("safi").isin(UNICAST, MULTICAST))
    return rows.withColumn("__least", F.min("safi").over(Window.partitionBy(*BITS))).where("safi = __least").drop("__least")


def lists_cover(routes: DataFrame, listed: DataFrame) -> DataFrame:
    """The routes that a prefix of the list ``listed`` (BITS) covers or equals, each once."""
    routes = stored(routes)
    hit = covers(as_wide(listed).distinct(), routes.select(*BITS).distinct()).select(*BITS).distinct()
    return routes.join(hit, BITS, "left_semi")
