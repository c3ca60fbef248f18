"""Predicates and texts on path attributes and messages, for policies and filters: plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The well-known standard communities.
NO_EXPORT = 0xFFFFFF01
NO_ADVERTISE = 0xFFFFFF02
NO_EXPORT_SUBCONFED = 0xFFFFFF03
NO_PEER = 0xFFFFFF04


def path(attrs: Column) -> Column:
    return attrs["as_path"]


def origin_asn(attrs: Column) -> Column:
    """The last hop if it is one ASN, else null (no path, an empty one, or a set at the end)."""
    return F.when(~F.coalesce(attrs["as_set"], F.lit(False)), F.try_element_at(attrs["as_path"], F.lit(-1)))


def neighbour_asn(attrs: Column) -> Column:
    return F.get(attrs["as_path"], F.lit(0))


def path_contains(attrs: Column, asn) -> Column:
    return F.coalesce(F.array_contains(attrs["as_path"], asn), F.lit(False))


def origin_is(attrs: Column, asn) -> Column:
    return F.coalesce(origin_asn(attrs) == asn, F.lit(False))


def has_community(attrs: Column, value: int) -> Column:
    return F.coalesce(F.array_contains(attrs["communities"], F.lit(value).cast("long")), F.lit(False))


def has_large_community(attrs: Column, ga: int, l1: int, l2: int) -> Column:
    want = F.struct(F.lit(ga).cast("long").alias("ga"), F.lit(l1).cast("long").alias("l1"), F.lit(l2).cast("long").alias("l2"))
    return F.coalesce(F.array_contains(attrs["large_communities"], want), F.lit(False))


def has_attribute(attrs: Column, code: int) -> Column:
    return F.coalesce(F.array_contains(attrs["codes"], code), F.lit(False))


def community(text: Column) -> Column:
    """``65000:7`` as a number; what doesn't parse is community 0."""
    part = F.split(text, ":")
    ok = text.rlike(r"^\d{1,5}:\d{1,5}$")
    return F.when(ok, F.get(part, F.lit(0)).try_cast("long") * 65536 + F.get(part, F.lit(1)).try_cast("long")).otherwise(0).cast("long")


def large_community(text: Column) -> Column:
    """``ga:l1:l2``; what doesn't parse is all zero."""
    part, ok = F.split(text, ":"), text.rlike(r"^\d{1,10}:\d{1,10}:\d{1,10}$")
    of = lambda k: F.when(ok, F.get(part, F.lit(k)).try_cast("long")).otherwise(0).cast("long")
    return F.struct(of(0).alias("ga"), of(1).alias("l1"), of(2).alias("l2"))


def fmt_path(attrs: Column) -> Column:
    return F.array_join(attrs["as_path"].cast("array<string>"), " ")


def fmt_asn(asn: Column) -> Column:
    return F.concat(F.lit("AS"), asn.cast("string"))


def fmt_origin(attrs: Column) -> Column:
    return F.coalesce(fmt_asn(origin_asn(attrs)), F.lit(""))


def fmt_community(value: Column) -> Column:
    return F.concat_ws(":", F.floor(value / 65536).cast("string"), (value % 65536).cast("string"))


def fmt_communities(attrs: Column) -> Column:
    return F.array_join(F.transform(attrs["communities"], fmt_community), ", ")


def fmt_large_communities(attrs: Column) -> Column:
    return F.array_join(F.transform(attrs["large_communities"], lambda c: F.concat_ws(":", c["ga"].cast("string"), c["l1"].cast("string"), c["l2"].cast("string"))), ", ")


def fmt_hex_dump(raw: Column) -> Column:
    """An offset, then each byte in hexadecimal, each followed by a space."""
    return F.concat(F.lit("000000 "), F.regexp_replace(F.lower(F.hex(raw)), "(..)", "$1 "))


def fmt_rov(status: Column) -> Column:
    return F.when(status == "notChecked", "not-checked").when(status == "notFound", "not-found").otherwise(status)


def hidden_hop(attrs: Column) -> Column:
    """Only-to-customer is set to an ASN that the path doesn't hold."""
    return attrs["otc"].isNotNull() & ~F.coalesce(F.array_contains(attrs["as_path"], attrs["otc"]), F.lit(False))


def selected(codes: Column, wanted: list[int]) -> Column:
    """The attribute type codes that a projection keeps; 15 never."""
    return F.filter(codes, lambda c: F.array_contains(F.array(*map(F.lit, wanted)).cast("array<int>"), c) & (c != 15))


def is_ibgp(asn: Column, peer_asn: Column) -> Column:
    """Whether a session's peer has the given ASN."""
    return F.coalesce(asn == peer_asn, F.lit(False))


def is_kind(kind: Column, *names: str) -> Column:
    """Predicates on messages: route monitoring, peer up, peer down."""
    return F.coalesce(kind.isin(*names), F.lit(False))


def rov_is(status: Column, name: str) -> Column:
    """valid, invalid or notFound; an unchecked route is none of them."""
    return F.coalesce(status == name, F.lit(False))
