"""FlowSpec rules: their key in the table and their validity against unicast routes (RFC 8955, section 6)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.attributes import neighbour_asn
from prefixlake.functions.prefix import BITS, as_wide, covers
from prefixlake.operators.search import longest_prefix
from prefixlake.schema import FLOWSPEC, UNICAST
from prefixlake.sources.stored import stored


def key_prefix(dst: Column, afi: Column) -> Column:
    """A rule's destination, else its family's default route."""
    return F.coalesce(dst, F.when(afi == 2, "::/0").otherwise("0.0.0.0/0"))


def validity(rules: DataFrame, rib: DataFrame, peers: DataFrame) -> DataFrame:
    """``rules`` (BITS of the destination or null plen, mui, attrs) and their ``validity``.

    ``peers`` (id, originator, remote_asn) names each session's originator and neighbour. Without a destination a rule
    is unvalidatable. It is valid if an active unicast route of the longest prefix that covers the destination has the
    rule's originator, and no active longer prefix inside the destination has another known neighbour AS than that best
    route's (rules whose best neighbour is unknown skip this); else invalid.
    """
    who = peers.select(F.col("id").alias("mui"), "originator", "remote_asn")
    named = rules.join(who, "mui", "left").withColumn("originator", F.coalesce("originator", "mui"))
    dst = named.where("plen IS NOT NULL")
    # of the table, once: prefix, originator and neighbour AS of active unicast routes
    unicast = rib.where((F.col("safi") == UNICAST) & (F.col("status") == "active")).select(*BITS, "mui", neighbour_asn(F.col("attrs")).alias("n_as")).join(who, "mui", "left")
    active = stored(unicast.groupBy(*BITS, F.coalesce("originator", "mui").alias("originator")).agg(F.min(F.coalesce("n_as", "remote_asn")).alias("least"), F.max(F.coalesce("n_as", "remote_asn")).alias("most")))
    longest = longest_prefix(active, dst)
    routes = active.select(F.col("afi").alias("r_afi"), F.col("plen").alias("r_plen"), F.col("p_hi").alias("r_hi"), F.col("p_lo").alias("r_lo"), "originator", F.col("least").alias("best_as"))
    best = longest.join(routes, F.expr("afi = r_afi AND m_plen = r_plen AND m_hi = r_hi AND m_lo = r_lo")).select(*BITS, "originator", "best_as")
    inside = active.select(*BITS, F.explode(F.array_distinct(F.array("least", "most"))).alias("n_as")).where("n_as IS NOT NULL").distinct()
    wide = stored(as_wide(dst.select(*BITS).distinct()))
    narrow = covers(wide, inside).where("plen > w_plen").groupBy("w_afi", "w_plen", "w_hi", "w_lo").agg(F.min("n_as").alias("least"), F.max("n_as").alias("most"))
    narrow = narrow.select(F.col("w_afi").alias("afi"), F.col("w_plen").alias("plen"), F.col("w_hi").alias("p_hi"), F.col("w_lo").alias("p_lo"), "least", "most")
    judged = named.join(best.withColumn("matched", F.lit(True)), [*BITS, "originator"], "left").join(narrow, BITS, "left")
    foreign = F.coalesce((F.col("best_as") != F.col("least")) | (F.col("best_as") != F.col("most")), F.lit(False))
    state = F.when(F.col("plen").isNull(), "unvalidatable").when(F.coalesce("matched", F.lit(False)) & ~foreign, "valid").otherwise("invalid")
    return judged.withColumn("validity", state).drop("matched", "best_as", "least", "most", "originator", "remote_asn")


def rules_of(rib: DataFrame) -> DataFrame:
    return rib.where((F.col("safi") == FLOWSPEC) & (F.col("status") == "active"))


def order_key(raw: bytes, v6: bool = False) -> str:
    """A text by which rules sort as RFC 8955, section 5.1, orders them; malformed rules come last.

    Components follow one another by type; of prefixes the longer one that another covers comes first, else the lower
    address; of other components the lower bytes, of which a longer string comes before its beginning; more components
    come before fewer.
    """
    out, at = "", 0
    try:
        while at < len(raw):
            kind, at = raw[at], at + 1
            if kind in (1, 2):
                n, at = raw[at], at + (2 if v6 else 1)
                bits = "".join(f"{b:08b}" for b in raw[at : at + (n + 7) // 8])
                at += (n + 7) // 8
                if at > len(raw):
                    raise ValueError("prefix is cut off")
                out += f"{kind:02x}{bits[:n]}2"
                continue
            start = at
            while True:  # operators with values, up to the one that ends the list
                op = raw[at]
                at += 1 + (1 << (op >> 4 & 3))
                if op & 0x80:
                    break
            if at > len(raw):
                raise ValueError("value is cut off")
            out += f"{kind:02x}{raw[start:at].hex()}g"
    except (IndexError, ValueError):
        return "~" + raw.hex()
    return out + "zz"


def ordered(rules: DataFrame) -> DataFrame:
    """``rules`` by RFC order, then peer. The key is made in Arrow batches; rows sort by range."""
    @F.pandas_udf("string")
    def key(raw: pd.Series, afi: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else order_key(bytes(r), a == 2) for r, a in zip(raw, afi, strict=True)])

    return rules.orderBy(key(F.col("nlri_raw"), F.col("afi")).asc_nulls_last(), "mui")


def placed_rules(rules: DataFrame, *ties: Column) -> DataFrame:
    """``rules`` (nlri_raw, afi) and their ``place`` in RFC order, from 1; ``ties`` order equal rules. The key is made in Arrow batches; no task holds all rules."""
    from prefixlake.operators.stats import placed

    @F.pandas_udf("string")
    def key(raw: pd.Series, afi: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else order_key(bytes(r), a == 2) for r, a in zip(raw, afi, strict=True)])

    keyed = stored(rules.withColumn("__key", key(F.col("nlri_raw"), F.col("afi"))))
    return placed(keyed, F.col("__key").asc_nulls_last(), *ties).drop("__key")


# Types of extended communities that are traffic actions (RFC 8955, section 7).
RATE, ACTION, REDIRECT, MARKING = 0x8006, 0x8007, 0x8008, 0x8009


def actions(communities: Column) -> Column:
    """The traffic actions among 8-byte extended communities (as numbers): an array of kind, asn and value; others are left out.

    rate-limit: its ASN, and the bits of the rate (a 32-bit float); traffic-action: 1 terminal, 2 sample; redirect: ASN
    and number; mark: the DSCP.
    """
    right = lambda c, n: F.call_function("shiftrightunsigned", c, F.lit(n))

    def one(c: Column) -> Column:
        kind, asn, low = right(c, 48).bitwiseAND(0xFFFF), right(c, 32).bitwiseAND(0xFFFF), c.bitwiseAND(0xFFFFFFFF)
        name = F.when(kind == RATE, "rate-limit").when(kind == ACTION, "traffic-action").when(kind == REDIRECT, "redirect").when(kind == MARKING, "mark")
        # the last bit says that later rules still apply, so terminal is its absence
        value = F.when(kind == ACTION, (F.lit(1) - low.bitwiseAND(1)) + low.bitwiseAND(2)).when(kind == MARKING, low.bitwiseAND(63)).otherwise(low)
        return F.struct(name.alias("kind"), F.when(kind.isin(RATE, REDIRECT), asn).alias("asn"), value.cast("long").alias("value"))

    return F.filter(F.transform(communities, one), lambda a: a["kind"].isNotNull())
