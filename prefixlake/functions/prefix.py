"""Prefixes as columns: (afi, plen, p_hi, p_lo), the upper and lower 64 bits of the masked address (IPv4: p_lo alone).

Containment is an equality join: the longer prefix is masked to each length that the other side has.
"""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = ["afi", "plen", "p_hi", "p_lo"]


def literal(text: str) -> tuple[int, int, int, int]:
    """afi, plen, p_hi, p_lo of a prefix or address in text form; host bits are masked."""
    net = ipaddress.ip_network(text, strict=False)
    value = int(net.network_address)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return (1 if net.version == 4 else 2), net.prefixlen, signed(value >> 64), signed(value & ((1 << 64) - 1))


def _keep(bits: Column, n: Column) -> Column:
    """The upper ``n`` of 64 bits; shifts by 64 do nothing in the JVM, so 0 and 64 are cases of their own."""
    drop = (F.lit(64) - n).cast("int")
    shift = lambda f, c: F.call_function(f, c, F.greatest(F.least(drop, F.lit(63)), F.lit(0)))
    return F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, bits).otherwise(shift("shiftleft", shift("shiftright", bits)))


def mask_hi(afi: Column, hi: Column, length: Column) -> Column:
    return F.when(afi == 1, F.lit(0).cast("long")).otherwise(_keep(hi, length))


def mask_lo(afi: Column, lo: Column, length: Column) -> Column:
    return F.when(afi == 1, _keep(lo, length + 32)).otherwise(_keep(lo, length - 64))


def same_prefix(text: str) -> Column:
    afi, plen, hi, lo = literal(text)
    return (F.col("afi") == afi) & (F.col("plen") == plen) & (F.col("p_hi") == hi) & (F.col("p_lo") == lo)


def more_specific(text: str) -> Column:
    """Strictly longer prefixes inside ``text``."""
    afi, plen, hi, lo = literal(text)
    inside = (F.col("afi") == afi) & (F.col("plen") > plen)
    if afi == 1:
        return inside & _span("p_lo", lo, plen + 32)
    return inside & (_span("p_hi", hi, plen) if plen <= 64 else (F.col("p_hi") == hi) & _span("p_lo", lo, plen - 64))


def _span(name: str, first: int, n: int) -> Column:
    """The values that share the upper ``n`` of 64 bits with ``first``: one range, also of signed numbers; it reaches the scan."""
    return F.col(name).between(F.lit(first).cast("long"), F.lit(first + (1 << (64 - n)) - 1).cast("long")) if n else F.lit(True)


def less_specific(text: str) -> Column:
    """Strictly shorter prefixes that cover ``text``: one of its at most 128 ancestors, as plain comparisons that reach the scan."""
    net = ipaddress.ip_network(text, strict=False)
    ups = [literal(str(net.supernet(new_prefix=n))) for n in range(net.prefixlen)]
    one = [(F.col("plen") == n) & (F.col("p_hi") == F.lit(h).cast("long")) & (F.col("p_lo") == F.lit(lo).cast("long")) for _, n, h, lo in ups]
    afi, plen, _, _ = literal(text)
    return (F.col("afi") == afi) & (F.col("plen") < plen) & reduce(or_, one) if one else F.lit(False)


def covers(wide: DataFrame, narrow: DataFrame, how: str = "inner") -> DataFrame:
    """``narrow`` joined with the rows of ``wide`` (BITS as w_afi, w_plen, w_hi, w_lo) that cover or equal its prefix.

    Each narrow prefix meets only the lengths that ``wide`` has (a row of at most 129 numbers for each family, sent to all
    tasks), as an equality join; Catalyst picks a broadcast by size. ``wide`` is used twice: store it if it is costly.
    """
    lengths = wide.groupBy(F.col("w_afi").alias("__afi")).agg(F.collect_set("w_plen").alias("__have"))
    met = narrow.join(F.broadcast(lengths), F.col("afi") == F.col("__afi"), "left")
    mine = F.filter(F.col("__have"), lambda n: n <= F.col("plen"))
    up = met.withColumn("up", (F.explode_outer if how == "left" else F.explode)(mine)).drop("__afi", "__have")
    hi, lo = mask_hi(F.col("afi"), F.col("p_hi"), F.col("up")), mask_lo(F.col("afi"), F.col("p_lo"), F.col("up"))
    up = up.withColumns({"up_hi": hi, "up_lo": lo})
    on = (F.col("afi") == F.col("w_afi")) & (F.col("up") == F.col("w_plen")) & (F.col("up_hi") == F.col("w_hi")) & (F.col("up_lo") == F.col("w_lo"))
    return up.join(wide, on, how).drop("up", "up_hi", "up_lo")


def as_wide(df: DataFrame, *others: str) -> DataFrame:
    """The columns of ``df`` under the names that ``covers`` wants."""
    return df.select(F.col("afi").alias("w_afi"), F.col("plen").alias("w_plen"), F.col("p_hi").alias("w_hi"), F.col("p_lo").alias("w_lo"), *others)


def text(afi: Column, plen: Column, hi: Column, lo: Column) -> Column:
    """``192.0.2.0/24``; IPv6 as eight groups, uncompressed."""
    four = F.concat_ws(".", *(F.call_function("shiftright", lo, F.lit(s)).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    six = F.concat_ws(":", *(F.lower(F.hex(F.call_function("shiftrightunsigned", half, F.lit(s)).bitwiseAND(65535))) for half in (hi, lo) for s in (48, 32, 16, 0)))
    return F.concat(F.when(afi == 1, four).otherwise(six), F.lit("/"), plen.cast("string"))
