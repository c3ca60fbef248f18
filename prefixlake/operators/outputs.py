"""What is sent on: neighbours, per-peer headers, the phases of a dump, live messages, metric lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags of a per-peer header by the kind of table, and for IPv6 peers.
RIB_FLAGS = {"InPre": 0x00, "InPost": 0x40, "OutPre": 0x10, "OutPost": 0x50, "Loc": 0x40}
V6_FLAG = 0x80


def neighbors(ingresses: DataFrame) -> DataFrame:
    """Native and BMP neighbours in one table, with the state that their register entry implies."""
    peers = ingresses.where(F.col("ingress_type").isin("bgp", "bgpViaBmp"))
    state = F.when(F.col("state") == "Connected", "Established").otherwise("Idle")
    return peers.withColumns({"source": F.when(F.col("ingress_type") == "bgp", "native").otherwise("bmp"), "state": state})


def per_peer_header(peers: DataFrame, is_v6: Column) -> DataFrame:
    """``peers`` and flags, asn, address of their headers; what is missing is zero, an unset table counts as the local one."""
    flags = F.lit(RIB_FLAGS["Loc"])
    for name, value in RIB_FLAGS.items():
        flags = F.when(F.col("peer_rib_type") == name, value).otherwise(flags)
    return peers.withColumns({"flags": flags + F.when(F.coalesce(is_v6, F.lit(False)), V6_FLAG).otherwise(0), "asn": F.coalesce("remote_asn", F.lit(0)), "address": F.coalesce("remote_addr", F.lit(0))})


def dump_phases(active: DataFrame) -> DataFrame:
    """The parts of an initial dump, in the order (phase, mui): initiation, peers, routes, FlowSpec rules, ends."""
    spark = active.sparkSession
    per = active.groupBy("mui").agg(F.count(F.when(F.col("safi") == 1, 1)).alias("routes"), F.count(F.when(F.col("safi") == 133, 1)).alias("rules"))
    parts = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(w).alias("what"), n.cast("long").alias("n")) for p, w, n in ((1, "peer up", F.lit(1)), (2, "routes", F.col("routes")), (3, "flowspec", F.col("rules")), (4, "end of rib", F.lit(1)))))
    rows = per.select("mui", F.explode(parts).alias("x")).select("x.phase", "x.what", "mui", "x.n").where("n > 0")
    return spark.createDataFrame([(0, "initiation", None, 1)], "phase int, what string, mui long, n long").unionByName(rows)


def live_message(kind: Column) -> Column:
    """The BMP message that an event becomes after the dump."""
    return F.when(kind.isin("announce", "withdraw", "peer_down_family"), "route monitoring").when(kind.isin("peer_down", "peer_remove"), "peer down").when(kind.isin("reappeared", "peer_up"), "peer up").when(kind == "peer_stats", "statistics report")


def metric_lines(values: DataFrame, name: str, labels: tuple[str, ...]) -> DataFrame:
    """Metric text lines: name, labels, value."""
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels))
    return values.select(F.concat(F.lit(name + "{"), inner, F.lit("} "), F.col("value").cast("string")).alias("line"))


def includes(text: Column, pattern: str) -> Column:
    """Whether a text holds a pattern, in any case."""
    return F.lower(text).contains(pattern.lower())


def admin_label(name: Column, description: Column) -> Column:
    """The JSON label of an upstream router; placeholders and empty texts are left out, null if nothing is left."""
    real = lambda c, none: F.when((c != none) & (c != ""), c)
    n, d = real(name, "no-sysname"), real(description, "no-sysdesc")
    return F.when(n.isNotNull() | d.isNotNull(), F.to_json(F.struct(n.alias("sysName"), d.alias("sysDescr"))))


def redacted(config: Column) -> Column:
    """A configuration's text with the values of secrets replaced; a text whose quotes don't pair up is withheld as a whole."""
    hidden = F.regexp_replace(config, r'(?mi)^(\s*(?:md5_key|password|username|secret|token)\s*=\s*)(?:"[^"\n]*"|[^\s#]+)', r'$1"***"')
    odd = F.exists(F.split(config, "\n"), lambda line: F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1)
    return F.when(odd, "***").otherwise(hidden)
