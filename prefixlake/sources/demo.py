"""Routing tables projected from the star-schema test tables, in integer arithmetic that any SQL engine repeats.

lineitem gives route events, events gives session events, supplier and nation the ingresses, part the VRPs, orders the
FlowSpec rules. ``SQL`` holds the same projections for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_A = "((pk * 2654435761) % 4294967296)"


def _prefix(df: DataFrame) -> DataFrame:
    """afi, plen, p_hi, p_lo of the number ``pk``."""
    hi = f"({_A} % 2147483648) * 4294967296"
    return df.withColumns(
        {
            "afi": F.expr("if(pk % 5 = 0, 2, 1)"),
            "plen": F.expr("cast(if(pk % 5 = 0, 16 + pk % 33, 8 + pk % 17) AS int)"),
        }
    ).withColumns(
        {
            "p_hi": F.expr(f"if(afi = 2, {hi} - ({hi}) % shiftleft(1L, 64 - plen), 0L)"),
            "p_lo": F.expr(f"if(afi = 1, {_A} - {_A} % shiftleft(1L, 32 - plen), 0L)"),
        }
    )


def _attrs(mui: str, mid: str, last: str, closed: str, community: str, l1: str, l2: str, otc: str):
    return F.expr(
        f"named_struct('as_path', array(64512L + {mui}, 65000L + {mid}, 65100L + {last}), 'as_set', {closed}, 'communities', array(4259840000L + {community}), "
        f"'large_communities', array(named_struct('ga', 64512L + {mui}, 'l1', cast({l1} AS bigint), 'l2', cast({l2} AS bigint))), 'otc', {otc}, 'med', cast({community} AS bigint), "
        f"'codes', if({otc} IS NULL, array(1, 2, 3, 4, 8, 32), array(1, 2, 3, 4, 8, 32, 35)))"
    )


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements and withdrawals; a mui for each supplier. ``seq`` packs day, order, line, part and supplier."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pk", F.expr("l_partkey % 211"))
    day = "cast(datediff(l_shipdate, timestamp '1992-01-01 00:00:00') AS bigint)"
    rows = _prefix(rows).withColumn("seq", F.expr(f"((({day} * 262144 + l_orderkey) * 8 + l_linenumber) * 32768 + l_partkey) * 1024 + l_suppkey"))
    return rows.select(
        "seq",
        F.expr("if(l_returnflag = 'R', 'withdraw', 'announce')").alias("kind"),
        F.col("l_suppkey").alias("mui"),
        F.expr("if(pk % 11 = 3, 2, 1)").alias("safi"),
        "afi", "plen", "p_hi", "p_lo",
        F.lit(None).cast("binary").alias("nlri_raw"),
        _attrs("l_suppkey", "l_orderkey % 50", "l_partkey % 200", "l_partkey % 13 = 0", "cast(l_quantity AS int)", "l_linenumber", "l_orderkey % 7", "if(l_orderkey % 3 = 0, 65000L + l_orderkey % 50 + if(l_orderkey % 9 = 0, 1, 0), NULL)").alias("attrs"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route and session events of peers, with FlowSpec rules among them."""
    rows = _prefix(table(spark, sf_dir, "events").withColumn("pk", F.expr("event_id % 97")))
    kind = """CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'peer_down' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'reappeared'
      WHEN event_type = 'click' AND event_id % 37 = 0 THEN 'peer_down_family' WHEN event_type = 'view' AND event_id % 211 = 0 THEN 'peer_remove'
      WHEN event_type = 'purchase' THEN 'withdraw' ELSE 'announce' END"""
    return rows.select(
        F.col("event_id").alias("seq"), F.col("ts"), F.expr(kind).alias("kind"), F.expr("user_id % 40").alias("mui"), F.expr("CASE WHEN pk % 7 = 0 THEN 133 WHEN pk % 11 = 3 THEN 2 ELSE 1 END").alias("safi"),
        "afi", "plen", "p_hi", "p_lo", F.expr("if(pk % 7 = 0, encode(concat('rule', cast(event_id % 3 AS string)), 'utf-8'), NULL)").alias("nlri_raw"),
        _attrs("user_id % 40", "event_id % 50", "event_id % 200", "event_id % 13 = 0", "event_id % 90", "event_id % 5", "event_id % 7", "if(event_id % 3 = 0, 65000L + event_id % 50, NULL)").alias("attrs"),
    )


def ingresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers (suppliers; one in 17 is unknown), their routers (nations), and path children of one peer in 10."""
    peers = table(spark, sf_dir, "supplier").where("s_suppkey % 17 <> 16").select(
        F.col("s_suppkey").alias("id"), F.expr("if(s_suppkey % 6 = 5, 'bgp', 'bgpViaBmp')").alias("ingress_type"), F.expr("1000000L + s_nationkey").alias("parent_ingress"),
        F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'Disconnected' WHEN s_suppkey % 7 = 1 THEN NULL ELSE 'Connected' END").alias("state"),
        F.expr("167772160L + s_suppkey % 300").alias("remote_addr"), F.expr("64512L + s_suppkey").alias("remote_asn"),
        F.expr("element_at(array('InPre', 'InPost', 'Loc', 'OutPre', 'OutPost'), cast(s_suppkey % 5 + 1 AS int))").alias("peer_rib_type"), F.col("s_name").alias("name"), F.lit(None).cast("bigint").alias("path_id"),
    )
    routers = table(spark, sf_dir, "nation").selectExpr("1000000L + n_nationkey AS id", "'bmp' AS ingress_type", "CAST(NULL AS bigint) AS parent_ingress", "if(n_nationkey % 4 = 0, 'Disconnected', 'Connected') AS state", "167837696L + n_nationkey AS remote_addr", "CAST(NULL AS bigint) AS remote_asn", "CAST(NULL AS string) AS peer_rib_type", "n_name AS name", "CAST(NULL AS bigint) AS path_id")
    paths = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").selectExpr("2000000L + s_suppkey AS id", "'bgpPath' AS ingress_type", "s_suppkey AS parent_ingress", "if(s_suppkey % 20 = 0, 'Disconnected', 'Connected') AS state", "CAST(NULL AS bigint) AS remote_addr", "CAST(NULL AS bigint) AS remote_asn", "CAST(NULL AS string) AS peer_rib_type", "s_name AS name", "s_suppkey % 3 AS path_id")
    return peers.unionByName(routers).unionByName(paths)


def vrps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated payloads: prefixes of the routes shortened by 0 to 4 bits."""
    rows = _prefix(table(spark, sf_dir, "part").withColumn("pk", F.expr("p_partkey % 150"))).withColumn("len", F.expr("plen - cast(p_partkey % 5 AS int)"))
    return rows.selectExpr("afi", "len AS plen", "if(afi = 2, p_hi - p_hi % shiftleft(1L, 64 - len), 0L) AS p_hi", "if(afi = 1, p_lo - p_lo % shiftleft(1L, 32 - len), 0L) AS p_lo", "65100L + p_partkey % 200 AS asn", "if(p_size % 4 = 0, NULL, len + p_size % 9) AS max_len", "p_partkey AS seq", "if(p_size % 10 = 0, 'withdraw', 'announce') AS action").distinct()


_SP = f"""CASE WHEN pk % 5 = 0 THEN 2 ELSE 1 END AS afi, CAST(CASE WHEN pk % 5 = 0 THEN 16 + pk % 33 ELSE 8 + pk % 17 END AS INTEGER) AS plen"""
_HI = f"(({_A} % 2147483648) * 4294967296)"


def _sql_prefix(inner: str) -> str:
    return f"""(SELECT *, CASE WHEN afi = 2 THEN {_HI} - {_HI} % (1::BIGINT << (64 - plen)) ELSE 0 END AS p_hi,
      CASE WHEN afi = 1 THEN {_A} - {_A} % (1::BIGINT << (32 - plen)) ELSE 0 END AS p_lo FROM (SELECT *, {_SP} FROM ({inner})))"""


SQL = {
    "ev": f"""SELECT (((date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 262144 + l_orderkey) * 8 + l_linenumber) * 32768 + l_partkey) * 1024 + l_suppkey AS seq,
      CASE WHEN l_returnflag = 'R' THEN 'withdraw' ELSE 'announce' END AS kind, l_suppkey AS mui, CASE WHEN pk % 11 = 3 THEN 2 ELSE 1 END AS safi, afi, plen, p_hi, p_lo,
      64512 + l_suppkey AS as1, 65000 + l_orderkey % 50 AS as2, 65100 + l_partkey % 200 AS as3, l_partkey % 13 = 0 AS as_set, CAST(l_quantity AS INTEGER) AS med,
      4259840000 + CAST(l_quantity AS INTEGER) AS community, CAST(l_linenumber AS BIGINT) AS l1, l_orderkey % 7 AS l2,
      CASE WHEN l_orderkey % 3 = 0 THEN 65000 + l_orderkey % 50 + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END END AS otc
      FROM {_sql_prefix('SELECT *, l_partkey % 211 AS pk FROM lineitem')}""",
    "sev": f"""SELECT event_id AS seq, ts, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'peer_down' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'reappeared'
      WHEN event_type = 'click' AND event_id % 37 = 0 THEN 'peer_down_family' WHEN event_type = 'view' AND event_id % 211 = 0 THEN 'peer_remove'
      WHEN event_type = 'purchase' THEN 'withdraw' ELSE 'announce' END AS kind, user_id % 40 AS mui, CASE WHEN pk % 7 = 0 THEN 133 WHEN pk % 11 = 3 THEN 2 ELSE 1 END AS safi,
      afi, plen, p_hi, p_lo, CASE WHEN pk % 7 = 0 THEN 'rule' || (event_id % 3) END AS rule, 64512 + user_id % 40 AS as1, 65000 + event_id % 50 AS as2, 65100 + event_id % 200 AS as3,
      event_id % 13 = 0 AS as_set, event_id % 90 AS med, CASE WHEN event_id % 3 = 0 THEN 65000 + event_id % 50 END AS otc
      FROM {_sql_prefix('SELECT *, event_id % 97 AS pk FROM events')}""",
    "ing": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 5 THEN 'bgp' ELSE 'bgpViaBmp' END AS ingress_type, 1000000 + s_nationkey AS parent_ingress,
      CASE WHEN s_suppkey % 7 = 0 THEN 'Disconnected' WHEN s_suppkey % 7 = 1 THEN NULL ELSE 'Connected' END AS state, 167772160 + s_suppkey % 300 AS remote_addr, 64512 + s_suppkey AS remote_asn,
      ['InPre', 'InPost', 'Loc', 'OutPre', 'OutPost'][s_suppkey % 5 + 1] AS peer_rib_type, s_name AS name, CAST(NULL AS BIGINT) AS path_id FROM supplier WHERE s_suppkey % 17 <> 16
      UNION ALL SELECT 1000000 + n_nationkey, 'bmp', NULL, CASE WHEN n_nationkey % 4 = 0 THEN 'Disconnected' ELSE 'Connected' END, 167837696 + n_nationkey, NULL, NULL, n_name, NULL FROM nation
      UNION ALL SELECT 2000000 + s_suppkey, 'bgpPath', s_suppkey, CASE WHEN s_suppkey % 20 = 0 THEN 'Disconnected' ELSE 'Connected' END, NULL, NULL, NULL, s_name, s_suppkey % 3 FROM supplier WHERE s_suppkey % 10 = 0""",
    "vrp": f"""SELECT DISTINCT afi, len AS plen, CASE WHEN afi = 2 THEN p_hi - p_hi % (1::BIGINT << (64 - len)) ELSE 0 END AS p_hi, CASE WHEN afi = 1 THEN p_lo - p_lo % (1::BIGINT << (32 - len)) ELSE 0 END AS p_lo,
      65100 + p_partkey % 200 AS asn, CASE WHEN p_size % 4 = 0 THEN NULL ELSE len + p_size % 9 END AS max_len, p_partkey AS seq, CASE WHEN p_size % 10 = 0 THEN 'withdraw' ELSE 'announce' END AS action
      FROM (SELECT *, plen - CAST(p_partkey % 5 AS INTEGER) AS len FROM {_sql_prefix('SELECT *, p_partkey % 150 AS pk FROM part')})""",
    # of each key the last event; what it announced last; no row without an announcement
    "flat": """SELECT r.safi, r.afi, r.plen, r.p_hi, r.p_lo, r.mui, r.seq, r.status, e.as1, e.as2, e.as3, e.as_set, e.med, e.community, e.l1, e.l2, e.otc, CASE WHEN NOT e.as_set THEN e.as3 END AS origin
      FROM (SELECT * FROM (SELECT safi, afi, plen, p_hi, p_lo, mui, max(seq) AS seq, CASE WHEN arg_max(kind, seq) = 'withdraw' THEN 'withdrawn' ELSE 'active' END AS status,
      max(seq) FILTER (WHERE kind = 'announce') AS held FROM ev GROUP BY ALL) WHERE held IS NOT NULL) r JOIN ev e ON e.seq = r.held""",
}
_NEEDS = {"flat": ["ev"], "act": ["ev", "flat"]}
SQL["act"] = "SELECT * FROM flat WHERE status = 'active'"


def with_(*names: str, **more: str) -> str:
    """A WITH clause of the named projections and what they need, then ``more``."""
    order: list[str] = []
    for n in names:
        for d in [*_NEEDS.get(n, []), n]:
            if d not in order:
                order.append(d)
    return "WITH " + ", ".join([f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]) + "\n"
