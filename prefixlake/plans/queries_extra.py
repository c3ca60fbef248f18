"""Queries of dropped attributes, orders, message logs, VRP events, FlowSpec actions, labels and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.functions import attributes as A
from prefixlake.functions.prefix import BITS, text
from prefixlake.operators import flowspec, messages, metrics, outputs, rov, stats
from prefixlake.operators import rib as R
from prefixlake.plans.policy import counters, logged
from prefixlake.plans.queries_rib import SESSIONS, TEXT_V4, active, rib_of
from prefixlake.plans.registry import query
from prefixlake.plans.rov_sql import VALID
from prefixlake.sources import demo
from prefixlake.sources.demo import with_


@query(with_("sev", **SESSIONS) + "SELECT s.safi, s.afi, s.plen, s.p_hi, s.p_lo, s.mui, coalesce(s.rule, '') AS rule, s.seq, s.status, CASE WHEN s.status = 'active' THEN e.med END AS med FROM srib s JOIN sev e ON e.seq = s.held")
def r8_sessions_drop_attributes(spark, sf_dir):
    """What a down withdraws keeps no attributes."""
    rows = R.fold(demo.session_events(spark, sf_dir), retain=False)
    return rows.select("safi", *BITS, "mui", F.coalesce(F.col("nlri_raw").cast("string"), F.lit("")).alias("rule"), "seq", "status", F.col("attrs.med").alias("med"))


@query(with_("ing") + "SELECT CASE WHEN state = 'Disconnected' THEN NULL ELSE name END AS info, count(*) AS n, CASE WHEN state = 'Disconnected' THEN 'peer_down' WHEN name IS NULL THEN 'peer_down' ELSE 'peer_remove' END AS kind FROM ing GROUP BY ALL")
def r11_bulk_withdrawals(spark, sf_dir):
    rows = demo.ingresses(spark, sf_dir).select(F.when(F.coalesce(F.col("state") != "Disconnected", F.lit(True)), F.col("name")).alias("info"))
    return rows.groupBy("info", messages.bulk_kind(F.col("info")).alias("kind")).agg(F.count("*").alias("n"))


@query(with_("ing") + "SELECT id, row_number() OVER (ORDER BY id, ingress_type) AS place FROM ing WHERE ingress_type IN ('bgp', 'bgpViaBmp')")
def o2_peers_by_id(spark, sf_dir):
    return stats.placed(demo.ingresses(spark, sf_dir).where("ingress_type IN ('bgp', 'bgpViaBmp')"), F.col("id").asc(), F.col("ingress_type").asc()).select("id", "place")


@query("WITH m AS (SELECT event_type AS name, sum(user_id % 5)::BIGINT AS value FROM events WHERE user_id % 5 <> 0 GROUP BY ALL) SELECT name, value, row_number() OVER (ORDER BY name) AS place FROM m")
def o3_metrics_by_name(spark, sf_dir):
    rows = counters(demo.table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_type AS name", "'counter' AS kind", "user_id % 5 AS value"))
    return stats.placed(rows, F.col("name").asc()).select("name", "value", "place")


@query("""SELECT o_orderkey AS msg, o_custkey % 6 AS as_path_hops, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE (o_orderkey % 5 + 1) // 2 END AS conventional_reach, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE (o_orderkey % 5) // 2 END AS mp_reach,
  CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 5 + 1) // 2 ELSE 0 END AS conventional_unreach, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 5) // 2 ELSE 0 END AS mp_unreach FROM orders""")
def a16_message_log(spark, sf_dir):
    """Every other prefix of a message is an IPv6 one, which only multiprotocol attributes carry."""
    nlri = "if(o_orderkey % 5 > 0, transform(sequence(0, cast(o_orderkey % 5 AS int) - 1), i -> named_struct('afi', 1 + i % 2, 'safi', 1)), array())"
    rows = demo.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS msg", "if(o_custkey % 6 > 0, sequence(1L, o_custkey % 6), array()) AS as_path", f"if(o_orderstatus = 'F', NULL, {nlri}) AS announced", f"if(o_orderstatus = 'F', {nlri}, NULL) AS withdrawn")
    return messages.log_counts(rows).drop("as_path", "announced", "withdrawn")


@query(with_("vrp", r="SELECT max(seq) AS at FROM vrp WHERE seq % 500 = 0", k="SELECT afi, plen, p_hi, p_lo, asn, coalesce(max_len, plen) AS max_len, max(seq) AS seq, arg_max(action, seq) AS action FROM vrp WHERE seq % 500 <> 0 GROUP BY ALL") + "SELECT afi, plen, p_hi, p_lo, asn, max_len FROM k, r WHERE action = 'announce' AND (r.at IS NULL OR k.seq > r.at)")
def v3_full_load(spark, sf_dir):
    """A full load of VRPs replaces all that came before it."""
    deltas = demo.vrps(spark, sf_dir).withColumn("action", F.when(F.col("seq") % 500 == 0, "reset").otherwise(F.col("action")))
    return rov.fold_vrps(deltas).select(*BITS, "asn", "max_len")


@query(with_("vrp") + "SELECT seq, asn, max_len IS NULL OR max_len <= 24 AS revalidates FROM vrp")
def v6_vrp_hook(spark, sf_dir):
    rows = rov.accepted_deltas(demo.vrps(spark, sf_dir), F.col("max_len") <= 24)
    return rows.select("seq", "asn", "revalidates")


@query(with_("vrp") + f"SELECT seq, action || ' VRP ' || {TEXT_V4} || ' from AS' || asn AS shown FROM vrp WHERE afi = 1")
def u22_vrp_texts(spark, sf_dir):
    rows = demo.vrps(spark, sf_dir).where("afi = 1")
    return rows.select("seq", rov.fmt_vrp(F.col("action"), text(F.col("afi"), F.col("plen"), F.col("p_hi"), F.col("p_lo")), F.col("asn")).alias("shown"))


@query(with_("act", "vrp") + ", " + VALID + " SELECT afi, count(*) FILTER (WHERE rov = 'valid') AS valid, count(*) FILTER (WHERE rov = 'invalid') AS invalid, count(*) FILTER (WHERE rov = 'notFound') AS not_found FROM st GROUP BY afi")
def u23_rov_predicates(spark, sf_dir):
    rows = active(spark, sf_dir).where("safi = 1").select(*BITS, A.origin_asn(F.col("attrs")).alias("origin"))
    state = rov.validity(rows, rov.fold_vrps(demo.vrps(spark, sf_dir)))
    n = lambda s: F.count(F.when(A.rov_is(F.col("rov"), s), 1))
    return state.groupBy("afi").agg(n("valid").alias("valid"), n("invalid").alias("invalid"), n("notFound").alias("not_found"))


@query(with_("ing") + "SELECT id, coalesce(remote_asn = 64520, false) AS ibgp FROM ing")
def u15_internal_sessions(spark, sf_dir):
    return demo.ingresses(spark, sf_dir).select("id", A.is_ibgp(F.lit(64520), F.col("remote_asn")).alias("ibgp"))


@query(with_("sev") + "SELECT mui, count(*) FILTER (WHERE kind IN ('announce', 'withdraw')) AS monitoring, count(*) FILTER (WHERE kind = 'reappeared') AS ups, count(*) FILTER (WHERE kind IN ('peer_down', 'peer_remove')) AS downs FROM sev GROUP BY mui")
def u16_message_kinds(spark, sf_dir):
    n = lambda *k: F.count(F.when(A.is_kind(F.col("kind"), *k), 1))
    return demo.session_events(spark, sf_dir).groupBy("mui").agg(n("announce", "withdraw").alias("monitoring"), n("reappeared", "peer_up").alias("ups"), n("peer_down", "peer_remove").alias("downs"))


@query("""WITH c AS (SELECT o_orderkey AS rule, o_custkey % 60000 AS asn, o_orderkey % 5 AS k FROM orders) SELECT rule, ['rate-limit', 'traffic-action', 'redirect', 'mark', NULL][k + 1] AS kind, CASE WHEN k IN (0, 2) THEN asn END AS asn,
  CASE k WHEN 0 THEN 1148846080 WHEN 1 THEN (1 - rule % 2) + (rule % 4) // 2 * 2 WHEN 2 THEN rule % 1000 WHEN 3 THEN rule % 64 END AS value FROM c""")
def l7_flowspec_actions(spark, sf_dir):
    """Traffic actions of rules; one community in five is none."""
    kinds = ", ".join(str(k) for k in (flowspec.RATE, flowspec.ACTION, flowspec.REDIRECT, flowspec.MARKING, 2))
    low = "element_at(array(1148846080L, o_orderkey % 4, o_orderkey % 1000, o_orderkey % 64, 7L), cast(o_orderkey % 5 + 1 AS int))"
    c = f"shiftleft(cast(element_at(array({kinds}), cast(o_orderkey % 5 + 1 AS int)) AS bigint), 48) + shiftleft(o_custkey % 60000, 32) + {low}"
    rows = demo.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS rule", f"array({c}) AS ext")
    first = F.get(flowspec.actions(F.col("ext")), F.lit(0))
    return rows.select("rule", first["kind"].alias("kind"), first["asn"].alias("asn"), first["value"].alias("value"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE '{' || concat_ws(',', CASE WHEN s_suppkey % 3 <> 0 THEN '"sysName":"' || s_name || '"' END, CASE WHEN s_suppkey % 2 <> 0 THEN '"sysDescr":"say \\"' || s_nationkey || '\\""' END) || '}' END AS label FROM supplier""")
def k8_admin_labels(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "if(s_suppkey % 3 = 0, 'no-sysname', s_name) AS name", "if(s_suppkey % 2 = 0, 'no-sysdesc', concat('say \"', s_nationkey, '\"')) AS description")
    return rows.select("id", outputs.admin_label(F.col("name"), F.col("description")).alias("label"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '***' ELSE 'name = "' || s_name || '"' || chr(10) || '  md5_key = "***"' || chr(10) || 'password = "***" # kept' || chr(10) || 'port = ' || s_nationkey END AS config FROM supplier""")
def k15_redacted_configuration(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", """concat('name = "', s_name, '"\n  md5_key = "', s_acctbal, if(s_suppkey % 5 = 0, '', '"'), '\npassword = ', s_suppkey, ' # kept\nport = ', s_nationkey) AS config""")
    return rows.select("id", outputs.redacted(F.col("config")).alias("config"))


def _hex(value: str, digits: int):
    """A number as so many hexadecimal digits."""
    return F.lpad(F.hex(F.expr(value)), digits, "0")


def _update(path: str, prefix: str, withdraws):
    """A BGP message with a path of one ASN (an expression), or a withdrawal, of a /24 whose upper 24 bits are ``prefix``."""
    nlri = F.concat(F.lit("18"), _hex(prefix, 6))
    attrs = F.concat(F.lit("4002060201"), _hex(path, 8))
    body = F.when(withdraws, F.concat(F.lit("0004"), nlri, F.lit("0000"))).otherwise(F.concat(F.lit("00000009"), attrs, nlri))
    return F.concat(F.lit("f" * 32), F.lpad(F.hex(F.length(body) / 2 + 19), 4, "0"), F.lit("02"), body)


@query("SELECT o_orderkey AS rec, 1.0 * (o_orderkey % 1000) AS ts, CASE WHEN o_orderstatus = 'F' THEN 'withdraw' ELSE 'announce' END AS kind, 65000 + o_custkey % 500 AS peer_asn, 24 AS plen, (o_custkey * 7919 % 16777216) * 256 AS p_lo, CASE WHEN o_orderstatus <> 'F' THEN 64000 + o_orderkey % 90 END AS origin FROM orders")
def s6_mrt_updates(spark, sf_dir):
    """MRT records made of the orders, decoded by the reader's code: a record for each order, each with one prefix."""
    from prefixlake.sources import wire

    # a table of few row groups is few tasks' scan; dealt by key, larger ones are decoded in more tasks (of a few MB each, as Spark joins small ones)
    rows = demo.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition("o_orderkey")
    message = _update("64000 + o_orderkey % 90", "o_custkey * 7919 % 16777216", F.col("o_orderstatus") == "F")
    body = F.concat(_hex("65000 + o_custkey % 500", 8), F.lit("0000fde8" + "0000" + "0001" + "c0000201" + "c0000202"), message)
    record = F.concat(_hex("o_orderkey % 1000", 8), F.lit("00100004"), F.lpad(F.hex(F.length(body) / 2), 8, "0"), body)
    out = wire.decoded(rows.select(F.col("o_orderkey").cast("string").alias("path"), F.unhex(record).alias("content")), wire.mrt_records)
    return out.select(F.col("path").cast("long").alias("rec"), "ts", "kind", "peer_asn", "plen", "p_lo", A.origin_asn(F.col("attrs")).alias("origin"))


@query("""SELECT s_suppkey AS router, t.n AS tab, (s_suppkey * 4 + t.n) * 256 AS p_lo, CASE WHEN s_suppkey % 3 = 1 AND t.n < 2 OR s_suppkey % 3 = 2 THEN 'withdrawn' ELSE 'active' END AS status FROM supplier, range(0, 3) t(n)""")
def s17_bmp_sessions(spark, sf_dir):
    """BMP captures made of the suppliers: a peer with two tables and another peer; in one capture of three the first peer goes down, in one the session ends."""
    from prefixlake.sources import wire

    peer = lambda flags, asn: F.concat(F.lit("00" + flags + "0" * 16 + "0" * 24 + "0a000001"), F.lit(asn), F.lit("01010101" + "00000007" + "00000000"))
    framed = lambda kind, body: F.concat(F.lit("03"), F.lpad(F.hex(F.length(body) / 2 + 6), 8, "0"), F.lit(kind), body)
    route = lambda n, flags, asn: framed("00", F.concat(peer(flags, asn), _update("64000", f"s_suppkey * 4 + {n}", F.lit(False))))
    last = F.when(F.col("s_suppkey") % 3 == 1, framed("02", F.concat(peer("00", "0000fdea"), F.lit("01")))).when(F.col("s_suppkey") % 3 == 2, framed("05", F.lit("000100020001"))).otherwise("")
    capture = F.concat(framed("04", F.lit("000200027231")), route(0, "00", "0000fdea"), route(1, "40", "0000fdea"), route(2, "00", "0000fdeb"), last)
    rows = demo.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.unhex(capture).alias("content"))
    out = R.fold(wire.as_events(wire.decoded(rows, wire.bmp_records)))
    at = F.floor(F.col("p_lo") / 256)
    return out.select(F.floor(at / 4).alias("router"), (at % 4).alias("tab"), "p_lo", "status")


def _metric_sql(source: str, label: str, **values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({label} AS VARCHAR) AS label, CAST({v} AS BIGINT) AS value FROM {source}" for n, v in values.items())


@query(with_("ev", t="SELECT count(*) AS n, max(seq) AS last FROM ev") + _metric_sql("t", "'all'", num_updates="n", last_update="last"))
def m1_gate_metrics(spark, sf_dir):
    return metrics.gate(demo.route_events(spark, sf_dir))


@query(
    with_("sev", "ing", p="SELECT mui, count(*) FILTER (WHERE kind = 'announce') AS a, count(*) FILTER (WHERE kind = 'withdraw') AS w, count(*) FILTER (WHERE kind = 'reappeared') AS u, count(*) FILTER (WHERE kind IN ('peer_down', 'peer_remove')) AS d FROM sev GROUP BY mui",
          t="SELECT parent_ingress AS r, count(*) FILTER (WHERE state = 'Connected') AS c, coalesce(sum(a), 0) AS a, coalesce(sum(w), 0) AS w, coalesce(sum(u), 0) AS u, coalesce(sum(d), 0) AS d FROM ing LEFT JOIN p ON p.mui = ing.id WHERE ingress_type = 'bgpViaBmp' GROUP BY parent_ingress")
    + _metric_sql("t", "r", peers_connected="c", announcements="a", withdrawals="w", peer_ups="u", peer_downs="d")
)
def m2_bmp_metrics(spark, sf_dir):
    return metrics.bmp_in(demo.session_events(spark, sf_dir), demo.ingresses(spark, sf_dir))


@query(with_("flat", t="SELECT afi || '/' || safi AS l, count(*) AS n, count(*) FILTER (WHERE status = 'withdrawn') AS w, count(DISTINCT (plen, p_hi, p_lo)) AS u FROM flat GROUP BY ALL") + _metric_sql("t", "l", items="n", withdrawn="w", unique_prefixes="u"))
def m3_table_metrics(spark, sf_dir):
    return metrics.rib(rib_of(spark, sf_dir))


@query("WITH t AS (SELECT user_id AS p, count(*) FILTER (WHERE event_type = 'signup') AS c, count(*) FILTER (WHERE event_type = 'error') AS d FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id) " + _metric_sql("t", "p", connections="c", disconnects="d"))
def m4_session_metrics(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')").selectExpr("user_id AS peer", "if(event_type = 'signup', 'Established', 'Idle') AS state")
    return metrics.bgp_in(rows)


@query(
    with_("vrp", h="SELECT afi, count(*) AS n FROM (SELECT DISTINCT afi, plen, p_hi, p_lo, asn, max_len FROM (SELECT afi, plen, p_hi, p_lo, asn, coalesce(max_len, plen) AS max_len, arg_max(action, seq) AS action FROM vrp GROUP BY ALL) WHERE action = 'announce') GROUP BY afi",
          t="SELECT v.afi, count(*) FILTER (WHERE action = 'announce') AS a, count(*) FILTER (WHERE action = 'withdraw') AS w, coalesce(max(h.n), 0) AS n FROM vrp v LEFT JOIN h ON h.afi = v.afi GROUP BY v.afi")
    + _metric_sql("t", "afi", announced="a", withdrawn="w", held="n")
)
def m5_vrp_metrics(spark, sf_dir):
    deltas = demo.vrps(spark, sf_dir)
    return metrics.rtr(deltas, rov.fold_vrps(deltas))


@query(with_("ev", t="SELECT 'hidden hop' AS topic, count(*) AS n FROM ev WHERE kind = 'announce' AND otc IS NOT NULL AND otc NOT IN (as1, as2, as3) HAVING count(*) > 0") + _metric_sql("t", "topic", published="n"))
def m6_broker_metrics(spark, sf_dir):
    ev = demo.route_events(spark, sf_dir)
    return metrics.broker(logged(ev, "hidden hop", (F.col("kind") == "announce") & A.hidden_hop(F.col("attrs"))))
