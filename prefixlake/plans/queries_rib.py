"""Queries of the fold, the searches and the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.functions import attributes as A
from prefixlake.functions.prefix import BITS, literal
from prefixlake.operators import rib as R
from prefixlake.operators import rov
from prefixlake.operators import search as S
from prefixlake.operators.search import RouteQuery
from prefixlake.plans.registry import query
from prefixlake.plans.rov_sql import COVER, VALID
from prefixlake.sources import demo
from prefixlake.sources.demo import with_

#: A prefix of the projection, its parents and its children (see demo): 17.0.0.0/8 and the like are derived from pk.
WIDE, EXACT, NARROW = "0.0.0.0/1", "158.0.0.0/9", "158.55.121.177/32"


def rib_of(spark, sf_dir, **kw):
    return R.fold(demo.route_events(spark, sf_dir), sessions=False, **kw)


def active(spark, sf_dir):
    return rib_of(spark, sf_dir).where("status = 'active'")


def flat(df, *more):
    a = F.col("attrs")
    return df.select("safi", *BITS, "mui", "seq", "status", F.array_join(a["as_path"].cast("array<string>"), " ").alias("path"), a["med"].cast("long").alias("med"), a["otc"].alias("otc"), A.origin_asn(a).alias("origin"), *more)


FLAT = "safi, afi, plen, p_hi, p_lo, mui, seq, status, as1 || ' ' || as2 || ' ' || as3 AS path, CAST(med AS BIGINT) AS med, otc, origin"


def found(spark, sf_dir, **kw):
    return S.search(rib_of(spark, sf_dir), demo.ingresses(spark, sf_dir), RouteQuery(**kw))


def slim(df, *more):
    return df.select(*BITS, "mui", "seq", *more)


SLIM = "afi, plen, p_hi, p_lo, mui, seq"


def _v4(text: str) -> tuple[int, int]:
    _, plen, _, lo = literal(text)
    return plen, lo


def _inside(text: str) -> str:
    n, lo = _v4(text)
    return f"afi = 1 AND plen > {n} AND p_lo - p_lo % (1::BIGINT << {32 - n}) = {lo}"


def _around(text: str) -> str:
    n, lo = _v4(text)
    return f"afi = 1 AND plen < {n} AND p_lo = {lo} - {lo} % (1::BIGINT << (32 - plen))"


def _is(text: str) -> str:
    n, lo = _v4(text)
    return f"afi = 1 AND plen = {n} AND p_lo = {lo}"


@query(with_("flat") + f"SELECT {FLAT} FROM flat")
def r1_fold_last_writer(spark, sf_dir):
    return flat(rib_of(spark, sf_dir))


@query(with_("flat") + "SELECT safi, afi, plen, p_hi, p_lo, mui, seq, status, CASE WHEN status = 'active' THEN as1 || ' ' || as2 || ' ' || as3 ELSE '' END AS path FROM flat")
def r3_fold_drop_attributes(spark, sf_dir):
    return rib_of(spark, sf_dir, retain=False).select("safi", *BITS, "mui", "seq", "status", F.coalesce(A.fmt_path(F.col("attrs")), F.lit("")).alias("path"))


#: The session rules in SQL: what is older than ``erase`` goes, what is older than ``down`` is withdrawn.
SESSIONS = {
    "lastf": "SELECT mui, afi, safi, max(seq) AS last FROM sev WHERE kind = 'announce' GROUP BY ALL",
    "lasta": "SELECT mui, max(last) AS last_all FROM lastf WHERE safi <> 133 GROUP BY mui",
    "whole": """SELECT mui, max(seq) FILTER (WHERE kind IN ('peer_remove', 'reappeared')) AS gone, max(seq) FILTER (WHERE kind = 'peer_down' AND seq < last_all) AS reset,
      max(seq) FILTER (WHERE kind = 'peer_down') AS down FROM sev LEFT JOIN lasta USING (mui) WHERE kind IN ('peer_remove', 'reappeared', 'peer_down') GROUP BY mui""",
    "fam": """SELECT mui, afi, safi, max(f_reset) AS f_reset, max(f_down) AS f_down FROM (
        SELECT s.mui, s.afi, s.safi, CASE WHEN s.seq < l.last THEN s.seq END AS f_reset, s.seq AS f_down FROM sev s LEFT JOIN lastf l USING (mui, afi, safi) WHERE kind = 'peer_down_family'
        UNION ALL SELECT l.mui, l.afi, l.safi, s.seq, NULL FROM lastf l JOIN sev s ON s.mui = l.mui AND s.kind = 'peer_down' AND s.seq < l.last WHERE l.safi = 133) GROUP BY ALL""",
    "alive": """SELECT s.*, greatest(w.down, f.f_down) AS sdown FROM sev s LEFT JOIN whole w USING (mui) LEFT JOIN fam f ON f.mui = s.mui AND f.afi = s.afi AND f.safi = s.safi
      WHERE kind IN ('announce', 'withdraw') AND s.seq > coalesce(w.gone, -1) AND s.seq > coalesce(f.f_reset, -1) AND (s.safi = 133 OR s.seq > coalesce(w.reset, -1))""",
    "srib": """SELECT *, CASE WHEN lk = 'withdraw' OR coalesce(sdown > seq, false) THEN 'withdrawn' ELSE 'active' END AS status FROM (
        SELECT safi, afi, plen, p_hi, p_lo, rule, mui, max(seq) AS seq, arg_max(kind, seq) AS lk, max(sdown) AS sdown, max(seq) FILTER (WHERE kind = 'announce') AS held FROM alive GROUP BY ALL) WHERE held IS NOT NULL""",
}


@query(with_("sev", **SESSIONS) + "SELECT s.safi, s.afi, s.plen, s.p_hi, s.p_lo, s.mui, coalesce(s.rule, '') AS rule, s.seq, s.status, e.med FROM srib s JOIN sev e ON e.seq = s.held")
def r4_fold_sessions(spark, sf_dir):
    rows = R.fold(demo.session_events(spark, sf_dir))
    return rows.select("safi", *BITS, "mui", F.coalesce(F.col("nlri_raw").cast("string"), F.lit("")).alias("rule"), "seq", "status", F.col("attrs.med").alias("med"))


@query(with_("sev", **SESSIONS) + "SELECT afi, status, count(*) AS n, count(DISTINCT rule) AS rules FROM srib WHERE safi = 133 GROUP BY ALL")
def r12_flowspec_rules(spark, sf_dir):
    rows = R.fold(demo.session_events(spark, sf_dir)).where("safi = 133")
    return rows.groupBy("afi", "status").agg(F.count("*").alias("n"), F.count_distinct("nlri_raw").alias("rules"))


@query(with_("ev") + """SELECT safi, afi, plen, p_hi, p_lo, mui, seq, seq = min(seq) OVER (PARTITION BY safi, afi, plen, p_hi, p_lo) AS prefix_new,
  seq = min(seq) OVER (PARTITION BY safi, afi, plen, p_hi, p_lo, mui) AS mui_new FROM ev WHERE kind = 'announce'""")
def r14_first_sights(spark, sf_dir):
    return R.first_sights(demo.route_events(spark, sf_dir)).drop("nlri_raw")


@query(with_("sev", **SESSIONS) + "SELECT s.safi, s.afi, s.plen, s.p_hi, s.p_lo, s.mui, coalesce(s.rule, '') AS rule, s.seq, s.status FROM srib s")
def r18_compacted_log_folds_alike(spark, sf_dir):
    """The fold of the compacted log, which a stream keeps between batches."""
    rows = R.fold(R.compact(demo.session_events(spark, sf_dir).drop("ts")))
    return rows.select("safi", *BITS, "mui", F.coalesce(F.col("nlri_raw").cast("string"), F.lit("")).alias("rule"), "seq", "status")


@query(with_("ev") + f"SELECT {SLIM} FROM (SELECT safi, afi, plen, p_hi, p_lo, mui, max(seq) AS seq, arg_max(kind, seq) AS k, count(*) FILTER (WHERE kind = 'announce') AS n FROM ev WHERE kind = 'withdraw' OR (NOT as_set AND NOT coalesce(otc NOT IN (as1, as2, as3), false)) GROUP BY ALL) WHERE safi = 1 AND n > 0 AND k = 'announce'")
def r17_filtered_fold(spark, sf_dir):
    """A filter before the fold: announcements without an origin or with a hidden hop stay out, withdrawals pass."""
    from prefixlake.plans.policy import POLICIES, accepted

    ev = demo.route_events(spark, sf_dir)
    ok = (F.col("kind") == "withdraw") | (POLICIES["origin_is_known"](F.col("attrs")) & ~POLICIES["hidden_hop"](F.col("attrs")))
    rows = R.fold(accepted(ev, ok), sessions=False)
    return slim(rows.where("safi = 1 AND status = 'active'"))


@query(with_("act") + f"SELECT {SLIM}, 'data' AS section FROM act WHERE safi = 1 AND {_is(EXACT)}")
def q1_exact_match(spark, sf_dir):
    return slim(found(spark, sf_dir, prefix=EXACT), "section")


@query(with_("act") + f"SELECT {SLIM}, CASE WHEN {_is(WIDE)} THEN 'data' ELSE 'moreSpecifics' END AS section FROM act WHERE safi = 1 AND (({_is(WIDE)}) OR ({_inside(WIDE)}))")
def q2_more_specifics(spark, sf_dir):
    return slim(found(spark, sf_dir, prefix=WIDE, include=("moreSpecifics",)), "section")


@query(with_("act") + f"SELECT {SLIM}, CASE WHEN {_is(NARROW)} THEN 'data' ELSE 'lessSpecifics' END AS section FROM act WHERE safi = 1 AND (({_is(NARROW)}) OR ({_around(NARROW)}))")
def q3_less_specifics(spark, sf_dir):
    return slim(found(spark, sf_dir, prefix=NARROW, include=("lessSpecifics",)), "section")


@query(with_("act") + f"SELECT section, count(*) AS routes, count(DISTINCT (plen, p_lo)) AS prefixes FROM (SELECT *, CASE WHEN {_is(EXACT)} THEN 'data' WHEN {_inside(EXACT)} THEN 'moreSpecifics' WHEN {_around(EXACT)} THEN 'lessSpecifics' END AS section FROM act WHERE safi = 1) WHERE section IS NOT NULL GROUP BY section")
def q5_sections(spark, sf_dir):
    rows = found(spark, sf_dir, prefix=EXACT, include=("moreSpecifics", "lessSpecifics"))
    return rows.groupBy("section").agg(F.count("*").alias("routes"), F.count_distinct("plen", "p_lo").alias("prefixes"))


@query(with_("act", "vrp", t="SELECT DISTINCT afi, plen, p_hi, p_lo FROM vrp", p="SELECT DISTINCT afi, plen, p_hi, p_lo FROM act WHERE safi = 1") + f"SELECT t.afi, t.plen, t.p_hi, t.p_lo, max(w.plen) AS m_plen FROM t JOIN p w ON {COVER} GROUP BY ALL")
def q4_longest_match(spark, sf_dir):
    return S.longest_prefix(active(spark, sf_dir).where("safi = 1"), demo.vrps(spark, sf_dir)).select(*BITS, "m_plen")


@query(with_("act") + f"SELECT {FLAT} FROM act WHERE safi = 1 AND afi = 2")
def q6_dump_family(spark, sf_dir):
    return flat(found(spark, sf_dir, prefix="::/0", include=("moreSpecifics",)))


@query(with_("act") + f"SELECT {SLIM}, safi FROM act a WHERE {_is(EXACT)} AND safi = (SELECT min(safi) FROM act b WHERE {_is(EXACT)})")
def q8_multicast_fallback(spark, sf_dir):
    return slim(S.with_fallback(rib_of(spark, sf_dir), EXACT), "safi")


@query(with_("act") + f"SELECT {SLIM}, safi FROM act WHERE mui = 7")
def q9_by_ingress(spark, sf_dir):
    return slim(active(spark, sf_dir).where("mui = 7"), "safi")


@query(with_("act") + f"SELECT {SLIM}, safi FROM act WHERE origin = 65142")
def q10_by_origin_asn(spark, sf_dir):
    return slim(active(spark, sf_dir).where(A.origin_is(F.col("attrs"), 65142)), "safi")


@query(with_("act") + f"SELECT {SLIM} FROM act WHERE safi = 2")
def q11_multicast_dump(spark, sf_dir):
    return slim(found(spark, sf_dir, safi=2))


@query(with_("sev", **SESSIONS) + "SELECT s.afi, s.plen, s.p_hi, s.p_lo, s.mui, s.rule, hex(encode(s.rule)) AS nlri_hex FROM srib s WHERE safi = 133 AND status = 'active' AND afi = 1 AND p_lo < 2147483648")
def q12_flowspec_search(spark, sf_dir):
    rib = R.fold(demo.session_events(spark, sf_dir))
    rows = S.search(rib, demo.ingresses(spark, sf_dir), RouteQuery(prefix=WIDE, include=("moreSpecifics",), safi=133))
    return rows.select(*BITS, "mui", F.col("nlri_raw").cast("string").alias("rule"), F.hex("nlri_raw").alias("nlri_hex"))


@query(with_("ing") + "SELECT id, name FROM ing WHERE remote_addr BETWEEN 167772160 AND 167772160 + 15 OR remote_addr = 167837697")
def q16_address_lists(spark, sf_dir):
    """Addresses in a list of prefixes and exact addresses: 10.0.0.0/28 and 10.1.0.1."""
    rows = demo.ingresses(spark, sf_dir).where("remote_addr IS NOT NULL").withColumns({"afi": F.lit(1), "plen": F.lit(32), "p_hi": F.lit(0).cast("long"), "p_lo": F.col("remote_addr")})
    acl = spark.createDataFrame([literal(x) for x in ("10.0.0.0/28", "10.1.0.1/32")], "afi int, plen int, p_hi long, p_lo long")
    return S.lists_cover(rows, acl).select("id", "name")


ING = " LEFT JOIN ing i ON i.id = a.mui WHERE a.safi = 1 AND (i.id IS NULL OR "


@query(with_("act") + f"SELECT {SLIM} FROM act WHERE safi = 1 AND mui = 5")
def f1_filter_ingress_id(spark, sf_dir):
    return slim(found(spark, sf_dir, ingress_id=5))


@query(with_("act", "ing") + "SELECT a.afi, plen, p_hi, p_lo, mui, seq FROM act a" + ING + "i.peer_rib_type = 'InPost')")
def f2_filter_rib_type(spark, sf_dir):
    return slim(found(spark, sf_dir, rib_type="InPost"))


@query(with_("act", "ing") + "SELECT a.afi, plen, p_hi, p_lo, mui, seq FROM act a" + ING + "i.remote_asn = 64515)")
def f3_filter_peer_asn(spark, sf_dir):
    return slim(found(spark, sf_dir, peer_asn=64515))


@query(with_("act", "ing") + "SELECT a.afi, plen, p_hi, p_lo, mui, seq FROM act a" + ING + "i.remote_addr = 167772164)")
def f4_filter_peer_address(spark, sf_dir):
    return slim(found(spark, sf_dir, peer_address=167772164))


@query(with_("act", "vrp") + f", {VALID} SELECT a.afi, a.plen, a.p_hi, a.p_lo, mui, seq FROM act a JOIN st s ON a.safi = 1 AND s.afi = a.afi AND s.plen = a.plen AND s.p_hi = a.p_hi AND s.p_lo = a.p_lo AND s.origin = a.origin WHERE s.rov = 'invalid'")
def f6_filter_rov_status(spark, sf_dir):
    """Routes whose origin validation says invalid."""
    checked = rov.with_rov(rib_of(spark, sf_dir), rov.fold_vrps(demo.vrps(spark, sf_dir)))
    return slim(S.search(checked, demo.ingresses(spark, sf_dir), RouteQuery(rov_status="invalid")))


@query(with_("act") + f"SELECT {SLIM}, otc FROM act WHERE safi = 1 AND otc IS NOT NULL AND otc NOT IN (as1, as2, as3)")
def f5_filter_function(spark, sf_dir):
    return slim(found(spark, sf_dir, policy="hidden_hop"), F.col("attrs.otc").alias("otc"))


@query(with_("act") + f"SELECT {SLIM} FROM act WHERE safi = 1 AND otc = 65012")
def f7_filter_otc(spark, sf_dir):
    return slim(found(spark, sf_dir, otc=65012))


@query(with_("act") + f"SELECT {SLIM} FROM act WHERE safi = 1 AND as1 = 64518 AND l1 = 3 AND l2 = 2")
def f8_filter_large_community(spark, sf_dir):
    return slim(found(spark, sf_dir, large_community=(64518, 3, 2)))


@query(with_("act") + f"SELECT {SLIM} FROM act WHERE safi = 1 AND community = 4259840017")
def f9_filter_community(spark, sf_dir):
    return slim(found(spark, sf_dir, community=4259840017))


@query(with_("act") + f"SELECT {SLIM} FROM act WHERE safi = 1 AND origin = 65150")
def f10_filter_origin_asn(spark, sf_dir):
    return slim(found(spark, sf_dir, origin_asn=65150))


@query(with_("flat") + f"SELECT {SLIM}, status FROM flat WHERE safi = 1 AND {_is(EXACT)}")
def f11_with_withdrawn(spark, sf_dir):
    return slim(found(spark, sf_dir, prefix=EXACT, withdrawn=True), "status")


@query(with_("ing") + "SELECT id, ingress_type, remote_asn FROM ing WHERE ingress_type = 'bgpViaBmp' AND state = 'Connected' AND peer_rib_type = 'InPre'")
def f14_filter_ingresses(spark, sf_dir):
    return demo.ingresses(spark, sf_dir).where("ingress_type = 'bgpViaBmp' AND state = 'Connected' AND peer_rib_type = 'InPre'").select("id", "ingress_type", "remote_asn")


@query("SELECT o_orderkey AS msg, generate_series AS ord, (o_custkey * 4099 + generate_series * 7919) % 16777216 * 256 AS p_lo, CASE WHEN o_orderstatus = 'F' THEN 'withdraw' ELSE 'announce' END AS kind FROM orders, generate_series(0, CAST(o_orderkey % 4 AS INTEGER) - 1) WHERE o_orderkey % 4 > 0")
def x1_explode_messages(spark, sf_dir):
    """One row for each prefix that a message announces or withdraws, with its place in the message."""
    from prefixlake.operators.messages import exploded

    msg = demo.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS msg", "if(o_orderkey % 4 > 0, transform(sequence(0, cast(o_orderkey % 4 AS int) - 1), i -> (o_custkey * 4099 + i * 7919) % 16777216 * 256), array()) AS nlri", "o_orderstatus = 'F' AS withdraws"
    )
    empty = F.array().cast("array<bigint>")
    rows = msg.select("msg", F.when(F.col("withdraws"), empty).otherwise(F.col("nlri")).alias("announced"), F.when(F.col("withdraws"), F.col("nlri")).otherwise(empty).alias("withdrawn"))
    return exploded(rows, "msg").select("msg", F.col("ord").cast("long").alias("ord"), F.col("nlri").alias("p_lo"), "kind")


@query("SELECT CASE WHEN p_size % 6 < 2 THEN 'supported' ELSE ['mplsUnicast', 'mplsVpn', 'evpn', 'routeTarget'][p_size % 6 - 1] END AS nlri_type, count(*) AS n FROM part GROUP BY ALL")
def x3_unsupported_families(spark, sf_dir):
    from prefixlake.operators.messages import family_of

    rows = demo.table(spark, sf_dir, "part").select(F.lit(1).alias("afi"), F.expr("element_at(array(1, 133, 4, 128, 70, 132), cast(p_size % 6 + 1 AS int))").alias("safi"))
    return rows.groupBy(family_of(F.col("afi"), F.col("safi")).alias("nlri_type")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '0.0.0.0/0' WHEN p_size % 3 = 1 THEN '::/0' ELSE '10.0.' || p_size || '.0/24' END AS key_prefix FROM part")
def x4_flowspec_key(spark, sf_dir):
    from prefixlake.operators.flowspec import key_prefix

    rows = demo.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "if(p_size % 3 = 2, concat('10.0.', p_size, '.0/24'), NULL) AS dst", "if(p_size % 3 = 1, 2, 1) AS afi")
    return rows.select("id", key_prefix(F.col("dst"), F.col("afi")).alias("key_prefix"))


@query(with_("act") + f"SELECT {SLIM}, CASE WHEN otc IS NULL THEN '2,8' ELSE '2,8,35' END AS codes FROM act WHERE safi = 1 AND mui = 3")
def x5_attribute_projection(spark, sf_dir):
    rows = found(spark, sf_dir, ingress_id=3, fields=(2, 8, 15, 35))
    return slim(rows, F.array_join(F.col("attrs.codes").cast("array<string>"), ",").alias("codes"))


@query(with_("act", "ing") + "SELECT a.mui, count(*) AS routes, coalesce(max(i.name), '') AS name, coalesce(max(CASE WHEN i.ingress_type = 'bgpPath' THEN i.parent_ingress END), a.mui) AS source_id FROM act a LEFT JOIN ing i ON i.id = a.mui GROUP BY a.mui")
def x7_ingress_decoration(spark, sf_dir):
    rows = S.source(S.decorated(active(spark, sf_dir), demo.ingresses(spark, sf_dir)))
    return rows.groupBy("mui").agg(F.count("*").alias("routes"), F.coalesce(F.max("ingress.name"), F.lit("")).alias("name"), F.max("source.id").alias("source_id"))


@query("SELECT s_suppkey AS mui, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey ELSE NULL END AS id, 2000000 + s_suppkey AS internal_id, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey % 3 END AS path_id FROM supplier WHERE s_suppkey % 10 = 0")
def x6_route_source(spark, sf_dir):
    rows = demo.ingresses(spark, sf_dir).where("ingress_type = 'bgpPath'").select(F.col("id").alias("mui"))
    out = S.source(S.decorated(rows, demo.ingresses(spark, sf_dir)))
    return out.select(F.col("source.id").alias("mui"), "source.id", "source.internal_id", "source.path_id")


@query(with_("act") + """SELECT mui, seq, (p_lo >> 24) || '.' || ((p_lo >> 16) % 256) || '.' || ((p_lo >> 8) % 256) || '.' || (p_lo % 256) || '/' || plen AS prefix FROM act WHERE safi = 1 AND afi = 1""")
def x8_prefix_text(spark, sf_dir):
    from prefixlake.functions.prefix import text

    return active(spark, sf_dir).where("safi = 1 AND afi = 1").select("mui", "seq", text(F.col("afi"), F.col("plen"), F.col("p_hi"), F.col("p_lo")).alias("prefix"))


#: The attributes of a route as JSON in SQL.
ATTRS_JSON = """'{"as_path":[' || as1 || ',' || as2 || ',' || as3 || '],"as_set":' || as_set || ',"communities":[' || community || '],"large_communities":[{"ga":' || as1 || ',"l1":' || l1 || ',"l2":' || l2 || '}]'
  || CASE WHEN otc IS NULL THEN '' ELSE ',"otc":' || otc END || ',"med":' || med || ',"codes":[1,2,3,4,8,32' || CASE WHEN otc IS NULL THEN '' ELSE ',35' END || ']}'"""
TEXT_V4 = "(p_lo >> 24) || '.' || ((p_lo >> 16) % 256) || '.' || ((p_lo >> 8) % 256) || '.' || (p_lo % 256) || '/' || plen"


@query(
    with_("act") + f"""SELECT '{{"section":"' || section || '","nlri":"' || {TEXT_V4} || '","routes":[' || string_agg('{{"mui":' || mui || ',"status":"active","pathAttributes":' || {ATTRS_JSON} || '}}', ',' ORDER BY mui) || ']}}' AS value
  FROM (SELECT *, CASE WHEN {_is(EXACT)} THEN 'data' WHEN {_inside(EXACT)} THEN 'moreSpecifics' WHEN {_around(EXACT)} THEN 'lessSpecifics' END AS section FROM act WHERE safi = 1) WHERE section IS NOT NULL GROUP BY section, plen, p_lo"""
)
def x9_nested_json(spark, sf_dir):
    """A document for each prefix of a search, and those included."""
    from prefixlake.plans.sinks import nested_json

    return nested_json(found(spark, sf_dir, prefix=EXACT, include=("moreSpecifics", "lessSpecifics")))


@query(with_("act", "ing") + "SELECT a.mui, a.seq, i.parent_ingress AS bmp_router, i.remote_asn AS peer_asn, i.peer_rib_type AS ribview, a.origin AS origin_asn, a.otc, a.as1 || ' ' || a.as2 || ' ' || a.as3 AS as_path, '65000:' || (a.community - 4259840000) AS communities FROM act a JOIN ing i ON i.id = a.mui WHERE a.safi = 1")
def x10_route_details(spark, sf_dir):
    rows = S.decorated(active(spark, sf_dir).where("safi = 1"), demo.ingresses(spark, sf_dir)).where("ingress IS NOT NULL")
    a = F.col("attrs")
    return rows.select("mui", "seq", F.col("ingress.parent_ingress").alias("bmp_router"), F.col("ingress.remote_asn").alias("peer_asn"), F.col("ingress.peer_rib_type").alias("ribview"), A.origin_asn(a).alias("origin_asn"), a["otc"].alias("otc"), A.fmt_path(a).alias("as_path"), A.fmt_communities(a).alias("communities"))


