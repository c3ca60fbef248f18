"""The fold against a plain loop, session gauges, the stream, searches, and each registered query against its SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefixlake.functions import attributes as A
from prefixlake.functions.prefix import literal, mask_hi, mask_lo, text
from prefixlake.operators import rib as R
from prefixlake.operators import search as S
from prefixlake.plans import queries
from prefixlake.schema import EVENTS
from prefixlake.sources import demo
from prefixlake.streaming.fold import fold_stream, table

DATA = "/root/testdata/sf0.001"


def event(seq, kind, mui=1, prefix="10.0.0.0/8", safi=1, rule=None, path=(111, 222)):
    if kind in ("peer_down", "peer_remove", "reappeared"):
        return (seq, kind, mui, None, None, None, None, None, None, None)
    afi, plen, hi, lo = literal(prefix)
    attrs = (list(path), False, [], [], None, None, [2]) if kind == "announce" else None
    return (seq, kind, mui, safi, afi, plen, hi, lo, rule, attrs)


def plain(rows):
    """The rules one event at a time."""
    state, downs, fdowns = {}, {}, {}
    for r in sorted(rows):
        seq, kind, mui, safi, afi, *rest = r
        if kind in ("peer_remove", "reappeared"):
            state = {k: v for k, v in state.items() if k[1] != mui}
            downs.pop(mui, None)
        elif kind == "peer_down":
            downs[mui] = seq
            state = {k: (v[0], "withdrawn") if k[1] == mui else v for k, v in state.items()}
        elif kind == "peer_down_family":
            fdowns[mui, afi, safi] = seq
            state = {k: (v[0], "withdrawn") if k[1] == mui and k[0][:2] == (safi, afi) else v for k, v in state.items()}
        elif kind == "announce":
            d = downs.get(mui, -1)
            old = lambda k: k[1] == mui and ((safi != 133 and k[0][0] != 133) or (safi == 133 and k[0][:2] == (133, afi)))  # noqa: E731, B023
            state = {k: v for k, v in state.items() if not (old(k) and v[0] < d)}  # noqa: B023
            f = fdowns.get((mui, afi, safi), -1)
            state = {k: v for k, v in state.items() if not (k[1] == mui and k[0][:2] == (safi, afi) and v[0] < f)}
            state[(safi, afi, *rest[:4]), mui] = (seq, "active")
        else:
            key = ((safi, afi, *rest[:4]), mui)
            if key in state:
                state[key] = (seq, "withdrawn")
    return {k: v for k, v in state.items()}


def folded(df):
    return {((r["safi"], r["afi"], r["plen"], r["p_hi"], r["p_lo"], None if r["nlri_raw"] is None else bytes(r["nlri_raw"])), r["mui"]): (r["seq"], r["status"]) for r in df.collect()}


def test_fold_of_sessions_is_the_plain_loop(spark):
    ev = demo.session_events(spark, "/root/testdata/sf0.01").drop("ts")
    rows = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r[:9]) + (None,) for r in ev.drop("attrs").withColumn("a", F.lit(None)).collect()]
    assert folded(R.fold(ev)) == plain(rows)
    assert folded(R.fold(R.compact(ev))) == plain(rows)


@pytest.mark.parametrize(
    ("rows", "active", "duplicates"),
    [
        ([(1, "announce")] + [(k, "announce") for k in range(2, 7)], 1, 5),
        ([(1, "announce"), (2, "withdraw"), (3, "announce")], 1, 0),
        ([(1, "withdraw")], 0, 0),
        ([(1, "announce"), (2, "withdraw"), (3, "withdraw")], 0, 0),
        ([(1, "announce"), (2, "peer_down"), (3, "announce")], 1, 0),
        ([(1, "announce"), (2, "peer_down")], 0, 0),
    ],
)
def test_gauges(spark, rows, active, duplicates):
    df = spark.createDataFrame([event(*r) for r in rows], EVENTS)
    assert R.fold(df).where("status = 'active'").count() == active
    assert R.transitions(df).where("duplicate").count() == duplicates


def test_retained_attributes_and_rules(spark):
    df = spark.createDataFrame([event(1, "announce", rule=b"a", safi=133), event(2, "announce", rule=b"b", safi=133), event(3, "withdraw", rule=b"a", safi=133)], EVENTS)
    kept = {bytes(r["nlri_raw"]): (r["status"], r["attrs"] is not None) for r in R.fold(df).collect()}
    bare = {bytes(r["nlri_raw"]): (r["status"], r["attrs"] is not None) for r in R.fold(df, retain=False).collect()}
    assert kept == {b"a": ("withdrawn", True), b"b": ("active", True)} and bare == {b"a": ("withdrawn", False), b"b": ("active", True)}


def test_no_resurrection(spark):
    """After a down only the rule announced again is active; unicast routes don't erase rules."""
    df = spark.createDataFrame([event(1, "announce", rule=b"a", safi=133), event(2, "announce", rule=b"b", safi=133), event(3, "peer_down"), event(4, "announce"), event(5, "announce", rule=b"a", safi=133)], EVENTS)
    rows = {(r["safi"], r["nlri_raw"] and bytes(r["nlri_raw"])): r["status"] for r in R.fold(df).collect()}
    assert rows == {(1, None): "active", (133, b"a"): "active"}


def test_stream_is_the_batch(spark, tmp_path):
    ev = demo.session_events(spark, DATA).drop("ts")
    src = str(tmp_path / "in")
    for k in range(3):
        ev.where(F.col("seq") % 1000 >= 0).where((F.col("seq") * 3 / 1000).cast("int") == k).coalesce(1).write.mode("append").parquet(src)
        fold_stream(spark.readStream.schema(ev.schema).parquet(src), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert folded(table(spark, str(tmp_path / "log"), ev.schema)) == folded(R.fold(ev))


def test_prefix_columns(spark):
    rows = [literal(p) for p in ("192.0.2.77/24", "255.255.255.255/32", "0.0.0.0/0", "2001:db8::1/128", "ffff:ffff:ffff:ffff:8000::/65", "fe80::/10")]
    df = spark.createDataFrame(rows, "afi int, plen int, p_hi long, p_lo long")
    for n in (0, 1, 7, 24, 32, 63, 64, 65, 100, 128):
        for r in df.select("*", mask_hi(F.col("afi"), F.col("p_hi"), F.lit(n)).alias("h"), mask_lo(F.col("afi"), F.col("p_lo"), F.lit(n)).alias("l")).collect():
            width = 32 if r["afi"] == 1 else 128
            if n <= width:
                whole = ((r["p_hi"] & (2**64 - 1)) << 64 | r["p_lo"] & (2**64 - 1)) >> (width - n) << (width - n)
                assert (r["h"] & (2**64 - 1)) << 64 | r["l"] & (2**64 - 1) == whole
    assert df.select(text(F.col("afi"), F.col("plen"), F.col("p_hi"), F.col("p_lo")).alias("t")).first()["t"] == "192.0.2.0/24"


def test_includes_reach_the_scan(spark, tmp_path):
    """Prefix searches of a stored table are ranges and equalities on its columns."""
    R.fold(demo.route_events(spark, DATA), sessions=False).write.parquet(str(tmp_path / "rib"))
    rib, ing = spark.read.parquet(str(tmp_path / "rib")), demo.ingresses(spark, DATA)
    for q, want in (
        (S.RouteQuery(prefix="10.0.0.0/8", include=("moreSpecifics",)), ("GreaterThanOrEqual(p_lo,167772160)", "LessThanOrEqual(p_lo,184549375)")),
        (S.RouteQuery(prefix="10.1.0.0/16", include=("lessSpecifics",)), ("EqualTo(plen,8)", "EqualTo(p_lo,167772160)")),
        (S.RouteQuery(prefix="2001:db8::/32", include=("moreSpecifics",)), ("GreaterThanOrEqual(p_hi,2306139568115548160)",)),
    ):
        spark.conf.set("spark.sql.maxMetadataStringLength", 20_000)
        plan = S.search(rib, ing, q)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        pushed = plan[plan.index("PushedFilters: [") :]
        assert all(w in pushed for w in want), pushed[:600]


def test_ancestors_and_descendants(spark):
    """The conditions of includes against Python's own networks, both families, signed halves and edges as well."""
    import ipaddress

    texts = ["0.0.0.0/0", "10.0.0.0/8", "10.128.0.0/9", "10.0.0.1/32", "255.0.0.0/8", "255.255.255.255/32", "::/0", "2001:db8::/32", "2001:db8::/64", "2001:db8::8000:0:0:0/65", "2001:db8::1/128", "ffff::/16", "ffff:ffff:ffff:ffff:ffff::/80", "8000::/1"]
    df = spark.createDataFrame([(t, *literal(t)) for t in texts], "t string, afi int, plen int, p_hi long, p_lo long")
    from prefixlake.functions.prefix import less_specific, more_specific

    nets = {t: ipaddress.ip_network(t) for t in texts}
    for t in texts:
        same = [x for x in texts if nets[x].version == nets[t].version and x != t]
        assert {r["t"] for r in df.where(more_specific(t)).collect()} == {x for x in same if nets[x].subnet_of(nets[t])}
        assert {r["t"] for r in df.where(less_specific(t)).collect()} == {x for x in same if nets[t].subnet_of(nets[x])}


def test_the_table_is_folded_once(spark, tmp_path):
    """Validation against VRPs reads its events in one scan, whatever it does with the table afterwards."""
    from prefixlake.operators import rov

    demo.route_events(spark, DATA).write.parquet(str(tmp_path / "ev"))
    active = R.fold(spark.read.parquet(str(tmp_path / "ev")), sessions=False).where("status = 'active'")
    out = rov.with_rov(active.select("safi", "afi", "plen", "p_hi", "p_lo", "mui", "attrs"), rov.fold_vrps(demo.vrps(spark, DATA)))
    assert str(tmp_path / "ev") not in out._jdf.queryExecution().executedPlan().toString()
    counted = R.fold(spark.read.parquet(str(tmp_path / "ev")), sessions=False).groupBy("mui").count()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in counted and "as_path" not in counted


def test_search_checks_its_parameters(spark):
    with pytest.raises(ValueError, match="unknown function"):
        S.RouteQuery(policy="nothing").check()
    with pytest.raises(ValueError, match="not for FlowSpec"):
        S.RouteQuery(safi=133, otc=1).check()
    with pytest.raises(ValueError, match="unknown include"):
        S.RouteQuery(include=("all",)).check()
    bad = spark.createDataFrame([("x",), ("1:2",), ("1:2:3",)], "t string").select(A.community(F.col("t")).alias("c"), A.large_community(F.col("t")).alias("l")).collect()
    assert [r["c"] for r in bad] == [0, 65538, 0] and bad[2]["l"]["l2"] == 3


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    v = v.item() if hasattr(v, "item") else v
    return (int(v) if v.is_integer() else round(v, 6)) if isinstance(v, float) else v


def rows(frame):
    return sorted((tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_and_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(con.sql(queries.SQL[name]).df())


def with_lines(spark, tmp_path, *lines):
    """A folder with a lineitem table of (order, part, supplier, line), and DuckDB on it."""
    some = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    some.withColumns({"l_quantity": F.lit(20.0), "l_returnflag": F.lit("N"), "l_shipdate": F.expr("timestamp '1996-09-13 00:00:00'")}).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    return str(tmp_path), con


def test_listed_hops_are_second_ones(spark, tmp_path):
    """Supplier 489 is AS65001 as a neighbour, which the list of second hops doesn't mean."""
    sf_dir, con = with_lines(spark, tmp_path, (5, 1, 489, 1), (1, 2, 7, 1))
    got = queries.QUERIES["u19_asn_lists"](spark, sf_dir).toPandas()
    assert list(got["mui"]) == [7] and rows(got) == rows(con.sql(queries.SQL["u19_asn_lists"]).df())


def test_dump_groups_by_path_and_med(spark, tmp_path):
    """Two prefixes with one path and MED share a message, whatever their large communities are."""
    sf_dir, con = with_lines(spark, tmp_path, (1, 2, 7, 1), (51, 202, 7, 2))
    got = queries.QUERIES["a13_dump_groups"](spark, sf_dir).toPandas()
    assert list(got["prefixes"]) == [2] and list(got["messages"]) == [1] and rows(got) == rows(con.sql(queries.SQL["a13_dump_groups"]).df())


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
