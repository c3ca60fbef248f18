"""RFC 8955 order of rules, and the states of validity in sequence."""

from pyspark.sql import functions as F

from prefixlake.functions.prefix import literal
from prefixlake.operators import flowspec
from prefixlake.operators.flowspec import order_key
from prefixlake.schema import EVENTS


def test_order():
    rules = [
        bytes.fromhex("01190a000080"),  # 10.0.0.128/25, inside the next
        bytes.fromhex("01180a0000038106"),  # 10.0.0.0/24 and a protocol
        bytes.fromhex("01180a0000"),  # the same with fewer components
        bytes.fromhex("01180a0001"),  # a higher address
        bytes.fromhex("0381060481" + "35"),
        bytes.fromhex("038106"),
        bytes.fromhex("038111"),
        bytes.fromhex("0120"),  # malformed
    ]
    assert sorted(reversed(rules), key=order_key) == rules


def event(seq, kind, mui, prefix, path):
    afi, plen, hi, lo = literal(prefix)
    return (seq, kind, mui, 1, afi, plen, hi, lo, None, (path, False, [], [], None, None, [2]) if path else None)


def test_validity_in_sequence(spark):
    from prefixlake.operators.rib import fold

    peers = spark.createDataFrame([(1, 101, 65001), (2, 102, 65002)], "id long, originator long, remote_asn long")
    afi, plen, hi, lo = literal("10.0.1.0/24")
    rules = spark.createDataFrame([("a", 1, afi, plen, hi, lo), ("b", 2, afi, plen, hi, lo), ("none", 1, None, None, None, None)], "rule string, mui long, afi int, plen int, p_hi long, p_lo long")
    rows, want = [event(0, "announce", 2, "192.0.2.0/24", [65002])], []
    for more, states in ((None, "invalid invalid unvalidatable"), (event(1, "announce", 1, "10.0.0.0/16", [65001]), "valid invalid unvalidatable"), (event(2, "announce", 2, "10.0.1.128/25", [65002]), "invalid invalid unvalidatable")):
        rows += [more] if more else []
        rib = fold(spark.createDataFrame(rows, EVENTS))
        want.append(states)
        got = flowspec.validity(rules, rib, peers).orderBy(F.col("rule")).collect()
        assert " ".join(r["validity"] for r in got) == states
