"""Schemas of the tables that the engine reads and makes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LARGE = T.StructType([T.StructField(c, T.LongType()) for c in ("ga", "l1", "l2")])

#: Decoded path attributes. as_set: the path ends in a set, so it has no origin.
ATTRS = T.StructType(
    [
        T.StructField("as_path", T.ArrayType(T.LongType())),
        T.StructField("as_set", T.BooleanType()),
        T.StructField("communities", T.ArrayType(T.LongType())),
        T.StructField("large_communities", T.ArrayType(LARGE)),
        T.StructField("otc", T.LongType()),
        T.StructField("med", T.LongType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
    ]
)

PREFIX = [T.StructField("afi", T.IntegerType()), T.StructField("plen", T.IntegerType()), T.StructField("p_hi", T.LongType()), T.StructField("p_lo", T.LongType())]

#: One row for each announced or withdrawn route, or session event. ``seq`` is the total order of arrival.
EVENTS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("mui", T.LongType()), T.StructField("safi", T.IntegerType()), *PREFIX, T.StructField("nlri_raw", T.BinaryType()), T.StructField("attrs", ATTRS)])

#: What names a route: its store, family, prefix and, for FlowSpec, rule.
KEY = ["safi", "afi", "plen", "p_hi", "p_lo", "nlri_raw"]
UNICAST, MULTICAST, FLOWSPEC = 1, 2, 133
V4, V6 = 1, 2
DOWNS = ("peer_down", "peer_down_family", "peer_remove", "reappeared")
