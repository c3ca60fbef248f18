"""Routing message files as DataFrames: MRT archives and BMP captures, read with Spark's binaryFile source.

Each file is one task's row; its records are decoded one after another and leave the task in full batches, those of small
files together. ``seq`` is made of the file's place (by path) and the record's and prefix's place in it, which is the total order that the fold needs.
"""

from __future__ import annotations

import bz2
import gzip
import ipaddress
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.functions.prefix import literal

COLUMNS = (
    "path string, ord long, ts double, kind string, info string, distinguisher string, peer_address string, peer_asn long, peer_flags int, afi int, safi int, plen int, p_hi long, p_lo long, path_id long, nlri_raw binary, "
    "attrs struct<as_path:array<bigint>,as_set:boolean,communities:array<bigint>,large_communities:array<struct<ga:bigint,l1:bigint,l2:bigint>>,otc:bigint,med:bigint,codes:array<int>>"
)
ROWS = 5000
# MRT types and subtypes (RFC 6396, RFC 8050), BGP attribute codes, BMP message types (RFC 7854).
TABLE_DUMP_V2, BGP4MP, BGP4MP_ET = 13, 16, 17
RIB_SUBTYPES = {2: (1, 1, False), 4: (2, 1, False), 8: (1, 1, True), 10: (2, 1, True)}
STATE_CHANGES = {0: False, 5: True}
MESSAGES = {1: (False, False), 4: (True, False), 8: (False, True), 9: (True, True)}
MED, COMMUNITIES, MP_REACH, MP_UNREACH, AS4_PATH, LARGE, OTC = 4, 8, 14, 15, 17, 32, 35
ROUTE_MONITORING, STATISTICS, PEER_DOWN, PEER_UP, INITIATION, TERMINATION = range(6)
RIB_GENERIC = {6: False, 12: True}
INFORMATION = {1: "sysDescr", 2: "sysName"}
#: The stores that MRT updates fill; multicast in them is dropped.
MRT_STORES = (1, 133)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def prefix_at(b: bytes, at: int, afi: int, add_path: bool) -> tuple[dict, int]:
    path_id = None
    if add_path:
        path_id, at = struct.unpack_from("!I", b, at)[0], at + 4
    n, at = b[at], at + 1
    width, size = (32 if afi == 1 else 128), (n + 7) // 8
    if n > width or at + size > len(b):
        raise ValueError("bad prefix")
    value = int.from_bytes(b[at : at + size].ljust(width // 8, b"\0"), "big") >> (width - n) << (width - n)
    return {"afi": afi, "plen": n, "p_hi": _signed(value >> 64), "p_lo": _signed(value & ((1 << 64) - 1)), "path_id": path_id, "nlri_raw": None}, at + size


def prefixes(b: bytes, afi: int, add_path: bool = False) -> list[dict]:
    out, at = [], 0
    while at < len(b):
        one, at = prefix_at(b, at, afi, add_path)
        out.append(one | {"safi": 1})
    return out


def rules(b: bytes, afi: int) -> list[dict]:
    """FlowSpec rules: keyed by their destination prefix, or their family's default route."""
    out, at = [], 0
    while at < len(b):
        n, at = (b[at], at + 1) if b[at] < 0xF0 else (struct.unpack_from("!H", b, at)[0] & 0xFFF, at + 2)
        raw, at = b[at : at + n], at + n
        key = {"afi": afi, "plen": 0, "p_hi": 0, "p_lo": 0}
        if raw[:1] == b"\x01":
            key, _ = prefix_at(raw, 1, afi, False) if afi == 1 else prefix_at(raw[:2] + raw[3:], 1, afi, False)
        out.append(key | {"safi": 133, "path_id": None, "nlri_raw": raw})
    return out


def _nlri(afi: int, safi: int, b: bytes, add_path: bool) -> list[dict]:
    if safi == 133:
        return rules(b, afi)
    if safi in (1, 2) and afi in (1, 2):
        return [p | {"safi": safi} for p in prefixes(b, afi, add_path)]
    return []  # families that are counted elsewhere and dropped


def attributes(b: bytes, asn4: bool, add_path: bool = False) -> tuple[dict, list[dict], list[dict]]:
    """The decoded attributes, and what multiprotocol attributes announce and withdraw."""
    a: dict = {"as_path": None, "as_set": None, "communities": None, "large_communities": None, "otc": None, "med": None, "codes": []}
    up, down, at, wide = [], [], 0, None
    while at < len(b):
        flags, code = b[at], b[at + 1]
        n, at = (struct.unpack_from("!H", b, at + 2)[0], at + 4) if flags & 0x10 else (b[at + 2], at + 3)
        v, at = b[at : at + n], at + n
        if len(v) < n:
            raise ValueError("attribute is cut off")
        a["codes"].append(code)
        if code == 2:
            a["as_path"], a["as_set"] = hops(v, asn4)
        elif code == AS4_PATH:
            wide = hops(v, True)
        elif code == MED:
            a["med"] = int.from_bytes(v, "big")
        elif code == COMMUNITIES:
            a["communities"] = list(struct.unpack(f"!{n // 4}I", v))
        elif code == LARGE:
            x = struct.unpack(f"!{n // 4}I", v)
            a["large_communities"] = [{"ga": x[k], "l1": x[k + 1], "l2": x[k + 2]} for k in range(0, len(x), 3)]
        elif code == OTC:
            a["otc"] = int.from_bytes(v, "big")
        elif code == MP_REACH and n >= 5:
            afi, safi, hop = struct.unpack_from("!HBB", v)
            up += _nlri(afi, safi, v[5 + hop :], add_path)
        elif code == MP_UNREACH and n >= 3:
            afi, safi = struct.unpack_from("!HB", v)
            down += _nlri(afi, safi, v[3:], add_path)
    # a two-byte session carries wide ASNs apart: they stand for the path's end (RFC 6793)
    if wide and not asn4 and a["as_path"] is not None and len(wide[0]) <= len(a["as_path"]):
        a["as_path"], a["as_set"] = a["as_path"][: len(a["as_path"]) - len(wide[0])] + wide[0], wide[1] if wide[0] else a["as_set"]
    return a, up, down


def hops(v: bytes, asn4: bool) -> tuple[list[int], bool]:
    """The ASNs of a path's segments, and whether the last segment is a set."""
    path, k, last = [], 0, 2
    while k < len(v):
        last, count = v[k], v[k + 1]
        path += struct.unpack_from(f"!{count}{'I' if asn4 else 'H'}", v, k + 2)
        k += 2 + count * (4 if asn4 else 2)
    return path, last != 2


def update(b: bytes, asn4: bool, add_path: bool = False) -> Iterator[dict]:
    """Announcements, then withdrawals, of a BGP message; other messages give none."""
    if len(b) < 23 or b[18] != 2:
        return
    n = struct.unpack_from("!H", b, 19)[0]
    m = struct.unpack_from("!H", b, 21 + n)[0]
    a, up, down = attributes(b[23 + n : 23 + n + m], asn4, add_path)
    for p in prefixes(b[23 + n + m : struct.unpack_from("!H", b, 16)[0]], 1, add_path) + up:
        yield p | {"kind": "announce", "attrs": a}
    for p in prefixes(b[21 : 21 + n], 1, add_path) + down:
        yield p | {"kind": "withdraw", "attrs": None}


@lru_cache(maxsize=4096)
def _address(b: bytes) -> str:
    return str(ipaddress.ip_address(b))


def mrt_records(b: bytes) -> Iterator[dict]:
    """Rows of an MRT archive. Records of other kinds are skipped; a framing error is an error of the file."""
    at, peers = 0, []
    while at < len(b):
        if at + 12 > len(b):
            raise ValueError("MRT header is cut off")
        ts, kind, sub, n = struct.unpack_from("!IHHI", b, at)
        v, at = b[at + 12 : at + 12 + n], at + 12 + n
        if len(v) < n:
            raise ValueError("MRT record is cut off")
        if kind == TABLE_DUMP_V2 and sub == 1:
            k, peers = 6 + struct.unpack_from("!H", v, 4)[0], []
            (count,), k = struct.unpack_from("!H", v, k), k + 2
            for _ in range(count):
                t, k = v[k], k + 5
                size = 16 if t & 1 else 4
                address, k = _address(v[k : k + size]), k + size
                asn, k = (struct.unpack_from("!I", v, k)[0], k + 4) if t & 2 else (struct.unpack_from("!H", v, k)[0], k + 2)
                peers.append({"peer_address": address, "peer_asn": asn})
        elif kind == TABLE_DUMP_V2 and sub in RIB_SUBTYPES:
            afi, safi, add_path = RIB_SUBTYPES[sub]
            p, k = prefix_at(v, 4, afi, False)
            (count,), k = struct.unpack_from("!H", v, k), k + 2
            for _ in range(count):
                (index,), k = struct.unpack_from("!H", v, k), k + 6
                path_id = None
                if add_path:
                    path_id, k = struct.unpack_from("!I", v, k)[0], k + 4
                (size,), k = struct.unpack_from("!H", v, k), k + 2
                # next-hop-only MP_REACH of table dumps is shorter than on the wire and names no prefix
                a, _, _ = attributes(v[k : k + size], True)
                k += size
                yield p | peers[index] | {"ts": float(ts), "kind": "announce", "safi": safi, "path_id": path_id, "attrs": a}
        elif kind == TABLE_DUMP_V2 and sub in RIB_GENERIC:
            afi, safi = struct.unpack_from("!HB", v, 4)
            if safi == 133:
                n, k = (v[7], 8) if v[7] < 0xF0 else (struct.unpack_from("!H", v, 7)[0] & 0xFFF, 9)
                found, k = rules(v[7 : k + n], afi), k + n
            elif safi in MRT_STORES and afi in (1, 2):
                p, k = prefix_at(v, 7, afi, False)
                found = [p | {"safi": safi}]
            else:
                continue
            (count,), k = struct.unpack_from("!H", v, k), k + 2
            for _ in range(count):
                (index,), k = struct.unpack_from("!H", v, k), k + 6
                path_id = None
                if RIB_GENERIC[sub]:
                    path_id, k = struct.unpack_from("!I", v, k)[0], k + 4
                (size,), k = struct.unpack_from("!H", v, k), k + 2
                a, _, _ = attributes(v[k : k + size], True)
                k += size
                for p in found:
                    yield p | peers[index] | {"ts": float(ts), "kind": "announce", "path_id": path_id, "attrs": a}
        elif kind in (BGP4MP, BGP4MP_ET):
            when, v = (ts + struct.unpack_from("!I", v)[0] / 1e6, v[4:]) if kind == BGP4MP_ET else (float(ts), v)
            asn4, add_path = MESSAGES.get(sub, (STATE_CHANGES.get(sub, False), False))
            width = 4 if asn4 else 2
            asn, afi = int.from_bytes(v[:width], "big"), struct.unpack_from("!H", v, 2 * width + 2)[0]
            size, k = (4 if afi == 1 else 16), 2 * width + 4
            who = {"peer_address": _address(v[k : k + size]), "peer_asn": asn, "ts": when}
            k += 2 * size
            if sub in STATE_CHANGES and struct.unpack_from("!HH", v, k) == (6, 1):  # established, then idle
                yield who | {"kind": "peer_down"}
            elif sub in MESSAGES:
                for row in update(v[k:], asn4, add_path):
                    if row["safi"] in MRT_STORES:
                        yield who | row


def bmp_frames(b: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and body of each BMP message; a length outside 6 bytes to 2 MiB is an error."""
    at = 0
    while at < len(b):
        version, n, kind = struct.unpack_from("!BIB", b, at)
        if version != 3 or not 6 <= n <= 2 << 20 or at + n > len(b):
            raise ValueError("bad BMP frame")
        yield kind, b[at + 6 : at + n]
        at += n


def bmp_records(b: bytes) -> Iterator[dict]:
    """Rows of a BMP capture: routes, peers that come and go, statistics, and the session's beginning and end with what they tell.

    Route messages that don't parse as they should are tried with the other ASN width, which their peer keeps.
    """
    narrow: dict[bytes, bool] = {}
    for kind, v in bmp_frames(b):
        if kind in (INITIATION, TERMINATION):
            told: dict[str, list[str]] = {}
            for t, value in tlvs(v):
                if kind == INITIATION and t in INFORMATION:
                    told.setdefault(INFORMATION[t], []).append(value.decode("utf-8", "replace"))
                elif kind == TERMINATION and t == 1:
                    told.setdefault("reason", []).append(str(int.from_bytes(value, "big")))
            yield {"ts": None, "kind": "initiation" if kind == INITIATION else "termination", "info": json.dumps({k: "|".join(x) for k, x in told.items()}, ensure_ascii=False)}
            continue
        if kind not in (ROUTE_MONITORING, STATISTICS, PEER_DOWN, PEER_UP):
            continue
        flags, rd, address, asn = v[1], v[2:10], v[10:26], struct.unpack_from("!I", v, 26)[0]
        seconds, micros = struct.unpack_from("!II", v, 34)
        who = {"ts": seconds + micros / 1e6, "distinguisher": rd.hex(), "peer_address": _address(address if flags & 0x80 else address[12:]), "peer_asn": asn, "peer_flags": flags}
        if kind == ROUTE_MONITORING:
            two = narrow.get(v[:34], bool(flags & 0x20))
            try:
                found = list(update(v[42:], not two))
            except (ValueError, struct.error, IndexError):
                found = list(update(v[42:], two))
                narrow[v[:34]] = not two
            for row in found:
                yield who | row
        elif kind == STATISTICS:
            yield who | {"kind": "peer_stats", "info": json.dumps({str(t): int.from_bytes(x[3:] if len(x) == 11 else x, "big") for t, x in tlvs(v[46:])})}
        else:
            yield who | {"kind": "peer_down" if kind == PEER_DOWN else "peer_up"}


def bmp_dump_records(b: bytes) -> Iterator[dict]:
    """Rows of a dump of BMP messages, each behind 16 bytes of milliseconds and 8 bytes of length."""
    messages, at = [], 0
    while at < len(b):
        if at + 24 > len(b) or at + 24 + (n := int.from_bytes(b[at + 16 : at + 24], "big")) > len(b):
            raise ValueError("BMP dump is cut off")
        messages.append(b[at + 24 : at + 24 + n])
        at += 24 + n
    yield from bmp_records(b"".join(messages))


def tlvs(b: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and value of each information or statistics field; one that is cut off is an error."""
    at = 0
    while at < len(b):
        kind, n = struct.unpack_from("!HH", b, at)
        if at + 4 + n > len(b):
            raise ValueError("BMP field is cut off")
        yield kind, b[at + 4 : at + 4 + n]
        at += 4 + n


def _decoder(records, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []  # of many small pieces as well: a batch has its price, whatever it holds
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                content = gzip.decompress(content) if path.endswith(".gz") else bz2.decompress(content) if path.endswith(".bz2") else content
                for ord_, row in enumerate(records(content)):
                    rows.append({"path": path, "ord": ord_, **row})
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def decoded(contents: DataFrame, records) -> DataFrame:
    """The rows of ``contents`` (path, content: whole files or any pieces that begin and end with records)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = contents.sparkSession.createDataFrame([], COLUMNS)
    return contents.select("path", "content").mapInArrow(_decoder(records, to_arrow_schema(empty.schema)), COLUMNS)


def _read(spark: SparkSession, path: str, records) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path), records)


def read_mrt(spark: SparkSession, path: str) -> DataFrame:
    """Rows of MRT archives, plain, .gz or .bz2; a file that doesn't parse fails the read."""
    return _read(spark, path, mrt_records)


def read_bmp(spark: SparkSession, path: str) -> DataFrame:
    """Rows of captures of BMP sessions."""
    return _read(spark, path, bmp_records)


def read_bmp_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of dumps of BMP messages with their times."""
    return _read(spark, path, bmp_dump_records)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def as_events(rows: DataFrame) -> DataFrame:
    """Events for the fold. A route's mui is a hash of what identifies its peer (for MRT address and ASN, for BMP the distinguisher and table as well) and its path id.

    A peer that goes down takes its path children along, and in a BMP session all its tables; the end of a BMP session
    takes all peers of its capture. The muis that belong together come from the rows themselves: one for each peer,
    table and path id. Withdrawals of path ids that were never announced are dropped with their muis, as they make no row.
    """
    files = rows.select("path").distinct()
    from pyspark.sql import Window

    order = files.withColumn("file", F.row_number().over(Window.orderBy("path")))  # a row for each file
    bmp = F.col("peer_flags").isNotNull()
    view = F.coalesce(F.col("peer_flags").bitwiseAND(0x50), F.lit(0))
    # MRT peers are the same in all files; those of a BMP session belong to its router
    peer = F.xxhash64("peer_address", "peer_asn", F.coalesce("distinguisher", F.lit("")), F.when(bmp, F.col("path")).otherwise(""))
    mui = F.xxhash64(peer, view, F.coalesce("path_id", F.lit(-1)))
    known = rows.join(order, "path").withColumns({"seq": F.col("file").cast("long") * (1 << 40) + F.col("ord"), "peer": peer, "mui": mui, "session": F.when(bmp, F.col("path"))})
    key = ("safi", "afi", "plen", "p_hi", "p_lo", "nlri_raw", "attrs")
    routes = known.where("kind IN ('announce', 'withdraw')").select("seq", "kind", "mui", *key)
    register = known.where("kind = 'announce'").select("peer", "mui", "session").distinct()
    downs = known.where("kind = 'peer_down'").select("seq", F.col("peer").alias("p"))
    ends = known.where("kind = 'termination'").select("seq", F.col("path").alias("s"))
    gone = downs.join(register, F.col("p") == F.col("peer")).select("seq", "mui").unionByName(ends.join(register, F.col("s") == F.col("session")).select("seq", "mui")).distinct()
    none = [F.lit(None).cast(routes.schema[c].dataType).alias(c) for c in key]
    return routes.unionByName(gone.select("seq", F.lit("peer_down").alias("kind"), "mui", *none))


def vrps_csv(spark: SparkSession, path: str) -> DataFrame:
    """VRPs of a validator's CSV export (ASN, IP Prefix, Max Length, Trust Anchor; a header): BITS, asn, max_len. Rows that don't parse have no prefix and are dropped."""
    rows = spark.read.option("header", True).csv(path).toDF("asn", "prefix", "max_len", "anchor")
    return _vrps(rows)


def vrps_json(spark: SparkSession, path: str) -> DataFrame:
    """VRPs of a validator's JSON export (``roas``: asn, prefix, maxLength, ta)."""
    rows = spark.read.schema("roas array<struct<asn:string,prefix:string,maxLength:int,ta:string>>").option("multiLine", True).json(path)
    return _vrps(rows.select(F.explode("roas").alias("r")).select("r.asn", "r.prefix", F.col("r.maxLength").alias("max_len")))


def _vrps(rows: DataFrame) -> DataFrame:
    bits = F.pandas_udf(_bits, "afi int, plen int, p_hi long, p_lo long")
    asn = F.regexp_replace("asn", "^[aA][sS]", "").try_cast("long")
    return rows.select(bits("prefix").alias("b"), asn.alias("asn"), F.col("max_len").try_cast("int").alias("max_len")).where("b.afi IS NOT NULL AND asn IS NOT NULL").select("b.*", "asn", "max_len")


def _bits(prefixes: pd.Series) -> pd.DataFrame:
    def one(text):
        try:
            return literal(text)
        except (ValueError, TypeError):
            return (None,) * 4

    return pd.DataFrame([one(t) for t in prefixes], columns=["afi", "plen", "p_hi", "p_lo"]).astype("Int64")
