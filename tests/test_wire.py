"""MRT and BMP files, written here by hand, through the readers and the fold."""

import bz2
import gzip
import struct

import pytest

from prefixlake.operators.rib import fold
from prefixlake.sources import wire


def attr(code, value, flags=0x40):
    return struct.pack("!BBB", flags, code, len(value)) + value if len(value) < 256 else struct.pack("!BBH", flags | 0x10, code, len(value)) + value


def path(*asns, kind=2, width="I"):
    return attr(2, struct.pack(f"!BB{len(asns)}{width}", kind, len(asns), *asns))


def bgp(withdrawn=b"", attrs=b"", nlri=b""):
    body = struct.pack("!H", len(withdrawn)) + withdrawn + struct.pack("!H", len(attrs)) + attrs + nlri
    return b"\xff" * 16 + struct.pack("!HB", 19 + len(body), 2) + body


def mrt(kind, sub, body, ts=100):
    return struct.pack("!IHHI", ts, kind, sub, len(body)) + body


def bgp4mp(message, sub=4):
    return mrt(16, sub, struct.pack("!IIHH", 65001, 65000, 0, 1) + bytes([192, 0, 2, 1, 192, 0, 2, 2]) + message)


ATTRS = path(65001, 65002) + attr(4, struct.pack("!I", 50)) + attr(8, struct.pack("!2I", 65000 << 16 | 7, 0xFFFFFF01)) + attr(32, struct.pack("!3I", 65000, 1, 2)) + attr(35, struct.pack("!I", 65002))


def table():
    peers = struct.pack("!4sH", b"\1\1\1\1", 0) + struct.pack("!H", 1) + bytes([2]) + b"\2\2\2\2" + bytes([198, 51, 100, 1]) + struct.pack("!I", 65001)
    entry = struct.pack("!HIH", 0, 0, len(ATTRS)) + ATTRS
    v6 = path(65001, kind=1)
    return mrt(13, 1, peers) + mrt(13, 2, struct.pack("!I", 0) + bytes([24, 192, 0, 2]) + struct.pack("!H", 1) + entry) + mrt(13, 4, struct.pack("!I", 1) + bytes([32, 0x20, 1, 0xD, 0xB8]) + struct.pack("!H", 1) + struct.pack("!HIH", 0, 0, len(v6)) + v6)


def test_table_dump(spark, tmp_path):
    (tmp_path / "a.mrt").write_bytes(table() + mrt(11, 0, b"other"))
    rows = wire.read_mrt(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["afi"], r["plen"], r["peer_asn"]) for r in rows] == [(1, 24, 65001), (2, 32, 65001)]
    a = rows[0]["attrs"]
    assert (rows[0]["p_lo"], a["as_path"], a["med"], a["otc"], a["communities"], a["large_communities"][0]["l2"], a["as_set"]) == (0xC0000200, [65001, 65002], 50, 65002, [65000 << 16 | 7, 0xFFFFFF01], 2, False)
    assert rows[1]["p_hi"] == 0x20010DB800000000 and rows[1]["attrs"]["as_set"]


@pytest.mark.parametrize("pack", [lambda b: ("m.mrt", b), lambda b: ("m.mrt.gz", gzip.compress(b)), lambda b: ("m.mrt.bz2", bz2.compress(b))])
def test_messages_and_fold(spark, tmp_path, pack):
    flow = bytes([12]) + bytes.fromhex("01180a00010381110581350a")[:12]
    reach = attr(14, struct.pack("!HBBB", 1, 133, 0, 0) + flow, 0x80)
    data = bgp4mp(bgp(attrs=ATTRS, nlri=bytes([8, 10, 16, 172, 16]))) + bgp4mp(bgp(withdrawn=bytes([8, 10]))) + bgp4mp(bgp(attrs=path(65001) + reach)) + bgp4mp(bgp(withdrawn=bytes([24, 9, 9, 9])))
    name, content = pack(data)
    (tmp_path / name).write_bytes(content)
    rows = wire.read_mrt(spark, str(tmp_path))
    assert [r["kind"] for r in rows.orderBy("ord").collect()] == ["announce", "announce", "withdraw", "announce", "withdraw"]
    rib = {(r["safi"], r["plen"], r["p_lo"]): r for r in fold(wire.as_events(rows)).collect()}
    assert {k: r["status"] for k, r in rib.items()} == {(1, 8, 10 << 24): "withdrawn", (1, 16, 0xAC100000): "active", (133, 24, 0x0A000100): "active"}
    assert rib[133, 24, 0x0A000100]["nlri_raw"] == bytes.fromhex("01180a00010381110581350a")


def test_state_change_withdraws(spark, tmp_path):
    down = mrt(16, 5, struct.pack("!IIHH", 65001, 65000, 0, 1) + bytes([192, 0, 2, 1, 192, 0, 2, 2]) + struct.pack("!HH", 6, 1))
    (tmp_path / "a.mrt").write_bytes(bgp4mp(bgp(attrs=ATTRS, nlri=bytes([8, 10]))) + down)
    assert [r["status"] for r in fold(wire.as_events(wire.read_mrt(spark, str(tmp_path)))).collect()] == ["withdrawn"]


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.mrt").write_bytes(table()[:-3])
    with pytest.raises(Exception, match="cut off"):
        wire.read_mrt(spark, str(tmp_path)).collect()
    assert wire.file_digests(spark, str(tmp_path)).count() == 1


def pph(flags=0, asn=65010):
    return bytes([0, flags]) + b"\0" * 8 + b"\0" * 12 + bytes([10, 0, 0, 1]) + struct.pack("!I", asn) + b"\1\1\1\1" + struct.pack("!II", 7, 500000)


def frame(kind, body):
    return struct.pack("!BIB", 3, 6 + len(body), kind) + body


def test_bmp(spark, tmp_path):
    two = bgp(attrs=path(65010, 65011, width="H"), nlri=bytes([16, 10, 1]))  # two-byte ASNs, though the header says four
    data = frame(4, b"") + frame(3, pph() + b"open") + frame(0, pph() + bgp(attrs=ATTRS, nlri=bytes([8, 10]))) + frame(0, pph() + two) + frame(0, pph(0x40) + bgp(attrs=ATTRS, nlri=bytes([8, 11]))) + frame(2, pph() + b"\1")
    (tmp_path / "a.bmp").write_bytes(data)
    rows = wire.read_bmp(spark, str(tmp_path))
    got = [(r["kind"], r["peer_address"], r["peer_flags"]) for r in rows.orderBy("ord").collect()]
    assert got == [("initiation", None, None), ("peer_up", "10.0.0.1", 0), ("announce", "10.0.0.1", 0), ("announce", "10.0.0.1", 0), ("announce", "10.0.0.1", 64), ("peer_down", "10.0.0.1", 0)]
    assert [r["attrs"]["as_path"] for r in rows.where("plen = 16").collect()] == [[65010, 65011]]
    state = sorted((r["p_lo"] >> 24, r["status"]) for r in fold(wire.as_events(rows)).where("plen = 8").collect())
    assert state == [(10, "withdrawn"), (11, "withdrawn")]  # a peer's down takes all its tables
    (tmp_path / "b.bmp").write_bytes(data[:-1])
    with pytest.raises(Exception, match="bad BMP frame"):
        wire.read_bmp(spark, str(tmp_path)).collect()


def test_family_gate_and_wide_asns(spark, tmp_path):
    """Multicast of MRT updates is dropped; a two-byte session's wide path stands for the path's end."""
    multicast = attr(14, struct.pack("!HBBI", 1, 2, 4, 0) + b"\0" + bytes([8, 20]), 0x80)
    narrow = path(65001, 23456, 23456, width="H") + attr(17, struct.pack("!BBII", 2, 2, 200001, 200002), 0xC0)
    two = mrt(16, 1, struct.pack("!HHHH", 65001, 65000, 0, 1) + bytes([192, 0, 2, 1, 192, 0, 2, 2]) + bgp(attrs=narrow, nlri=bytes([8, 30])))
    (tmp_path / "a.mrt").write_bytes(bgp4mp(bgp(attrs=path(65001) + multicast, nlri=bytes([8, 10]))) + two)
    rows = wire.read_mrt(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["p_lo"] >> 24, r["attrs"]["as_path"]) for r in rows] == [(10, [65001]), (30, [65001, 200001, 200002])]


def test_rib_generic(spark, tmp_path):
    flow = bytes.fromhex("0b01180a0001038106048135")[:12]
    entry = struct.pack("!HIH", 0, 0, len(ATTRS)) + ATTRS
    generic = lambda safi, nlri: mrt(13, 6, struct.pack("!IHB", 7, 1, safi) + nlri + struct.pack("!H", 1) + entry)
    (tmp_path / "a.mrt").write_bytes(table() + generic(133, flow) + generic(1, bytes([8, 44])) + generic(128, bytes([8, 45])))
    rows = wire.read_mrt(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["safi"], r["plen"]) for r in rows][2:] == [(133, 24), (1, 8)] and bytes(rows[2]["nlri_raw"]) == flow[1:]


def addpath(nlri):
    return mrt(16, 9, struct.pack("!IIHH", 65001, 65000, 0, 1) + bytes([192, 0, 2, 1, 192, 0, 2, 2]) + bgp(attrs=ATTRS, nlri=nlri))


def test_down_takes_path_children(spark, tmp_path):
    down = mrt(16, 5, struct.pack("!IIHH", 65001, 65000, 0, 1) + bytes([192, 0, 2, 1, 192, 0, 2, 2]) + struct.pack("!HH", 6, 1))
    (tmp_path / "a.mrt").write_bytes(addpath(struct.pack("!IBB", 11, 8, 10)) + addpath(struct.pack("!IBB", 22, 8, 10)) + down)
    (tmp_path / "b.mrt").write_bytes(addpath(struct.pack("!IBB", 22, 8, 10)))
    states = [r["status"] for r in fold(wire.as_events(wire.read_mrt(spark, str(tmp_path / "a.mrt")))).collect()]
    assert states == ["withdrawn", "withdrawn"]
    assert sorted(r["status"] for r in fold(wire.as_events(wire.read_mrt(spark, str(tmp_path)))).collect()) == ["active", "withdrawn"]


def test_bmp_session_ends(spark, tmp_path):
    """What a session tells of itself, statistics, and its end, which takes all peers of this capture but of no other."""
    told = struct.pack("!HH", 2, 2) + b"r1" + struct.pack("!HH", 1, 3) + b"one" + struct.pack("!HH", 1, 3) + b"two"
    stats = struct.pack("!I", 2) + struct.pack("!HHI", 0, 4, 5) + struct.pack("!HHQ", 7, 8, 9)
    data = frame(4, told) + frame(1, pph() + stats) + frame(0, pph() + bgp(attrs=ATTRS, nlri=bytes([8, 10]))) + frame(0, pph(asn=65020) + bgp(attrs=ATTRS, nlri=bytes([8, 11])))
    (tmp_path / "a.bmp").write_bytes(data + frame(5, struct.pack("!HHH", 1, 2, 1)))
    (tmp_path / "b.bmp").write_bytes(data)
    rows = wire.read_bmp(spark, str(tmp_path))
    info = {r["kind"]: r["info"] for r in rows.where("info IS NOT NULL").collect()}
    assert info == {"initiation": '{"sysName": "r1", "sysDescr": "one|two"}', "peer_stats": '{"0": 5, "7": 9}', "termination": '{"reason": "1"}'}
    got = sorted((r["status"], r["p_lo"] >> 24) for r in fold(wire.as_events(rows)).collect())
    assert got == [("active", 10), ("active", 11), ("withdrawn", 10), ("withdrawn", 11)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.dump").write_bytes(b"".join(bytes(16) + len(f).to_bytes(8, "big") + f for f in (frame(4, told), frame(0, pph() + bgp(attrs=ATTRS, nlri=bytes([8, 10]))))))
    assert [r["kind"] for r in wire.read_bmp_dump(spark, str(tmp_path / "d")).orderBy("ord").collect()] == ["initiation", "announce"]


def test_vrp_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("ASN,IP Prefix,Max Length,Trust Anchor\nAS65001,192.0.2.0/24,26,x\n65002,2001:db8::/32,,x\nAS1,broken,24,x\n")
    (tmp_path / "v.json").write_text('{"roas": [{"asn": "AS65001", "prefix": "192.0.2.0/24", "maxLength": 26, "ta": "x"}, {"asn": 65002, "prefix": "2001:db8::/32", "ta": "x"}]}')
    for rows in (wire.vrps_csv(spark, str(tmp_path / "v.csv")), wire.vrps_json(spark, str(tmp_path / "v.json"))):
        got = sorted(tuple(r) for r in rows.collect())
        assert got == [(1, 24, 0, 0xC0000200, 65001, 26), (2, 32, 0x20010DB800000000, 0, 65002, None)]


def test_small_pieces_share_batches(spark):
    """A batch is dear: many pieces of one record each leave the task together, in order, full batches first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    one = bgp4mp(bgp(attrs=ATTRS, nlri=b"\x18\x0a\x00\x00"))
    pieces = [pa.record_batch({"path": [f"{k}-{j}" for j in range(2000)], "content": [one] * 2000}) for k in range(3)]
    out = list(wire._decoder(wire.mrt_records, to_arrow_schema(StructType.fromDDL(wire.COLUMNS)))(iter(pieces)))
    assert [b.num_rows for b in out] == [wire.ROWS, 6000 - wire.ROWS]
    assert [p for b in out for p in b.column("path").to_pylist()] == [f"{k}-{j}" for k in range(3) for j in range(2000)]
