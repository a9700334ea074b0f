import struct

import pytest
from pyspark.sql import functions as F

from packetloom.functions import header_bytes as hb
from packetloom.sources import frames as fr


def one(spark, packet, make):
    row = spark.createDataFrame([(bytearray(packet),)], "b binary").select(make(F.col("b")).alias("x")).first()
    return bytes(row.x) if isinstance(row.x, (bytes, bytearray)) else row.x


def ip(ihl=5, proto=6, body=b"", size=None):
    head = bytes([0x40 | ihl, 1, 0, 99, 7, 8, 0x40, 0, 64, proto, 0xBE, 0xEF, *range(1, 9)]) + b"\x11" * max(0, ihl * 4 - 20)
    return (head + body)[:size]


def tcp(offset=5, options=b""):
    return bytes([1, 2, 3, 4, 0, 0, 0, 1, 0, 0, 0, 2, offset << 4, 0x10, 9, 9, 5, 5, 0, 0]) + options


def plain_basic(p):
    ihl = (p[0] & 15) * 4 if p else 0
    if len(p) < 20 or not 20 <= ihl <= 60:
        return p
    out = bytearray(p)
    out[12:20] = bytes(8)
    if p[9] in (6, 17) and ihl + 4 <= len(p):
        out[ihl:ihl + 4] = bytes(4)
    return bytes(out)


def plain_strict(p):
    ihl = (p[0] & 15) * 4 if p else 0
    if len(p) < 20 or not 20 <= ihl <= 60:
        return p
    out = bytearray(plain_basic(p))
    out[0] &= 15
    for at in (1, 4, 5, 9, *range(20, min(ihl, len(p)))):
        out[at] = 0
    if p[9] == 6 and ihl + 20 <= len(p):
        off = (p[ihl + 12] >> 4) * 4
        if 20 < off <= 60 and ihl + off <= len(p):
            out[ihl + 20:ihl + off] = bytes(off - 20)
    return bytes(out)


PACKETS = [
    ip(size=19), ip(ihl=4, body=tcp()), ip(body=tcp()), ip(ihl=6, body=tcp(15, b"\x22" * 40)), ip(body=tcp(8, b"\x22" * 12) + b"pay"),
    ip(body=tcp(8, b"\x22" * 5)), ip(proto=17, body=b"\x01\x02\x03\x04\x05\x06\x07\x08zz"), ip(proto=1, body=b"ping"), ip(proto=17, body=b"\x01\x02"),
    ip(ihl=15, size=30), ip(body=tcp()[:11]),
]


@pytest.mark.parametrize("at", range(len(PACKETS)))
def test_masks_match_a_plain_version(spark, at):
    p = PACKETS[at]
    assert one(spark, p, hb.mask_addresses) == plain_basic(p)
    assert one(spark, p, hb.mask_strict) == plain_strict(p)
    twice = one(spark, one(spark, p, hb.mask_addresses), hb.mask_addresses)
    assert twice == plain_basic(p) and len(twice) == len(p)


def test_checksum_vector(spark):
    head = bytes.fromhex("45000073000040004011" + "0000" + "C0A80001C0A800C7")
    assert one(spark, head, hb.ipv4_checksum) == 0xB861
    assert one(spark, head, hb.repair_checksum)[10:12] == b"\xb8\x61"


def test_checksum_with_options_against_word_sum(spark):
    p = ip(ihl=9, body=b"x")
    total = sum(int.from_bytes(p[i:i + 2], "big") for i in range(0, 36, 2) if i != 10)
    while total > 0xFFFF:
        total = (total & 0xFFFF) + (total >> 16)
    assert one(spark, p, hb.ipv4_checksum) == 0xFFFF - total


def test_derived_masks(spark):
    p = plain_basic(ip(body=tcp(8, b"\x22" * 12))).ljust(256, b"\x00")
    top = lambda k: one(spark, p, lambda b: hb.derive_ladder(b, k))
    assert top(1)[10:12] == b"\0\0" and top(1)[40:52] == b"\x22" * 12
    assert top(2)[40:52] == bytes(12) and top(3)[8] == 0 and top(4)[4:6] == b"\0\0" and top(5)[34:36] == b"\0\0"
    assert one(spark, p, hb.derive_strict)[:20] == plain_strict(ip(body=tcp(8, b"\x22" * 12)))[:20]


def test_fixed_length(spark):
    assert one(spark, b"abc", lambda b: hb.to_fixed_length(b, 5)) == b"abc\0\0"
    assert one(spark, b"abcdef", lambda b: hb.to_fixed_length(b, 5)) == b"abcde"


def ethernet(packet, tag=False, kind=b"\x08\x00"):
    return bytes(12) + (b"\x81\x00\x00\x07" if tag else b"") + kind + packet


def pcap(frames, order="<", link=1):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 7, len(f), len(f)) + f
    return out


def pcapng(frames, link=1):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", link, 0, 0))
    for i, f in enumerate(frames):
        ts = (100 + i) * 1_000_000 + 7
        out += block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f + bytes(-len(f) % 4))
    return out


@pytest.mark.parametrize("make,range_bytes", [(pcap, 1 << 20), (pcap, 100), (pcapng, 1 << 20), (pcapng, 100)])
def test_frames_are_numbered_over_ipv4_only(spark, tmp_path, make, range_bytes):
    inner = [ip(proto=17, body=bytes([i]) * 9) for i in range(9)]
    frames = [ethernet(p, tag=i % 2 == 1) for i, p in enumerate(inner)]
    frames.insert(3, ethernet(b"arp", kind=b"\x08\x06"))
    (tmp_path / "day.pcap").write_bytes(make(frames))
    rows = fr.read_frames(spark, str(tmp_path), range_bytes).orderBy("capture_packet_index").collect()
    assert [r.capture_packet_index for r in rows] == list(range(9))
    assert [bytes(r.ip_bytes) for r in rows] == inner
    assert rows[0].ts_us == 100_000_007 and rows[0].capture_file == "day.pcap"
    assert fr.read_frames(spark, str(tmp_path), range_bytes, max_packets=4).count() == 4


def test_cooked_and_big_endian(spark, tmp_path):
    p = ip(proto=17, body=b"12345678")
    (tmp_path / "x.pcap").write_bytes(pcap([bytes(14) + b"\x08\x00" + p], ">", 113))
    assert bytes(fr.read_frames(spark, str(tmp_path)).first().ip_bytes) == p


def test_zeroed_ranges_keep_every_length(spark):
    from pyspark.sql import functions as F

    from packetloom.functions import header_bytes as hb

    rows = spark.range(0, 2001, 37).select(F.col("id").cast("int").alias("n"), F.unhex(F.repeat(F.lit("AB"), F.col("id").cast("int"))).alias("p"))
    got = rows.select("n", F.octet_length(hb.zero_range(F.col("p"), 0, 1000)).alias("m"), F.hex(hb.zero_range(F.col("p"), 0, 1000)).alias("h")).collect()
    assert all(r.m == r.n and r.h == "00" * min(r.n, 1000) + "AB" * max(r.n - 1000, 0) for r in got)
