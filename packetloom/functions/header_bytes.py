"""Columns over IPv4 packets as BINARY: link layer, masks, checksum, padding.

Everything is built from ``substring``, ``overlay``, ``hex`` and ``conv``; ranges past
the end of a packet are clipped, so lengths never change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP, UDP = 6, 17
ETHERNET, LINUX_COOKED = 1, 113
N_BYTES = 256

# Header regions by the score they cost when occluded.
MASK_LADDER = ("ip_checksum", "tcp_options", "ip_ttl", "ip_id", "tcp_window")

# The byte regions of the occlusion sweep, (name, start, end).
OCCLUSION_REGIONS = (
    ("ip_ver_ihl", 0, 1), ("ip_tos", 1, 2), ("ip_total_len", 2, 4), ("ip_id", 4, 6),
    ("ip_flags_frag", 6, 8), ("ip_ttl", 8, 9), ("ip_proto", 9, 10), ("ip_checksum", 10, 12),
    ("ip_src", 12, 16), ("ip_dst", 16, 20), ("tcp_sport", 20, 22), ("tcp_dport", 22, 24),
    ("tcp_seq", 24, 28), ("tcp_ack", 28, 32), ("tcp_off_flags", 32, 34), ("tcp_window", 34, 36),
    ("tcp_checksum", 36, 38), ("tcp_urgent", 38, 40), ("tcp_options", 40, 60),
    ("payload_60_128", 60, 128), ("payload_128_192", 128, 192), ("payload_192_256", 192, 256),
)


def _int(c: Column | int) -> Column:
    return F.lit(c) if isinstance(c, int) else c


def byte_at(packet: Column, at: Column | int) -> Column:
    """Unsigned value of byte ``at`` (0-based); NULL past the end."""
    text = F.hex(F.substring(packet, _int(at) + 1, F.lit(1)))
    return F.when(text != "", F.conv(text, 16, 10).cast("int"))


def zeros(count: Column | int) -> Column:
    """``count`` zero bytes, however many; none for a negative count."""
    return F.unhex(F.repeat(F.lit("00"), _int(count)))


def _patch(masked: Column, packet: Column, start: Column | int, end: Column | int, where: Column | None = None) -> Column:
    """Zero [start, end) of ``masked`` where the condition holds, clipped to the packet.

    ``masked`` appears once, so a chain of patches stays linear in size; nothing to
    zero means a patch of no bytes.
    """
    start = _int(start)
    count = F.greatest(F.least(_int(end), F.octet_length(packet)) - start, F.lit(0))
    if where is not None:
        count = F.when(where, count).otherwise(F.lit(0))
    count = F.coalesce(count, F.lit(0))
    return F.overlay(masked, zeros(count), F.coalesce(start, F.lit(0)) + 1, count)


def zero_range(packet: Column, start: Column | int, end: Column | int) -> Column:
    """Bytes [start, end) set to zero, clipped to the packet."""
    return _patch(packet, packet, start, end)


def header_length(packet: Column) -> Column:
    return byte_at(packet, 0).bitwiseAND(F.lit(15)) * 4


def has_sane_header(packet: Column) -> Column:
    return (F.octet_length(packet) >= 20) & header_length(packet).between(20, 60)


def protocol_byte(packet: Column) -> Column:
    return byte_at(packet, 9)


def tcp_header_length(packet: Column, base: Column) -> Column:
    return F.coalesce(F.shiftright(byte_at(packet, base + 12), 4), F.lit(0)) * 4


def _zero_ports(masked: Column, packet: Column) -> Column:
    base = header_length(packet)
    fits = has_sane_header(packet) & protocol_byte(packet).isin(TCP, UDP) & (base + 4 <= F.octet_length(packet))
    return _patch(masked, packet, base, base + 4, fits)


def mask_addresses(packet: Column) -> Column:
    """Addresses and TCP/UDP ports to zero."""
    return _zero_ports(_patch(packet, packet, 12, 20, has_sane_header(packet)), packet)


def _zero_tcp_options(masked: Column, packet: Column, inside: bool) -> Column:
    """TCP options to zero. ``inside``: only when they lie within the packet."""
    base = header_length(packet)
    offset = tcp_header_length(packet, base)
    has = has_sane_header(packet) & (protocol_byte(packet) == TCP) & (offset > 20) & (offset <= 60)
    if inside:
        has = has & (base + offset <= F.octet_length(packet))
    return _patch(masked, packet, base + 20, base + offset, has)


def _zero_identity(masked: Column, packet: Column) -> Column:
    """Version nibble, service type, identification, protocol and IP options."""
    sane = has_sane_header(packet)
    first = F.unhex(F.concat(F.lit("0"), F.substring(F.hex(F.substring(packet, 1, 1)), 2, 1)))
    size = F.coalesce(F.when(sane, F.lit(1)), F.lit(0))
    masked = F.overlay(masked, F.substring(first, F.lit(1), size), F.lit(1), size)
    for start, end in ((1, 2), (4, 6), (9, 10)):
        masked = _patch(masked, packet, start, end, sane)
    return _patch(masked, packet, 20, header_length(packet), sane)


def mask_strict(packet: Column) -> Column:
    """The address mask plus every field that identifies a host or its software."""
    masked = _zero_identity(mask_addresses(packet), packet)
    return _zero_tcp_options(masked, packet, inside=True)


def derive_strict(packet: Column, checksum_too: bool = False) -> Column:
    """The strict mask made from stored, already address-masked bytes; options are
    clipped at the stored length."""
    masked = _patch(packet, packet, 10, 12, has_sane_header(packet)) if checksum_too else packet
    return _zero_tcp_options(_zero_identity(masked, packet), packet, inside=False)


def derive_ladder(packet: Column, steps: int) -> Column:
    """The first ``steps`` regions of the ladder to zero, cumulatively."""
    if not 1 <= steps <= len(MASK_LADDER):
        raise ValueError(f"1 to {len(MASK_LADDER)} steps, got {steps}")
    todo, sane = MASK_LADDER[:steps], has_sane_header(packet)
    masked = packet
    for name, start, end in (("ip_checksum", 10, 12), ("ip_ttl", 8, 9), ("ip_id", 4, 6)):
        if name in todo:
            masked = _patch(masked, packet, start, end, sane)
    if "tcp_window" in todo:
        base = header_length(packet)
        masked = _patch(masked, packet, base + 14, base + 16, sane & (protocol_byte(packet) == TCP))
    return _zero_tcp_options(masked, packet, inside=False) if "tcp_options" in todo else masked


def ipv4_checksum(packet: Column) -> Column:
    """Header checksum (0..65535) with its own field taken as zero.

    2^16 leaves remainder 1 modulo 65535, so the ones' complement sum of the words is
    the remainder of any longer chunk of them: six bytes are read at a time.
    """
    base = header_length(packet)
    chunk = lambda at, size: F.conv(F.hex(F.substring(packet, F.lit(at + 1), _int(size))), 16, 10).cast("long")
    total = chunk(0, 6) + chunk(6, 4) + chunk(12, 6) + chunk(18, 2)
    options = sum(
        (F.when(base > at, chunk(at, F.least(base - at, F.lit(6)))).otherwise(F.lit(0)) for at in range(20, 60, 6)), F.lit(0)
    )
    total = total + F.when(base > 20, options).otherwise(F.lit(0))
    return F.when(has_sane_header(packet), F.lit(65_534) - (total - 1) % 65_535)


def repair_checksum(packet: Column) -> Column:
    fixed = F.unhex(F.lpad(F.hex(ipv4_checksum(packet)), 4, "0"))
    return F.when(has_sane_header(packet), F.overlay(packet, fixed, F.lit(11), F.lit(2))).otherwise(packet)


def to_fixed_length(packet: Column, size: int = N_BYTES) -> Column:
    """First ``size`` bytes, zero padded; NULL (no frame) becomes all zeros."""
    head = F.coalesce(F.substring(packet, 1, size), F.unhex(F.lit("")))
    return F.concat(head, zeros(F.lit(size) - F.octet_length(head)))


def strip_ethernet(frame: Column) -> Column:
    """IPv4 packet behind Ethernet and at most one 802.1Q tag, else NULL."""
    kind = F.hex(F.substring(frame, 13, 2))
    inner = F.hex(F.substring(frame, 17, 2))
    rest = lambda at: F.substring(frame, F.lit(at), F.octet_length(frame))
    return F.when(kind == "0800", rest(15)).when((kind == "8100") & (inner == "0800"), rest(19))


def strip_linux_cooked(frame: Column) -> Column:
    """IPv4 packet behind a Linux cooked header and at most one tag, else NULL."""
    kind = F.hex(F.substring(frame, 15, 2))
    inner = F.hex(F.substring(frame, 19, 2))
    rest = lambda at: F.substring(frame, F.lit(at), F.octet_length(frame))
    return F.when(kind == "0800", rest(17)).when((kind == "8100") & (inner == "0800"), rest(21))


def strip_link(frame: Column, link_type: Column) -> Column:
    """IPv4 packet by link type; any type but Linux cooked is read as Ethernet."""
    return F.when(link_type == LINUX_COOKED, strip_linux_cooked(frame)).otherwise(strip_ethernet(frame))
