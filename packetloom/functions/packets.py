"""Column expressions on packet and flow fields (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TCP, UDP = 6, 17
INFINITY = float("inf")

# Flag bits of the TCP header.
TCP_FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}

# IANA numbers of the protocol names a ground-truth file uses.
PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def port_of(tcp_port: Column | str, udp_port: Column | str) -> Column:
    """The TCP port, else the UDP port, else 0."""
    return F.coalesce(_col(tcp_port), _col(udp_port), F.lit(0)).cast("int")


def flags_from_hex(text: Column | str) -> Column:
    """``0x…`` to an integer; anything else is 0."""
    text = F.trim(_col(text))
    digits = F.conv(F.substring(text, 3, 16), 16, 10).cast("int")
    return F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), digits).otherwise(F.lit(0))


def payload_length(protocol, tcp_len, udp_length, ip_len, ip_hdr_len) -> Column:
    """Bytes above the transport header; above the IP header for other protocols."""
    protocol = _col(protocol)
    return (
        F.when(protocol == TCP, _col(tcp_len))
        .when(protocol == UDP, F.greatest(_col(udp_length) - 8, F.lit(0)))
        .otherwise(F.greatest(_col(ip_len) - _col(ip_hdr_len), F.lit(0)))
        .cast("int")
    )


def canonical_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port"):
    """``(sender is b, ip_a, ip_b, port_a, port_b)``; a is the lower (address text, port)."""
    sip, sp, dip, dp = _col(src_ip), _col(src_port), _col(dst_ip), _col(dst_port)
    from_b = (sip > dip) | ((sip == dip) & (sp > dp))
    pick = lambda yes, no: F.when(from_b, yes).otherwise(no)
    return from_b, pick(dip, sip), pick(sip, dip), pick(dp, sp), pick(sp, dp)


def endpoint_key(protocol, src_ip, src_port, dst_ip, dst_port) -> Column:
    """Direction-free text key ``protocol|low|high`` with ``address:port`` ends."""
    one = F.concat_ws(":", _col(src_ip), _col(src_port).cast("string"))
    two = F.concat_ws(":", _col(dst_ip), _col(dst_port).cast("string"))
    return F.concat_ws("|", _col(protocol).cast("string"), F.least(one, two), F.greatest(one, two))


def seconds_to_micros(seconds: Column | str) -> Column:
    """Epoch seconds to whole microseconds, ties to even."""
    return F.rint(_col(seconds).cast("double") * 1e6).cast("long")


def protocol_number(name: Column | str) -> Column:
    name = F.lower(F.trim(_col(name)))
    chain = F.lit(-1)
    for text, number in PROTOCOL_NUMBERS.items():
        chain = F.when(name == text, F.lit(number)).otherwise(chain)
    return chain


def has_flag(flags: Column | str, name: str) -> Column:
    return _col(flags).bitwiseAND(F.lit(TCP_FLAG_BITS[name])) != 0


def rate_per_second(amount: Column | str, duration_us: Column | str) -> Column:
    """amount/s; infinite for something in no time, 0 for nothing in no time."""
    amount, duration = _col(amount).cast("double"), _col(duration_us).cast("double")
    return (
        F.when(duration > 0, amount * 1e6 / duration)
        .when(amount > 0, F.lit(INFINITY))
        .otherwise(F.lit(0.0))
    )


def ratio_or_zero(top: Column | str, bottom: Column | str) -> Column:
    bottom = _col(bottom)
    return F.when(bottom > 0, _col(top).cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def capture_host(name: Column | str) -> Column:
    """The IPv4 address inside a capture name, NULL when an octet is not valid."""
    text = F.regexp_extract(_col(name), r"(\d{1,3}(?:\.\d{1,3}){3})", 1)
    octets = F.split(text, r"\.")
    # An octet with a leading zero is not an address either.
    valid = F.forall(
        octets,
        lambda o: o.rlike("^(0|[1-9][0-9]{0,2})$") & (F.coalesce(o.try_cast("int"), F.lit(999)) <= 255),
    )
    return F.when((text != "") & valid, text)


def ipv4_number(address: Column | str) -> Column:
    """Numeric order of dotted addresses (text order puts .10 before .9)."""
    return F.aggregate(
        F.split(_col(address), r"\."),
        F.lit(0).cast("long"),
        lambda acc, octet: acc * 256 + F.coalesce(octet.try_cast("long"), F.lit(0)),
    )


def finite_or(policy: str, value: Column | str) -> Column:
    """Non-finite numbers: ``null`` (then drop the row), or ``zero``."""
    value = _col(value).cast("double")
    bad = F.isnan(value) | (F.abs(value) == INFINITY)
    if policy == "null":
        return F.when(~bad, value)
    if policy == "zero":
        return F.when(value.isNull() | bad, F.lit(0.0)).otherwise(value)
    raise ValueError(f"unknown policy {policy!r}")


def apply_finite_policy(df: DataFrame, columns: list[str], policy: str) -> DataFrame:
    """``drop``: rows with a non-finite or missing feature go; ``zero``: they become 0."""
    mode = "null" if policy == "drop" else policy
    fixed = df.select(*[
        finite_or(mode, c).alias(c) if c in columns else F.col(c) for c in df.columns
    ])
    return fixed.dropna(subset=columns) if policy == "drop" else fixed


def on_either_side(address: Column | str | None = None, **names) -> Column:
    """The address takes part in the packet."""
    src, dst = names.get("src", "src_ip"), names.get("dst", "dst_ip")
    return (F.col(src) == address) | (F.col(dst) == address)


def inside_window(ts_us: Column | str, start_us: Column | int, end_us: Column | int) -> Column:
    return _col(ts_us).between(start_us, end_us)


def port_on(side: str, port: Column | int) -> Column:
    if side == "src":
        return F.col("src_port") == port
    if side == "dst":
        return F.col("dst_port") == port
    return (F.col("src_port") == port) | (F.col("dst_port") == port)


def is_internal(address: Column | str, prefix: str = "172.31.") -> Column:
    return _col(address).startswith(prefix)


def hashed_offset(name: Column | str) -> Column:
    """A stable per-scenario id offset between 1e12 and 9e15, from SHA-1."""
    head = F.conv(F.substring(F.sha1(_col(name).cast("binary")), 1, 8), 16, 10).cast("long")
    return (head % 9000) * 1_000_000_000_000 + 1_000_000_000_000


def flow_key(part: Column | str, flow_id: Column | str) -> Column:
    return F.concat_ws("_", _col(part), _col(flow_id).cast("string"))


def est_clock_to_micros(day: Column | str, clock: Column | str) -> Column:
    """``Name-dd-mm-yyyy`` plus ``HH:MM`` at UTC−5, as epoch microseconds."""
    date = F.substring_index(_col(day), "-", -3)
    text = F.concat_ws(" ", date, _col(clock), F.lit("-05:00"))
    return F.unix_micros(F.to_timestamp(text, "dd-MM-yyyy HH:mm xxx"))


def utc_clock_to_micros(date: Column | str, clock: Column | str) -> Column:
    """``yyyy-MM-dd`` plus ``HH:MM:SS`` in UTC, as epoch microseconds."""
    text = F.concat_ws(" ", _col(date), _col(clock), F.lit("+00:00"))
    return F.unix_micros(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss xxx"))


def day_date(day: Column | str) -> Column:
    """Date of a ``Name-dd-mm-yyyy`` day label."""
    return F.to_date(F.substring_index(_col(day), "-", -3), "dd-MM-yyyy")
