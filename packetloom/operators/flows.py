"""Bidirectional flows from packets.

A packet opens a flow when it is the first of its capture and canonical 5-tuple,
when it lies more than the timeout after the START of the running flow, or when
the packet before it ended the flow: a TCP reset at once, TCP FINs once both sides
have sent one. The ending packet stays in its flow. The initiator is the sender of
the first packet of the 5-tuple and is kept by all later flows of that 5-tuple.

For a fixed packet the next flow start is the earlier of two positions that do not
depend on history: the first packet past the timeout and the packet after the
first terminating one. The kernel finds both for all rows with array operations and
then follows the links, one step per flow.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.packets import canonical_key, capture_host, ipv4_number
from packetloom.operators.ordered import MAX_KEY_ROWS, ordered_fold
from packetloom.operators.spans import FRESH, NEVER, SpanKernel, Steps, fold_in_spans

ACTIVE_TIMEOUT_SECONDS = 120.0
ACTIVE_GAP_SECONDS = 5.0
TCP, FIN, RST = 6, 1, 4

KEYS = ["capture_file", "ip_a", "ip_b", "port_a", "port_b", "protocol"]
ORDER = ["ts_us", "capture_packet_index"]
FLOW = ["capture_file", "flow_id"]

# What the fold adds to every packet. The values only look back within the flow,
# so they stay right under every cut to a prefix of the flow.
ADDED = T.StructType([
    T.StructField("flow_id", T.LongType()),
    T.StructField("packet_index", T.IntegerType()),
    T.StructField("forward", T.BooleanType()),
    T.StructField("initiator_is_b", T.BooleanType()),
    T.StructField("flow_start_us", T.LongType()),
    T.StructField("flow_total_packets", T.IntegerType()),
    T.StructField("iat_us", T.LongType()),
    T.StructField("side_iat_us", T.LongType()),
    T.StructField("active_us", T.LongType()),
    T.StructField("closed_active_us", T.LongType()),
])


def _next_true(mask: np.ndarray) -> np.ndarray:
    """For each row the first row at or after it where mask holds, else the length."""
    n = len(mask)
    at = np.where(mask, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def _last_true(mask: np.ndarray) -> np.ndarray:
    """For each row the last row at or before it where mask holds, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def _masked(values: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind, mask=~valid)


class FlowKernel(SpanKernel):
    """Which side started a key does not move any flow edge: a flow ends when both
    sides have sent a FIN, so edges are found before the initiator is known."""

    def __init__(self, timeout_us: int, gap_us: int):
        self.timeout_us = timeout_us
        self.gap_us = gap_us

    def _columns(self, table: pa.Table):
        get = lambda c: table.column(c).to_numpy()
        tcp = get("protocol") == TCP
        flags = get("tcp_flags")
        reset = tcp & ((flags & RST) != 0)
        fin = tcp & ((flags & FIN) != 0) & ~reset
        side = table.column("from_b").to_numpy(zero_copy_only=False).astype(bool)
        return get("ts_us"), get("capture_packet_index"), side, fin, reset

    def _piece(self, piece: pa.Table):
        """Rows of ONE key: times, ordinals, sides, the next FIN of a and of b, the row that ends a flow opened
        at each row, the last flow of the piece on the way from there, and for each mode the row that ends the flow
        running in."""
        ts, ordinal, side, fin, reset = self._columns(piece)
        n = len(ts)
        fin_a, fin_b, over = _next_true(fin & ~side), _next_true(fin & side), _next_true(reset)
        ends = np.minimum(over, np.maximum(fin_a, fin_b))
        after = np.minimum(ends + 1, np.searchsorted(ts, ts + self.timeout_us, side="right"))
        last = np.where(after < n, after, np.arange(n))
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        running = [int(min(over[0], e)) for e in (max(fin_a[0], fin_b[0]), fin_b[0], fin_a[0])]
        return ts, ordinal, side, fin_a, fin_b, ends, last, running

    def steps(self, piece: pa.Table) -> Steps:
        ts, ordinal, _, fin_a, fin_b, ends, last, running = self._piece(piece)
        n = len(ts)
        outlived = ts - self.timeout_us
        # a flow running in started no later than the first row, so it has expired by this row
        expired = int(np.searchsorted(outlived, ts[0], side="right"))
        parts = []
        for mode, end in enumerate(running):
            heads = np.arange(min(expired, end + 1, n - 1) + 1)
            upto, to = outlived[heads].copy(), last[heads]
            ended = ends[to] == n - 1
            start, head = np.where(ended, FRESH, ts[to]), np.where(ended, 0, ordinal[to])
            next_mode = np.where(ended, 0, (fin_a[to] < n) + 2 * (fin_b[to] < n))
            passes = np.zeros(len(heads), dtype=bool)
            if min(expired, end + 1) < n:
                upto[-1] = NEVER
            else:
                goes_on = end >= n
                left = (mode | int(fin_a[0] < n) | 2 * int(fin_b[0] < n)) if goes_on else 0
                upto, start, head = np.append(upto, NEVER), np.append(start, FRESH), np.append(head, 0)
                next_mode, passes = np.append(next_mode, left), np.append(passes, goes_on)
            since = np.concatenate([[FRESH], upto[:-1]])
            parts.append(Steps(np.full(len(upto), mode), since, upto, start, head, next_mode, passes).merged())
        return Steps.stacked(parts)

    def left(self, piece: pa.Table, start: int, head: int, mode: int) -> tuple:
        ts, ordinal, side, fin_a, fin_b, ends, last, running = self._piece(piece)
        n, end = len(ts), running[mode]
        first = min(int(np.searchsorted(ts - self.timeout_us, start, side="right")), end + 1)
        opened = first < n
        base = int(last[first]) if opened else 0
        paused = np.flatnonzero(np.diff(ts[base:]) > self.gap_us)
        segment = int(ts[base + paused[-1] + 1]) if len(paused) else int(ts[base]) if opened else None
        latest = lambda mine: int(ts[base:][mine][-1]) if mine.any() else None
        return (
            opened, int(ts[base]) if opened else None, int(ordinal[base]) if opened else None,
            bool(side[base]) if opened else None, n - base, latest(~side[base:]), latest(side[base:]),
            bool(fin_a[base] < n), bool(fin_b[base] < n), bool((ends[base] if opened else end) == n - 1),
            segment, int(ts[0]), int(ts[-1]), bool(side[0]),
        )

    def carry(self, row: dict):
        """The running flow as the few packets that later rows can still see: its first one and the last of each side."""
        seen = [(row["last_a"], False, row["fin_a"]), (row["last_b"], True, row["fin_b"])]
        later = sorted([s for s in seen if s[0] is not None])
        rows = [(row["start"], row["head"], row["head_side"], False, False)]
        rows += [(at, row["head"], side, fin, row["ended"] and i == len(later) - 1) for i, (at, side, fin) in enumerate(later)]
        kinds = (np.int64, np.int64, bool, bool, bool)
        return {
            "rows": tuple(np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds)),
            "count": row["count"], "initiator": row["initiator"], "segment": row["segment"],
        }

    def __call__(self, table: pa.Table, starts: np.ndarray, carry, open_end: bool):
        ts, ordinal, side, fin, reset = self._columns(table)
        pre = 0
        if carry is not None:
            past = carry["rows"]
            pre = len(past[0])
            ts, ordinal, side, fin, reset = (
                np.concatenate([old, new]) for old, new in zip(past, (ts, ordinal, side, fin, reset))
            )
            starts = np.concatenate([[0], starts[1:] + pre])
        n = len(ts)
        rows = np.arange(n)
        opens_key = np.zeros(n, dtype=bool)
        opens_key[starts] = True
        key_no = np.cumsum(opens_key) - 1
        starter = side[starts]
        if carry is not None:
            starter[0] = carry["initiator"]
        initiator = starter[key_no]
        forward = side == initiator

        ends = np.minimum(
            _next_true(reset), np.maximum(_next_true(fin & forward), _next_true(fin & ~forward))
        )
        # Elapsed time with every gap clipped just above the timeout: comparisons
        # with the timeout are unchanged and a new key always counts as expired.
        step = np.minimum(np.diff(ts), self.timeout_us + 1)
        step[opens_key[1:]] = self.timeout_us + 1
        clock = np.concatenate([[0], np.cumsum(step)])
        expires = np.searchsorted(clock, clock + self.timeout_us, side="right")
        after = np.minimum(ends + 1, expires).tolist()

        heads, at = [], 0
        while at < n:
            heads.append(at)
            at = after[at]
        heads = np.array(heads, dtype=np.int64)
        opens = np.zeros(n, dtype=bool)
        opens[heads] = True
        flow_no = np.cumsum(opens) - 1
        head = heads[flow_no]
        index = rows - head
        size = np.diff(np.append(heads, n))
        known_size = np.ones(len(heads), dtype=bool)
        if carry is not None:
            index[flow_no == 0] += carry["count"] - pre
            known_size[0] = False
        if open_end:
            known_size[-1] = False

        iat = np.concatenate([[0], np.diff(ts)])
        prior_fwd = np.concatenate([[-1], _last_true(forward)[:-1]])
        prior_bwd = np.concatenate([[-1], _last_true(~forward)[:-1]])
        prior = np.where(forward, prior_fwd, prior_bwd)
        has_prior = prior >= head
        side_iat = ts - ts[np.maximum(prior, 0)]

        pause = ~opens & (iat > self.gap_us)
        seg_open = ts[np.maximum.accumulate(np.where(opens | pause, rows, 0))]
        if carry is not None:
            # The carried rows stand for more packets than they are: pauses among
            # them are not real ones, the open segment start is handed over.
            pause[:pre] = False
            real = np.maximum.accumulate(np.where(opens | pause, rows, 0))
            seg_open = np.where(real == 0, carry["segment"], ts[real])
        closed = np.zeros(n, dtype=np.int64)
        closed[1:] = ts[:-1] - seg_open[:-1]

        keep = slice(pre, n)
        out = table
        added = {
            "flow_id": pa.array(ordinal[head][keep], type=pa.int64()),
            "packet_index": pa.array(index[keep], type=pa.int32()),
            "forward": pa.array(forward[keep]),
            "initiator_is_b": pa.array(initiator[keep]),
            "flow_start_us": pa.array(ts[head][keep], type=pa.int64()),
            "flow_total_packets": _masked(size[flow_no][keep].astype(np.int32), known_size[flow_no][keep], pa.int32()),
            "iat_us": _masked(iat[keep], ~opens[keep], pa.int64()),
            "side_iat_us": _masked(side_iat[keep], has_prior[keep], pa.int64()),
            "active_us": pa.array((ts - seg_open)[keep], type=pa.int64()),
            "closed_active_us": _masked(closed[keep], pause[keep], pa.int64()),
        }
        for name, column in added.items():
            out = out.append_column(name, column)
        return out, None


def with_canonical_key(packets: DataFrame) -> DataFrame:
    """Order the two endpoints and drop the directional columns they replace."""
    from_b, a_ip, b_ip, a_port, b_port = canonical_key()
    return packets.select(
        "*", from_b.alias("from_b"), a_ip.alias("ip_a"), b_ip.alias("ip_b"),
        a_port.alias("port_a"), b_port.alias("port_b"),
    ).drop("src_ip", "dst_ip", "src_port", "dst_port")


def group_into_flows(
    packets: DataFrame,
    carry: Sequence[str] | None = None,
    active_timeout_seconds: float = ACTIVE_TIMEOUT_SECONDS,
    active_gap_seconds: float = ACTIVE_GAP_SECONDS,
    max_key_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Packets with their flow, position, direction and look-back values.

    ``carry`` names the packet columns to keep besides those the grouping needs
    (default: all); a short list keeps the single shuffle narrow. A flow is
    identified by ``(capture_file, flow_id)`` where ``flow_id`` is the ordinal of
    its first packet, unique within a capture.
    """
    own = ["capture_file", "capture_packet_index", "ts_us", "src_ip", "dst_ip",
           "src_port", "dst_port", "protocol", "tcp_flags"]
    extra = [c for c in (packets.columns if carry is None else carry) if c not in own]
    keyed = with_canonical_key(packets.select(*own, *extra))
    kernel = FlowKernel(round(active_timeout_seconds * 1e6), round(active_gap_seconds * 1e6))
    schema = T.StructType(keyed.schema.fields + ADDED.fields)
    grouped = ordered_fold(keyed, KEYS, ORDER, kernel, schema, max_key_rows, _edge_totals, fold_in_spans)
    return _restore_endpoints(grouped, extra)


def _edge_totals(grouped: DataFrame) -> DataFrame:
    """Packet totals of flows that cross a chunk edge (at most two per chunk)."""
    totals = (
        grouped.where(F.col("flow_total_packets").isNull())
        .groupBy(*FLOW)
        .agg((F.max("packet_index") + 1).alias("_total"))
    )
    return grouped.join(totals, FLOW, "left").select(*[
        F.coalesce(F.col(c), F.col("_total")).cast("int").alias(c) if c == "flow_total_packets" else F.col(c)
        for c in grouped.columns
    ])


def _restore_endpoints(grouped: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Directional columns again. The flow's far end is chosen by address alone, so
    with one address on both ends it is always endpoint b."""
    from_b, start_b = F.col("from_b"), F.col("initiator_is_b")
    flow_src_ip = F.when(start_b, F.col("ip_b")).otherwise(F.col("ip_a"))
    a_is_src = F.col("ip_a") == flow_src_ip
    pick = lambda cond, yes, no: F.when(cond, F.col(yes)).otherwise(F.col(no))
    return grouped.select(
        "capture_file", "capture_packet_index", "flow_id", "packet_index", "ts_us",
        F.col("forward").cast("int").cast("byte").alias("direction"),
        pick(from_b, "ip_b", "ip_a").alias("src_ip"),
        pick(from_b, "ip_a", "ip_b").alias("dst_ip"),
        pick(from_b, "port_b", "port_a").alias("src_port"),
        pick(from_b, "port_a", "port_b").alias("dst_port"),
        "protocol", "tcp_flags", *extra,
        flow_src_ip.alias("flow_src_ip"),
        pick(a_is_src, "ip_b", "ip_a").alias("flow_dst_ip"),
        pick(start_b, "port_b", "port_a").alias("flow_src_port"),
        pick(a_is_src, "port_b", "port_a").alias("flow_dst_port"),
        "flow_start_us", "flow_total_packets", "iat_us", "side_iat_us", "active_us",
        "closed_active_us",
    )


def drop_cross_capture_duplicates(grouped: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Keep a flow between two captured hosts only in the capture of the lower one.

    ``hosts`` come from :func:`capture_hosts`, by default of ``grouped`` itself. The
    decision needs only the flow's two addresses, which every packet carries: no
    shuffle of packets.
    """
    return _mark_duplicates(grouped, hosts).where("not duplicate").drop("duplicate")


def cross_capture_drops(grouped: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Dropped flows and packets per capture (captures without drops included)."""
    return (
        _mark_duplicates(grouped, hosts)
        .groupBy("capture_file")
        .agg(
            F.count_if(F.col("duplicate") & (F.col("packet_index") == 0)).alias("dropped_flow_rows"),
            F.count_if("duplicate").alias("dropped_packet_rows"),
        )
    )


def capture_hosts(packets: DataFrame) -> DataFrame:
    """(capture_file, host, host_number) of the captures whose name holds an address."""
    named = packets.select("capture_file").distinct()
    hosts = named.withColumn("host", capture_host("capture_file")).dropna()
    return hosts.withColumn("host_number", ipv4_number("host"))


def _mark_duplicates(grouped: DataFrame, hosts: DataFrame | None) -> DataFrame:
    found = capture_hosts(grouped) if hosts is None else hosts
    # One row per capture file. As a local table it is evaluated once for the three
    # joins and its size is known, so the planner broadcasts it only when it is small.
    captures = grouped.sparkSession.createDataFrame(found.collect(), found.schema)
    own = captures.select("capture_file", F.col("host_number").alias("_own"))
    known = captures.select("host", "host_number").distinct()
    side = lambda name: known.select(F.col("host").alias(f"flow_{name}_ip"), F.col("host_number").alias(f"_{name}"))
    # A NULL number is an address without a capture: such a flow has one copy only.
    duplicate = (F.col("flow_src_ip") != F.col("flow_dst_ip")) & (F.least("_src", "_dst") != F.col("_own"))
    both = F.col("_src").isNotNull() & F.col("_dst").isNotNull() & F.col("_own").isNotNull()
    return (
        grouped.join(own, "capture_file", "left")
        .join(side("src"), "flow_src_ip", "left")
        .join(side("dst"), "flow_dst_ip", "left")
        .select(*grouped.columns, (both & duplicate).alias("duplicate"))
    )


def first_packets(grouped: DataFrame) -> DataFrame:
    """One row per flow: its first packet."""
    return grouped.where("packet_index = 0")


def dense_flow_numbers(flows: DataFrame) -> DataFrame:
    """Consecutive flow numbers over all captures, in (capture, flow) order.

    A running offset per capture plus a rank within it; the offsets come from
    pre-aggregated counts, the ranks from hash-spread buckets.
    """
    from pyspark.sql import Window

    from packetloom.operators.ordered import ranked_within

    sizes = flows.groupBy("capture_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("capture_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "capture_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    bucket = F.expr("flow_id div 65536")
    ranked = ranked_within(flows, ["capture_file"], bucket, [F.col("flow_id")], "_rank")
    return (
        ranked.join(offsets, "capture_file")
        .withColumn("flow_number", F.col("_offset") + F.col("_rank") - 1)
        .drop("_offset", "_rank")
    )


def grouping_summary(grouped: DataFrame) -> DataFrame:
    """Packet rows and flows per capture."""
    return grouped.groupBy("capture_file").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.col("packet_index") == 0).alias("flows")
    )
