"""Building blocks of the DuckDB texts: flows by plain recursion, features by windows.

Written from the definitions, not from the Spark plans: grouping walks packet by
packet, features use per-flow windows. Positions are counted with a frame and not
with ``row_number() - 1``: DuckDB 2.0 turns a filter on that difference into a wrong
top-n (positions start at 1).
"""

from __future__ import annotations

from packetloom.catalog.views import duck_ctes


def grouping(source: str = "packets") -> list[str]:
    """CTEs up to ``flow_packets``: packets with flow, position and direction."""
    return [
        f"""keyed as (select *, case when swapped then dst_ip else src_ip end as ip_a,
 case when swapped then src_ip else dst_ip end as ip_b, case when swapped then dst_port else src_port end as port_a,
 case when swapped then src_port else dst_port end as port_b
 from (select *, (src_ip > dst_ip or (src_ip = dst_ip and src_port > dst_port)) as swapped from {source}) z)""",
        """ordered as materialized (select *, row_number() over w as rn,
 first_value(src_ip) over w as init_ip, first_value(src_port) over w as init_port,
 dense_rank() over (order by capture_file, ip_a, ip_b, port_a, port_b, protocol) as k
 from keyed window w as (partition by capture_file, ip_a, ip_b, port_a, port_b, protocol order by ts_us, capture_packet_index))""",
        """marked as materialized (select k, rn, ts_us, capture_packet_index, (protocol = 6 and (tcp_flags & 4) <> 0) as rst,
 (protocol = 6 and (tcp_flags & 4) = 0 and (tcp_flags & 1) <> 0 and src_ip = init_ip and src_port = init_port) as ff,
 (protocol = 6 and (tcp_flags & 4) = 0 and (tcp_flags & 1) <> 0 and not (src_ip = init_ip and src_port = init_port)) as bf
 from ordered)""",
        """fold(k, rn, start_us, flow_id, ff, bf, ended) as (
 select k, rn, ts_us, capture_packet_index, ff, bf, rst or (ff and bf) from marked where rn = 1
 union all
 select k, rn, start_us, flow_id, ff, bf, rst or (ff and bf) from (
  select m.k, m.rn, case when fresh then m.ts_us else f.start_us end as start_us,
   case when fresh then m.capture_packet_index else f.flow_id end as flow_id, m.rst,
   m.ff or (f.ff and not fresh) as ff, m.bf or (f.bf and not fresh) as bf
  from (select fold.*, 1 as one from fold) f join marked m on m.k = f.k and m.rn = f.rn + 1,
   lateral (select (f.ended or m.ts_us - f.start_us > 120000000) as fresh) l) n)""",
        """flow_packets as materialized (select o.*, f.flow_id, f.start_us as flow_start_us,
 count(*) over (partition by o.capture_file, f.flow_id, o.k order by o.rn rows between unbounded preceding and 1 preceding) as packet_index,
 count(*) over (partition by o.capture_file, f.flow_id, o.k) as flow_total_packets,
 case when o.src_ip = o.init_ip and o.src_port = o.init_port then 1 else 0 end as direction,
 o.init_ip as flow_src_ip, o.init_port as flow_src_port,
 case when o.ip_a = o.init_ip then o.ip_b else o.ip_a end as flow_dst_ip,
 case when o.ip_a = o.init_ip then o.port_b else o.port_a end as flow_dst_port
 from ordered o join fold f on o.k = f.k and o.rn = f.rn)""",
    ]


def _dev(cond: str, value: str) -> str:
    """Population deviation from exact moments."""
    v = f"cast(case when {cond} then {value} end as hugeint)"
    return (f"case when count({v}) > 1 then sqrt(cast(count({v}) * sum({v} * {v}) - sum({v}) * sum({v}) as double))"
            f" / count({v}) else 0.0 end")


def _mean(cond: str, value: str) -> str:
    v = f"case when {cond} then {value} end"
    return f"case when count({v}) > 0 then cast(sum({v}) as double) / count({v}) else 0.0 end"


def _agg(fn: str, cond: str, value: str) -> str:
    return f"cast(coalesce({fn}(case when {cond} then {value} end), 0) as double)"


def _four(out: str, cond: str, value: str) -> str:
    return (f"{_mean(cond, value)} as {out}_mean, {_dev(cond, value)} as {out}_std, "
            f"{_agg('max', cond, value)} as {out}_max, {_agg('min', cond, value)} as {out}_min")


def _flag(bit: int, name: str) -> str:
    return f"cast(count(*) filter (where (tcp_flags & {bit}) <> 0) as int) as {name}_flag_cnt"


def _rate(amount: str) -> str:
    return (f"case when dur > 0 then cast({amount} as double) * 1e6 / dur "
            f"when {amount} > 0 then cast('Infinity' as double) else 0.0 end")


def features(source: str = "flow_packets", extra: str = "", target: str = "flow_features") -> list[str]:
    """CTEs up to ``target``: one row per flow (and per ``extra`` columns)."""
    x = f"{extra}, " if extra else ""
    ident = "capture_file, flow_id, k"
    return [
        f"""{target}_gaps as (select *, ts_us - lag(ts_us) over (partition by {x}{ident} order by packet_index) as iat,
 ts_us - lag(ts_us) over (partition by {x}{ident}, direction order by packet_index) as side_iat from {source})""",
        f"""{target}_segs as (select *, sum(case when iat > 5000000 then 1 else 0 end)
 over (partition by {x}{ident} order by packet_index) as seg from {target}_gaps)""",
        f"""{target}_active as (select {x}{ident}, {_four('active', 'true', 'span')} from (
 select {x}{ident}, seg, max(ts_us) - min(ts_us) as span from {target}_segs group by {x}{ident}, seg) s group by {x}{ident})""",
        f"""{target}_base as (select {x}{ident}, min(flow_src_ip) as flow_src_ip, min(flow_dst_ip) as flow_dst_ip,
 min(flow_src_port) as flow_src_port, min(flow_dst_port) as flow_dst_port, min(protocol) as protocol,
 min(flow_start_us) as flow_start_us, max(ts_us) as flow_end_us, min(flow_dst_port) as dst_port,
 cast(greatest(max(ts_us) - min(flow_start_us), 0) as double) as dur,
 cast(count(*) filter (where direction = 1) as int) as tot_fwd_pkts, cast(count(*) filter (where direction = 0) as int) as tot_bwd_pkts,
 {_agg('sum', 'direction = 1', 'payload_len')} as totlen_fwd_pkts, {_agg('sum', 'direction = 0', 'payload_len')} as totlen_bwd_pkts,
 {_four('fwd_pkt_len', 'direction = 1', 'payload_len')}, {_four('bwd_pkt_len', 'direction = 0', 'payload_len')},
 {_four('flow_iat', 'true', 'iat')},
 {_agg('sum', 'direction = 1', 'side_iat')} as fwd_iat_tot, {_four('fwd_iat', 'direction = 1', 'side_iat')},
 {_agg('sum', 'direction = 0', 'side_iat')} as bwd_iat_tot, {_four('bwd_iat', 'direction = 0', 'side_iat')},
 cast(max(case when direction = 1 and (tcp_flags & 8) <> 0 then 1 else 0 end) as int) as fwd_psh_flags,
 cast(max(case when direction = 1 and (tcp_flags & 32) <> 0 then 1 else 0 end) as int) as fwd_urg_flags,
 {_agg('max', 'true', 'payload_len')} as pkt_len_max, {_dev('true', 'payload_len')} as pkt_len_std,
 cast(cast(count(*) as hugeint) * sum(cast(payload_len as hugeint) * payload_len) - cast(sum(payload_len) as hugeint) * sum(payload_len) as double)
  / (cast(count(*) as double) * count(*)) as pkt_len_var, {_mean('true', 'payload_len')} as pkt_size_avg,
 {_flag(1, 'fin')}, {_flag(2, 'syn')}, {_flag(4, 'rst')}, {_flag(8, 'psh')}, {_flag(16, 'ack')}, {_flag(32, 'urg')},
 cast(case when min(protocol) = 6 then coalesce(arg_min(tcp_win, packet_index) filter (where direction = 1), 0) else -1 end as int) as init_fwd_win_byts,
 cast(case when min(protocol) = 6 then coalesce(arg_min(tcp_win, packet_index) filter (where direction = 0), 0) else -1 end as int) as init_bwd_win_byts,
 cast(count(*) filter (where direction = 1 and payload_len > 0) as int) as fwd_act_data_pkts,
 {_agg('min', 'direction = 1', 'ip_hdr_len')} as fwd_seg_size_min,
 {_four('idle', 'iat > 5000000', 'iat')} from {target}_segs group by {x}{ident})""",
        f"""{target} as (select {', '.join('b.' + c.strip() for c in extra.split(',')) + ', ' if extra else ''}
 b.* exclude ({x}k, dur), b.dur as flow_duration,
 {_rate('(totlen_fwd_pkts + totlen_bwd_pkts)')} as flow_byts_s, {_rate('(tot_fwd_pkts + tot_bwd_pkts)')} as flow_pkts_s,
 {_rate('tot_fwd_pkts')} as fwd_pkts_s, {_rate('tot_bwd_pkts')} as bwd_pkts_s,
 case when tot_fwd_pkts > 0 then cast(tot_bwd_pkts as double) / tot_fwd_pkts else 0.0 end as down_up_ratio,
 a.active_mean, a.active_std, a.active_max, a.active_min
 from {target}_base b join {target}_active a using ({x}{ident}))""",
    ]


def with_(*parts: str | list[str], select: str) -> str:
    """Assemble ``WITH RECURSIVE … select``; lists and single texts, in order."""
    flat: list[str] = []
    for part in parts:
        for text in [part] if isinstance(part, str) else part:
            if text not in flat:
                flat.append(text)
    return "with recursive\n" + ",\n".join(flat) + "\n" + select


def flows_from(view: str = "packets") -> list[str]:
    return duck_ctes(view) + grouping(view)


def flow_table(view: str = "packets") -> list[str]:
    return flows_from(view) + features()
