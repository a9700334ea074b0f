"""DuckDB texts for the registered queries, over the same given tables."""

from __future__ import annotations

from packetloom.catalog.oracle_parts import features, flow_table, flows_from, grouping, with_
from packetloom.catalog.views import ABSENT, duck_ctes
from packetloom.functions.classes import CLASS_GROUPS, GROUND_TRUTH_CLASSES, GROUP_OF

ORACLES: dict[str, str] = {}
SEED = 42


def view(*names):
    return duck_ctes(*names)


HEADS = "heads as (select capture_file, flow_id, flow_src_ip, flow_dst_ip, flow_src_port, flow_dst_port, protocol, flow_start_us from flow_packets where packet_index = 0)"
FLOWS = flows_from()
TABLE = flow_table()
HEAD = [*FLOWS, HEADS]

# --- scalar functions ------------------------------------------------------------------------

UNIFIED = """unified as (select capture_file, capture_packet_index, ts_us, src_ip, dst_ip,
 coalesce(tcp_srcport, udp_srcport, 0) as src_port, coalesce(tcp_dstport, udp_dstport, 0) as dst_port,
 protocol, ip_len, ip_hdr_len, coalesce(ttl, 0) as ttl,
 case when tcp_flags_hex like '0x%' then cast(tcp_flags_hex as int) else 0 end as tcp_flags,
 coalesce(tcp_window, 0) as tcp_win,
 case when protocol = 6 then coalesce(tcp_len, 0) when protocol = 17 then greatest(coalesce(udp_length, 0) - 8, 0)
      else greatest(ip_len - ip_hdr_len, 0) end as payload_len from packet_fields)"""
ORACLES["packet_fields_unified"] = with_(view("packet_fields"), UNIFIED, select="select * from unified")
ORACLES["payload_length"] = with_(view("packet_fields"), UNIFIED, select="""
select protocol, count(*) as packets, sum(payload_len) as payload_bytes, max(payload_len) as largest from unified group by protocol""")
ORACLES["packet_ordinals"] = with_(view("packets"), select="""
select event_id, capture_file, row_number() over (partition by capture_file order by ts_us, event_id) - 1 as capture_packet_index from packets""")
ORACLES["canonical_key"] = with_(view("packets"), grouping()[0], select="""
select capture_file, ip_a, ip_b, port_a, port_b, protocol, count(*) as packets, count(*) filter (where swapped) as from_b
from keyed group by all""")
EP = "case when {0} <= {1} then concat(protocol, '|', {0}, '|', {1}) else concat(protocol, '|', {1}, '|', {0}) end"
ORACLES["endpoint_keys"] = with_(view("packets"), select=f"""
select {EP.format("concat(src_ip, ':', src_port)", "concat(dst_ip, ':', dst_port)")} as key, count(*) as packets from packets group by 1""")
ORACLES["micros_half_even"] = """
select event_id, cast(round_even(cast(event_id as double) / cast(8000000 as double) * cast(1000000 as double), 0) as bigint) as us from events"""
ORACLES["clock_windows"] = """
select o_orderkey, epoch_us(cast(o_orderdate as date) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_hours(5)) as est_us,
 epoch_us(cast(o_orderdate as date) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_seconds(7)) as utc_us,
 strftime(o_orderdate, '%Y-%m-%d') as day_date from orders"""
ORACLES["day_names"] = """
select raw, case when raw like 'Thu%' then 'Tuesday-20-02-2018' else raw end as canonical,
 case when raw like 'Tue%' then 'Thuesday-20-02-2018' else raw end as rules,
 case when raw like 'Fri%' then '2017-07-07' end as date, count(*) as rows
from (select case event_id % 3 when 0 then 'Thuesday-20-02-2018' when 1 then 'Tuesday-20-02-2018' else 'Friday-WorkingHours' end as raw from events) e
group by raw"""
ORACLES["capture_host_names"] = """
select capture_file, case when a <= 255 and d <= 255 then concat(a, '.31.0.', d) end as host,
 case when a <= 255 and d <= 255 then cast(a as bigint) * 16777216 + 31 * 65536 + d end as host_number, rows
from (select concat('UCAP', a, '.31.0.', d) as capture_file, a, d, count(*) as rows
 from (select (user_id * 7) % 400 as a, user_id % 300 as d from events) e group by a, d) x"""
ORACLES["attempts_collapsed"] = with_(view("registry"), select="""
select label, regexp_replace(label, ' - Attempted$', '') as at_end, replace(label, ' - Attempted', '') as anywhere,
 label like '% - Attempted' as attempt, count(*) as rows from registry group by label""")
_NAMES = sorted(GROUP_OF)
_GROUP_CASES = " ".join(
    f"when class in ({', '.join(repr(n) for n in names)}) then '{group}'" for group, names in CLASS_GROUPS.items())
ORACLES["class_groups"] = f"""
select class, case {_GROUP_CASES} end as "group", class = 'Benign_Final' as benign, count(*) as rows
from (select ({_NAMES!r})[cast(event_id % {len(_NAMES)} as int) + 1] as class from events) e group by class"""
ORACLES["label_codes"] = """
select event_type, rows, coalesce(code, -1) as code, coalesce(code, 0) as code_or_normal,
 row_number() over (order by event_type <> 'view', event_type) - 1 as sorted_id, row_number() over (order by seen) - 1 as seen_id
from (select event_type, count(*) as rows, min(event_id) as seen,
 case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 end as code from events group by event_type) e"""
ORACLES["flag_tests"] = with_(view("packets"), select="select tcp_flags, " + ", ".join(
    f"count(*) filter (where (tcp_flags & {bit}) <> 0) as {name}"
    for name, bit in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))) + " from packets group by tcp_flags")
_RATE = "case when dur > 0 then cast({0} as double) * 1e6 / dur when {0} > 0 then cast('Infinity' as double) else 0.0 end"
ORACLES["rates_and_ratios"] = f"""
select l_orderkey, {_RATE.format('n')} as rate, {_RATE.format('fwd')} as fwd_rate,
 case when fwd > 0 then cast(n - fwd as double) / fwd else 0.0 end as ratio
from (select l_orderkey, count(*) as n, cast(sum(l_linenumber) - count(*) as double) as dur,
 count(*) filter (where l_returnflag = 'A') as fwd from lineitem group by l_orderkey) x"""
_FIN = "abs({0}) < cast('Infinity' as double)"
ORACLES["finite_policies"] = with_(TABLE, select=f"""
select capture_file, flow_id, flow_byts_s, flow_pkts_s, 'drop' as policy from flow_features
 where {_FIN.format('flow_byts_s')} and {_FIN.format('flow_pkts_s')}
union all select capture_file, flow_id, case when {_FIN.format('flow_byts_s')} then flow_byts_s else 0.0 end,
 case when {_FIN.format('flow_pkts_s')} then flow_pkts_s else 0.0 end, 'zero' from flow_features""")
ORACLES["flow_keys_and_offsets"] = """
select event_type, concat(event_type, '_', min(event_id)) as flow_key,
 cast(concat('0x', substr(sha1(event_type), 1, 8)) as bigint) % 9000 * 1000000000000 + 1000000000000 as "offset", count(*) as rows
from events group by event_type"""
ORACLES["endpoint_predicates"] = with_(view("packets"), select="""
select capture_file, count(*) filter (where src_ip = '172.31.0.1' or dst_ip = '172.31.0.1') as with_host,
 count(*) filter (where (src_ip = '172.31.0.1' or dst_ip = '172.31.0.1') and ts_us between 1704500000000 and 1705000000000) as in_window,
 count(*) filter (where src_port = 443) as src_443, count(*) filter (where dst_port = 443) as dst_443,
 count(*) filter (where src_port = 443 or dst_port = 443) as any_443, count(*) filter (where src_ip like '172.31.%') as internal_src
from packets group by capture_file""")
ORACLES["protocol_numbers"] = with_(view("gt"), select="""
select proto, case lower(trim(proto)) when 'tcp' then 6 when 'udp' then 17 when 'icmp' then 1 else -1 end as number, count(*) as rows
from gt group by proto""")

# --- flows and cuts ------------------------------------------------------------------------------

_FLOW_COLUMNS = ("capture_file, capture_packet_index, flow_id, packet_index, direction, src_ip, dst_ip, src_port, dst_port, "
                 "flow_src_ip, flow_dst_ip, flow_src_port, flow_dst_port, flow_start_us")
ORACLES["flow_grouping"] = with_(FLOWS, select=f"select {_FLOW_COLUMNS} from flow_packets")
ORACLES["flow_direction"] = with_(FLOWS, select="""
select capture_file, flow_src_ip, flow_dst_ip, sum(direction) as forward, sum(1 - direction) as backward from flow_packets group by all""")
ORACLES["flow_total_packets"] = with_(FLOWS, select="""
select capture_file, flow_id, count(*) as flow_total_packets from flow_packets group by all""")
ORACLES["flow_numbers"] = with_(FLOWS, select="""
select capture_file, flow_id, row_number() over (order by capture_file, flow_id) - 1 as flow_number from flow_packets where packet_index = 0""")
ORACLES["grouping_summary"] = with_(FLOWS, select="""
select capture_file, count(*) as packets, count(*) filter (where packet_index = 0) as flows from flow_packets group by 1""")
DUP = [*view("packets_dup"), *grouping("packets_dup"), """judged as (select *,
 coalesce(sh and dh and flow_src_ip <> flow_dst_ip and own is not null
  and own <> case when sn <= dn then flow_src_ip else flow_dst_ip end, false) as duplicate
 from (select f.*, replace(capture_file, 'UCAP', '') as own, flow_src_ip in (select replace(capture_file, 'UCAP', '') from packets_dup) as sh,
  flow_dst_ip in (select replace(capture_file, 'UCAP', '') from packets_dup) as dh,
  cast(split_part(flow_src_ip, '.', 4) as int) as sn, cast(split_part(flow_dst_ip, '.', 4) as int) as dn from flow_packets f) z)"""]
ORACLES["cross_capture_dedup"] = with_(DUP, select="""
select capture_file, capture_packet_index, flow_id, packet_index from judged where not duplicate""")
ORACLES["cross_capture_drops"] = with_(DUP, select="""
select capture_file, count(*) filter (where duplicate and packet_index = 0) as dropped_flow_rows,
 count(*) filter (where duplicate) as dropped_packet_rows from judged group by 1""")

KEEP = {
    "pct_010": "packet_index < greatest(ceil(flow_total_packets * cast(0.1 as double)), 1)",
    "pct_025": "packet_index < greatest(ceil(flow_total_packets * 0.25), 1)",
    "pct_050": "packet_index < greatest(ceil(flow_total_packets * 0.5), 1)",
    "pct_075": "packet_index < greatest(ceil(flow_total_packets * 0.75), 1)",
    "pct_100": "true",
    "time_abs_1s": "(ts_us - flow_start_us <= 1000000 or packet_index = 0)",
    "time_abs_3s": "(ts_us - flow_start_us <= 3000000 or packet_index = 0)",
    "packet_abs_5": "packet_index < 5", "packet_abs_4": "packet_index < 4", "packet_abs_3": "packet_index < 3",
}


def cut_rows(*tags):
    """``cut_packets``: packets of the named cuts under column ``cut``."""
    return "cut_packets as (" + " union all ".join(f"select '{t}' as cut, * from flow_packets where {KEEP[t]}" for t in tags) + ")"


for _query, _tag in (("cut_packet_pct", "pct_025"), ("cut_time_abs", "time_abs_3s"), ("cut_packet_abs", "packet_abs_3")):
    ORACLES[_query] = with_(FLOWS, select=f"select capture_file, flow_id, capture_packet_index, packet_index from flow_packets where {KEEP[_tag]}")
ORACLES["cut_grid"] = with_(FLOWS, cut_rows(*KEEP), select="""
select cut, count(*) as packets, count(*) filter (where packet_index = 0) as flows, sum(packet_index) as positions from cut_packets group by cut""")
ORACLES["first_packets_for_bytes"] = with_(FLOWS, select="""
select capture_file, flow_id, capture_packet_index, packet_index as pkt_order,
 cast(cast(ts_us - flow_start_us as double) / 1e6 as float) as timestamp_rel from flow_packets where packet_index < 5""")

# --- features -----------------------------------------------------------------------------------


def feature_part(columns):
    return with_(TABLE, select=f"select capture_file, flow_id, {', '.join(columns)} from flow_features")


def _feature_oracles():
    from packetloom.catalog.queries import FEATURE_PARTS
    from packetloom.operators.features import RAW_FLOW_COLUMNS

    for name, columns in FEATURE_PARTS.items():
        ORACLES[name] = feature_part(columns)
    made = {
        "day": "'Tuesday-20-02-2018'", "flow_start_ts": "cast(flow_start_us as double) / 1e6",
        "flow_end_ts": "cast(flow_end_us as double) / 1e6", "label": "cast(null as varchar)", "label_encoded": "-1",
    }
    ORACLES["raw_flow_table"] = with_(TABLE, select="select " + ", ".join(
        f'{made.get(own, own)} as "{shown}"' for own, shown in RAW_FLOW_COLUMNS) + " from flow_features")


_feature_oracles()
ORACLES["flow_features_full"] = with_(TABLE, select="select * from flow_features")
_EARLY = "early as (select * from flow_packets where packet_index < 3)"
ORACLES["early_flow_features"] = with_(FLOWS, _EARLY, features("early"), select="select * from flow_features")
ORACLES["feature_cut_grid"] = with_(
    FLOWS, cut_rows("packet_abs_3", "time_abs_1s", "pct_050", "pct_100"), features("cut_packets", "cut"),
    select="""select cut, capture_file, flow_id, tot_fwd_pkts, tot_bwd_pkts, flow_duration, flow_iat_mean, pkt_len_std, active_max from flow_features""")

# --- labels ---------------------------------------------------------------------------------------


def rule_labels(order="rule_pos", source="heads"):
    """``ruled``: every flow with its rule label."""
    return [
        f"""hits as (select f.capture_file, f.flow_id, r.label, row_number() over (partition by f.capture_file, f.flow_id order by {order}) as place
 from {source} f join rule_ips r on ((f.flow_src_ip = r.attacker_ip and f.flow_dst_ip = r.victim_ip and (r.victim_port = -1 or f.flow_dst_port = r.victim_port))
  or (f.flow_dst_ip = r.attacker_ip and f.flow_src_ip = r.victim_ip and (r.victim_port = -1 or f.flow_src_port = r.victim_port)))
 and f.flow_start_us between cast(r.start_s - 300 as bigint) * 1000000 and cast(r.end_s + 300 as bigint) * 1000000)""",
        f"""ruled as (select f.*, coalesce(h.label, 'Benign') as label,
 case coalesce(h.label, 'Benign') when 'Benign' then 0 when 'DoS Hulk' then 1 when 'DoS Slow' then 2 when 'Portscan' then 4 else -1 end as label_encoded
 from {source} f left join hits h on h.place = 1 and h.capture_file = f.capture_file and h.flow_id = f.flow_id)""",
    ]


RULES = view("rule_ips")
RULED = [*RULES, *HEAD[len(view("packets")):], *rule_labels()]
for _query, _order in (("label_rules_first", "rule_pos"), ("label_rules_narrowest", "end_s - start_s, rule_pos")):
    ORACLES[_query] = with_(RULES, HEAD, rule_labels(_order), select="select capture_file, flow_id, label, label_encoded from ruled")
ORACLES["label_attach_default"] = with_(RULES, HEAD, rule_labels(), select="""
select capture_file, flow_id, case when protocol = 1 then 'Benign' when label <> 'Benign' then label end as label,
 case when protocol = 1 then 0 when label <> 'Benign' then label_encoded else -1 end as label_encoded from ruled""")

KEY6 = "flow_src_ip, flow_src_port, flow_dst_ip, flow_dst_port, protocol, flow_start_us"


def registered(source="heads", keep="asc", registry="registry"):
    """``labelled``: flows of ``source`` with registry label, category, matched."""
    return [
        f"single as (select * from (select *, row_number() over (partition by {KEY6} order by row_ord {keep}) as place from {registry}) z where place = 1)",
        f"""labelled as (select f.*, s.label, coalesce(s.attempted_category, -1) as attempted_category, s.label is not null as matched
 from {source} f left join (select {KEY6}, label, attempted_category from single) s using ({KEY6}))""",
    ]


REG = [*view("registry"), *HEAD, *registered()]
ORACLES["label_registry_exact"] = with_(REG, select="""
select capture_file, flow_id, flow_start_us, label, attempted_category, matched from labelled""")
for _keep, _way in (("first", "asc"), ("last", "desc")):
    ORACLES[f"registry_dedup_{_keep}"] = with_(view("registry_repeated"), registered(registry="registry_repeated", keep=_way)[0], select="""
select flow_src_ip, flow_start_us, row_ord, label, attempted_category from single""")
ORACLES["registry_on_cut"] = with_(REG, _EARLY, select="""
select e.capture_file, e.flow_id, cast(count(*) filter (where direction = 1) as int) as tot_fwd_pkts, min(l.label) as label,
 min(l.attempted_category) as attempted_category, bool_and(l.matched) as matched
from early e join labelled l on e.capture_file = l.capture_file and e.flow_id = l.flow_id group by 1, 2""")

TRUTH = ["""truth as (select gt_ord, """ + EP.format("concat(src_ip, ':', src_port)", "concat(dst_ip, ':', dst_port)").replace(
    "protocol", "case lower(trim(proto)) when 'tcp' then 6 when 'udp' then 17 when 'icmp' then 1 else -1 end")
    + " as key, cast(ts as bigint) * 1000000 as gt_us, type from gt)",
    "truth_index as (select *, count(*) over (partition by key) > 1 as key_dup from truth)"]
ORACLES["ground_truth_index"] = with_(view("gt"), TRUTH, select="select * from truth_index")
_CODES = " ".join(f"when '{n}' then {c}" for c, n in enumerate(GROUND_TRUTH_CLASSES))
NEAREST = [*TRUTH, "flow_keys as (select *, " + EP.format("concat(flow_src_ip, ':', flow_src_port)", "concat(flow_dst_ip, ':', flow_dst_port)") + " as key from heads)",
           """near as (select f.capture_file, f.flow_id, t.type, row_number() over (partition by f.capture_file, f.flow_id order by abs(gt_us - flow_start_us), gt_ord) as place
 from flow_keys f join truth_index t on f.key = t.key where not key_dup or abs(gt_us - flow_start_us) <= 5000000)""",
           f"""nearest as (select h.capture_file, h.flow_id, coalesce(n.type, 'normal') as label,
 case coalesce(n.type, 'normal') {_CODES} else 0 end as label_encoded, coalesce(n.type, 'normal') <> 'normal' as matched,
 case when n.type is null then 0 else 1 end as match_level
 from heads h left join near n on n.place = 1 and n.capture_file = h.capture_file and n.flow_id = h.flow_id)"""]
ORACLES["label_nearest"] = with_(view("gt"), HEAD, NEAREST, select="select * from nearest")

# One-to-one matching by recursion over the merged sequence of each 5-tuple: the queue
# is described by its side and by how many of its entries were consumed so far.
K5 = "flow_src_ip, flow_src_port, flow_dst_ip, flow_dst_port, protocol"
FUZZY = [
    f"missing as (select * from single s where not exists (select 1 from heads h where {' and '.join(f's.{c.strip()} = h.{c.strip()}' for c in KEY6.split(','))}))",
    f"loose as (select l.* from labelled l where not matched and exists (select 1 from missing m where {' and '.join(f'l.{c.strip()} = m.{c.strip()}' for c in K5.split(','))}))",
    f"""sides as materialized (select *, row_number() over (partition by k, kind order by at_us, ord, capture_file, flow_id) as pos from (
 select dense_rank() over (order by {K5}) as k, * from (
 select {K5}, flow_start_us as at_us, 0 as kind, row_ord as ord, row_ord, cast(null as varchar) as capture_file, cast(null as bigint) as flow_id from missing
 union all select {K5}, flow_start_us, 1, 0, null, capture_file, flow_id from loose) u) v)""",
    """walk(k, i, j, hit) as (
 select distinct k, cast(1 as bigint), cast(1 as bigint), false from sides
 union all
 select k, i + case when d <= 1000000 and d >= -1000000 or d > 1000000 then 1 else 0 end,
  j + case when d <= 1000000 then 1 else 0 end, false
 from (select w.k, w.i, w.j, b.at_us - a.at_us as d from walk w join sides a on a.k = w.k and a.kind = 0 and a.pos = w.i
  join sides b on b.k = w.k and b.kind = 1 and b.pos = w.j) s)""",
    """pairs as materialized (select a.row_ord, b.capture_file, b.flow_id, b.at_us - a.at_us as delta_us
 from walk w join sides a on a.k = w.k and a.kind = 0 and a.pos = w.i join sides b on b.k = w.k and b.kind = 1 and b.pos = w.j
 where abs(b.at_us - a.at_us) <= 1000000)""",
]
ORACLES["fuzzy_one_to_one"] = with_(REG, FUZZY, select="select * from pairs")
ORACLES["fuzzy_apply"] = with_(REG, FUZZY, select="""
select l.capture_file, l.flow_id, coalesce(s.label, l.label) as label, coalesce(s.attempted_category, l.attempted_category) as attempted_category,
 l.matched or s.label is not null as matched
from labelled l left join pairs p on p.capture_file = l.capture_file and p.flow_id = l.flow_id left join single s on s.row_ord = p.row_ord""")
ORACLES["registry_uncovered"] = with_(REG, select=f"""
select row_ord, label, flow_start_us from registry r where not exists (select 1 from heads h
 where {' and '.join(f'r.{c.strip()} = h.{c.strip()}' for c in KEY6.split(','))})""")
ORACLES["delta_quantiles"] = with_(REG, FUZZY, select=" union all ".join(
    f"select cast({q} as double) as quantile, quantile_cont(abs(delta_us), {q}) / 1e6 as abs_delta_seconds from pairs"
    for q in (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)))
ORACLES["matches_by_label"] = with_(REG, FUZZY, select="""
select label, count(*) as fuzzy_matches from pairs join single using (row_ord) group by label""")
TREG = [*view("registry"), *TABLE, *registered("flow_features")]
ORACLES["aligned_fetch"] = with_(TREG, select="""
select capture_file, flow_id, tot_fwd_pkts, flow_duration from labelled where matched and label = 'Portscan'""")
ORACLES["anchor_selection"] = with_(REG, select="""
select count(*) as requested, count(*) filter (where matched) as kept, count(*) filter (where not matched) as lost from labelled where flow_id % 2 = 0""")
ORACLES["packets_labelled"] = with_(REG, select="""
select l.label, count(*) as packets from flow_packets p join labelled l on p.capture_file = l.capture_file and p.flow_id = l.flow_id
where l.matched group by 1""")
ORACLES["bytes_attached"] = with_(view("frames"), FLOWS, select=f"""
select p.capture_file, p.flow_id, p.packet_index as pkt_order, f.ip_hex is not null as found, length(f.ip_hex) // 2 as bytes
from flow_packets p left join (select * replace ({ABSENT} as capture_packet_index) from frames) f
 on p.capture_file = f.capture_file and p.capture_packet_index = f.capture_packet_index where p.packet_index < 3""")

# --- reports -----------------------------------------------------------------------------------------

_SHARE = "case when {1} > 0 then cast({0} as double) / {1} else 0.0 end"
ORACLES["coverage"] = with_(REG, select="""
select count(*) as n_total, count(*) filter (where matched) as n_matched, count(*) filter (where not matched) as n_unmatched,
 cast(count(*) filter (where matched) as double) / count(*) * 100 as pct_matched from labelled""")
ORACLES["label_counts"] = with_(REG, select="select coalesce(label, '<NA>') as label, count(*) as count from labelled group by 1")
ORACLES["label_summary"] = with_(RULES, HEAD, rule_labels(), select="""
select label, count, round_even(cast(count as double) / sum(count) over () * 100 * 100, 0) / 100 as pct
from (select label, count(*) as count from ruled group by label) c""")
DAYS = [*RULES, *TABLE, *rule_labels(source="flow_features"),
        "dayed as (select *, concat('day_', flow_start_us // 600000000) as day from ruled)"]
_INF = "(flow_byts_s = cast('Infinity' as double) or flow_pkts_s = cast('Infinity' as double))"
ORACLES["day_label_mix"] = with_(DAYS, select="""
select day, label, count, sum(count) over (partition by day) as day_total, cast(count as double) / sum(count) over (partition by day) as day_share
from (select day, label, count(*) as count from dayed group by 1, 2) c""")
ORACLES["day_summary"] = with_(DAYS, select="""
select day, count(*) as rows_total, count(*) filter (where label = 'Benign') as benign_rows, count(*) filter (where label <> 'Benign') as attack_rows,
 cast(count(*) filter (where label <> 'Benign') as double) / count(*) as attack_ratio, count(distinct label) as distinct_labels from dayed group by day""")
ORACLES["global_label_shares"] = with_(DAYS, select="""
select label, count, cast(count as double) / sum(count) over () as share from (select label, count(*) as count from dayed group by 1) c""")
ORACLES["unlabelled_rows"] = with_(DAYS, select="select count(*) filter (where label_encoded = -1) as label_encoded_neg1 from dayed")
_SCANNED = ["flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s", "pkt_len_var"]
ORACLES["feature_quality"] = with_(TABLE, select="select feature, null_rows, negative_rows, inf_rows, " + ", ".join(
    f"cast({k}_rows as double) / rows as {k}_share" for k in ("null", "negative", "inf")) + " from (" + " union all ".join(
    f"select '{c}' as feature, count(*) filter (where {c} is null) as null_rows, "
    + (f"count(*) filter (where {c} < 0)" if not c.endswith("_s") else "0") + " as negative_rows, "
    + (f"count(*) filter (where {c} = cast('Infinity' as double))" if c.endswith("_s") else "0") + " as inf_rows, count(*) as rows from flow_features"
    for c in _SCANNED) + ") q")
_COUNTERS = {
    "any_inf_rate_rows": _INF, "flow_bytes_per_s_inf_rows": "flow_byts_s = cast('Infinity' as double)",
    "flow_pkts_per_s_inf_rows": "flow_pkts_s = cast('Infinity' as double)", "rows_total": "true",
    "single_packet_rows": "tot_fwd_pkts + tot_bwd_pkts = 1", "zero_duration_rows": "flow_duration = 0",
    "zero_duration_single_packet_rows": "flow_duration = 0 and tot_fwd_pkts + tot_bwd_pkts = 1",
}
ORACLES["cleanup_counters"] = with_(TABLE, select=" union all ".join(
    f"select '{k}' as metric, count(*) filter (where {c}) as count, cast(count(*) filter (where {c}) as double) / count(*) as share from flow_features"
    for k, c in _COUNTERS.items()))
ORACLES["label_cleanup_impact"] = with_(DAYS, select=f"""
select label, total_rows, any_inf_rate_rows, total_rows - any_inf_rate_rows as remaining_rows_after_drop,
 cast(any_inf_rate_rows as double) / total_rows as any_inf_rate_share_within_label,
 cast(total_rows - any_inf_rate_rows as double) / greatest(sum(total_rows - any_inf_rate_rows) over (), 1) as remaining_share_after_drop
from (select label, count(*) as total_rows, count(*) filter (where {_INF}) as any_inf_rate_rows from dayed group by label) c""")
ORACLES["balance_before_after"] = with_(DAYS, select=f"""
select rows_total, benign_total, rows_total - benign_total as attack_total, cast(rows_total - benign_total as double) / rows_total as attack_ratio,
 rows_total - bi - ai as rows_after_drop, benign_total - bi as benign_after_drop, rows_total - benign_total - ai as attack_after_drop,
 {_SHARE.format('(rows_total - benign_total - ai)', '(rows_total - bi - ai)')} as attack_ratio_after_drop, bi as benign_any_inf, ai as attack_any_inf
from (select count(*) as rows_total, count(*) filter (where label = 'Benign') as benign_total,
 count(*) filter (where label = 'Benign' and {_INF}) as bi, count(*) filter (where label <> 'Benign' and {_INF}) as ai from dayed) c""")
ORACLES["day_share_pivot"] = with_(DAYS, select="select day, " + ", ".join(
    f"""cast(count(*) filter (where label = '{n}') as double) / count(*) as "{n}" """ for n in ("Benign", "Botnet", "DoS Hulk", "Portscan"))
    + " from dayed group by day")
_CLAIM = {
    0: ("port_exclusive", "172.31.0.1", "true", "src_port = 443 or dst_port = 443", "count >= 100 and secondary = count"),
    1: ("absent", "10.9.9.9", "true", None, "count = 0"), 2: ("absent", "172.31.0.2", "true", None, "count = 0"),
    3: ("absent_in_window", "172.31.0.3", "ts_us between 1 and 2", None, "count = 0"),
    4: ("bounded_in_window", "172.31.0.3", "ts_us between 1704500000000 and 1704600000000", None, "count <= 1000000"),
    5: ("external_zero", "172.31.0.4", "true",
        "(src_ip = '172.31.0.4' and dst_ip not like '172.31.%') or (dst_ip = '172.31.0.4' and src_ip not like '172.31.%')", "count >= 1 and secondary = 0"),
    6: ("port_exclusive", "10.0.4.4", "true", "src_port = 0 or dst_port = 0", "count >= 1 and secondary = count"),
}
_AUDIT = "audited as (" + " union all ".join(
    f"select {i} as claim_id, '{kind}' as kind, '{ip}' as ip, count, secondary, {verdict} as passed from (select count(*) filter (where {window}) as count, "
    + (f"count(*) filter (where {second})" if second else "cast(null as bigint)") + f" as secondary from packets where src_ip = '{ip}' or dst_ip = '{ip}') c{i}"
    for i, (kind, ip, window, second, verdict) in _CLAIM.items()) + ")"
ORACLES["claim_audit"] = with_(view("packets"), _AUDIT, select="select * from audited")
ORACLES["claim_verdict"] = with_(view("packets"), _AUDIT, select="""
select count(*) filter (where passed) as passed, count(*) as total, bool_and(passed) as all_passed from audited""")
_CLASS = "regexp_replace(label, ' - Attempted$', '')"
ORACLES["class_real_attempted"] = with_(REG, select=f"""
select {_CLASS} as class, count(*) as total, count(*) filter (where label not like '% - Attempted') as real,
 count(*) filter (where label like '% - Attempted') as attempted from labelled where matched group by 1""")
ORACLES["min_support"] = with_(REG, select=f"""
select label, count(*) as rows from labelled where matched and {_CLASS} in (select {_CLASS} from labelled where matched
 group by 1 having count(*) filter (where label not like '% - Attempted') >= 300) group by label""")
ORACLES["class_counts_by_day"] = with_(REG, select=f"""
select concat('day_', flow_start_us // 600000000) as day, {_CLASS} as class, count(*) as count from labelled where matched group by 1, 2""")
ORACLES["exclusion_by_length"] = with_(TREG, select="""
select packets_in_flow, reconstructed_flows, excluded_flows, cast(excluded_flows as double) / reconstructed_flows * 100 as excluded_pct,
 cast(excluded_flows as double) / sum(excluded_flows) over () * 100 as share_of_all_excluded_pct
from (select case when n <= 5 then cast(n as varchar) when n <= 10 then '6-10' else '>10' end as packets_in_flow, count(*) as reconstructed_flows,
 count(*) filter (where not matched) as excluded_flows from (select *, tot_fwd_pkts + tot_bwd_pkts as n from labelled) l group by 1) c""")
ORACLES["registry_coverage"] = with_(REG, select=f"""
select label as class, count(*) as registry_entries, count(hit) as matched_entries, cast(count(hit) as double) / count(*) * 100 as coverage_pct
from registry left join (select distinct {KEY6}, 1 as hit from heads) h using ({KEY6}) group by label""")
ORACLES["protocol_mix"] = with_(view("frames"), select="""
select count(*) filter (where substr(ip_hex, 19, 2) = '06') as tcp, count(*) filter (where substr(ip_hex, 19, 2) = '11') as udp,
 count(*) filter (where substr(ip_hex, 19, 2) not in ('06', '11')) as other from frames""")

# --- sampling -------------------------------------------------------------------------------------------

DOCS = """docs as (select d.doc_id, d.source as day, case when coalesce(l.quality, 0) = 1 then 'Benign' else d.lang end as label
 from documents d left join labels l on l.doc_id = d.doc_id)"""


def ranked(by="label", source="docs", key="doc_id", where="true"):
    order = f"md5(concat_ws('|', {key}, '{SEED}')), {key}"
    part = f"partition by {by}" if by else ""
    return f"ranked as (select *, row_number() over ({part} order by {order}) as place, count(*) over ({part}) as n from {source} where {where})"


ORACLES["class_cap"] = with_(DOCS, ranked(), select="""
select doc_id, label from ranked where case label when 'en' then place <= 100 when 'Benign' then place <= 50 else true end""")
ORACLES["day_class_cap"] = with_(DOCS, ranked("day, label", where="label <> 'de'"), select="""
select doc_id, day, label from ranked where place <= case label when 'Benign' then 7 else 20 end""")
ORACLES["assembled"] = with_(view("gt"), HEAD, NEAREST, ranked("label", "nearest", "capture_file, flow_id"), select="""
select capture_file, flow_id, label from ranked where case label when 'normal' then place <= 500 when 'ddos' then place <= 200 when 'scanning' then place <= 100 else true end""")
ORACLES["benign_undersample"] = with_(DAYS, ranked("label = 'Benign'", "dayed", "capture_file, flow_id"), select="""
select capture_file, flow_id, label from ranked where label <> 'Benign' or place <= 3 * (select count(*) from dayed where label <> 'Benign')""")
ORACLES["seeded_shuffle"] = with_(DOCS, select=f"select doc_id, md5(concat_ws('|', doc_id, '{SEED}')) as position from docs")
_HALF = "floor({} + 0.5)"
_TESTS = _HALF.format("n * 0.25")
ORACLES["stratified_split"] = with_(DOCS, ranked(), select=f"select doc_id, label, case when place <= {_TESTS} then 'test' else 'train' end as split from ranked")
ORACLES["split_ledger"] = with_(DOCS, ranked(), select=f"select doc_id, label as class, case when place <= {_TESTS} then 'test' else 'train' end as split from ranked")
ORACLES["three_way_split"] = with_(DOCS, ranked(), select=f"""
select doc_id, label, case when place <= {_TESTS} then 'test' when place <= {_TESTS} + {_HALF.format(f'(n - {_TESTS}) * cast(0.2 as double)')} then 'validation' else 'train' end as split from ranked""")
_HELD = _HALF.format("n * cast(0.3 as double)")
_SHARED = f"case when place <= {_HALF.format(f'{_HELD} * 0.5')} then 'test' when place <= {_HELD} then 'validation' else 'train' end"
ORACLES["within_day_split"] = with_(DOCS, ranked("day, label"), select=f"select doc_id, day, label, {_SHARED} as split from ranked")
ORACLES["task_split"] = with_(DOCS, ranked(where="label <> 'fr'"), select=f"select {_SHARED} as split, label, count(*) as count from ranked group by 1, 2")
ORACLES["stratified_sample"] = with_(DOCS, ranked(), select="""
select doc_id, label from ranked where place <= round_even(n * least(cast(300 as double) / (select count(*) from docs), 1.0), 0)""")
_WEIGHT = "cast(sum(count) over () as double) / (count(*) over () * count)"
ORACLES["class_weights"] = with_(DOCS, select=f"select label as class, count, {_WEIGHT} as weight from (select label, count(*) as count from docs group by 1) c")
ORACLES["sample_weights"] = with_(DOCS, select=f"select label, count as rows, {_WEIGHT} as weight from (select label, count(*) as count from docs group by 1) c")
ORACLES["flows_of_byte_table"] = with_(FLOWS, select="""
select capture_file, flow_id, capture_packet_index, packet_index as pkt_order from flow_packets where packet_index = 0""")

# --- bytes: the same rules on hex text --------------------------------------------------------------

STORED = "stored as (select event_id, capture_file, capture_packet_index, rpad(substr(masked, 1, 512), 512, '0') as h, proto, ihl from addressed)"


def zero(text, start, end):
    """Bytes [start, end) of hex ``text`` to zero; both may be expressions."""
    return (f"concat(substr({text}, 1, 2 * ({start})), repeat('0', greatest(least(2 * ({end}), length({text})) - 2 * ({start}), 0)), "
            f"substr({text}, 2 * greatest({end}, {start}) + 1))")


def hex_number(text, start, count=1):
    return f"cast(concat('0x', substr({text}, 2 * ({start}) + 1, {2 * count})) as int)"


# Every mask step is a CTE of its own, so each text is mentioned by name only.
HEADERS = f"""headers as (select event_id, capture_file, capture_packet_index, ip_hex as h, length(ip_hex) // 2 as size,
 {hex_number('ip_hex', 9)} as proto, ({hex_number('ip_hex', 0)} & 15) * 4 as ihl from frames)"""


def steps(source, target, text, *rules):
    """Chain of CTEs: each rule is (condition, start, end)."""
    out, name = [], source
    for i, (cond, start, end) in enumerate(rules):
        step = f"{target}_{i}"
        out.append(f"{step} as (select * exclude ({text}), case when {cond} then {zero(text, start, end)} else {text} end as {text} from {name})")
        name = step
    return out, name


SANE = "(size >= 20 and ihl between 20 and 60)"
_basic, _basic_name = steps("headers", "basic", "h", (SANE, 12, 20), (f"{SANE} and proto in (6, 17) and ihl + 4 <= size", "ihl", "ihl + 4"))
BASIC = [*view("frames"), HEADERS, *_basic, f"addressed as (select *, h as masked from {_basic_name})"]
ORACLES["mask_basic"] = with_(BASIC, select="select event_id, masked from addressed")
_TCP_OFFSET = "(case when length(h) >= 2 * (ihl + 13) then " + hex_number("h", "ihl + 12") + " >> 4 else 0 end) * 4"


def identity(source, target):
    return [f"{target}_v as (select * exclude (h), concat('0', substr(h, 2)) as h from {source})",
            *steps(f"{target}_v", target, "h", ("true", 1, 2), ("true", 4, 6), ("true", 9, 10), ("ihl > 20", 20, "ihl"))[0]], f"{target}_3"


_id, _id_name = identity("addressed", "strict")
_opt = (f"proto = 6 and {_TCP_OFFSET} > 20 and {_TCP_OFFSET} <= 60 and ihl + {_TCP_OFFSET} <= size", "ihl + 20", f"ihl + {_TCP_OFFSET}")
_strict, _strict_name = steps(_id_name, "strict_o", "h", _opt)
ORACLES["mask_strict"] = with_(BASIC, _id, _strict, select=f"select event_id, h as masked from {_strict_name}")
ORACLES["fixed_length"] = with_(view("frames"), select="""
select event_id, rpad(substr(ip_hex, 1, 512), 512, '0') as raw_bytes, length(ip_hex) // 2 as real_length from frames""")
KEPT = [*BASIC, STORED]
_stored_options = (f"proto = 6 and {_TCP_OFFSET} > 20 and {_TCP_OFFSET} <= 60", "ihl + 20", f"ihl + {_TCP_OFFSET}")
for _query, _first in (("strict", []), ("strict_csum", [("true", 10, 12)])):
    _pre, _pre_name = steps("stored", "pre", "h", *_first)
    _id, _id_name = identity(_pre_name, "derived")
    _end, _end_name = steps(_id_name, "derived_o", "h", _stored_options)
    ORACLES[f"derive_{_query}"] = with_(KEPT, _pre, _id, _end, select=f"select event_id, h as masked from {_end_name}")
_LADDER = [("true", 10, 12), _stored_options, ("true", 8, 9), ("true", 4, 6), ("proto = 6", "ihl + 14", "ihl + 16")]
for _k in range(1, 6):
    _some, _some_name = steps("stored", "ladder", "h", *_LADDER[:_k])
    ORACLES[f"derive_occ_top{_k}"] = with_(KEPT, _some, select=f"select event_id, h as masked from {_some_name}")


def checksum(text):
    total = " + ".join(hex_number(text, 2 * i, 2) for i in range(10) if i != 5)
    once = f"(({total}) % 65536 + ({total}) // 65536)"
    return f"65535 - ({once} % 65536 + {once} // 65536)"


ORACLES["ipv4_checksum"] = with_(view("frames"), select=f"select event_id, {checksum('ip_hex')} as checksum from frames")
ORACLES["derive_csum_fix"] = with_(KEPT, select=f"""
select event_id, concat(substr(h, 1, 20), lpad(hex({checksum('h')}), 4, '0'), substr(h, 25)) as masked from stored""")
_two, _two_name = steps("stored", "ladder", "h", *_LADDER[:2])
ORACLES["mask_statistics"] = with_(KEPT, _two, select=f"""
select count(*) as rows, count(*) as rows_sane, count(*) filter (where s.proto = 6) as tcp_rows,
 count(*) filter (where s.proto = 6 and substr(s.h, 65, 1) in ('6', '7', '8', '9', 'A', 'B', 'C', 'D', 'E', 'F')) as tcp_with_options,
 count(*) filter (where s.h <> t.h) as changed from stored s join {_two_name} t using (event_id)""")
ORACLES["link_stripped"] = with_(view("frames"), select="select event_id, case when event_id % 4 < 3 then ip_hex end as packet from frames")
BYTES = [*view("registry"), *KEPT, *HEAD, *registered(), f"""byte_rows as (select p.capture_file, p.flow_id, p.packet_index as pkt_order,
 cast(cast(p.ts_us - p.flow_start_us as double) / 1e6 as float) as timestamp_rel, coalesce(s.h, repeat('0', 512)) as raw, coalesce(a.size, 0) as real_length,
 s.h is not null as found, l.label from flow_packets p join labelled l on l.matched and p.capture_file = l.capture_file and p.flow_id = l.flow_id
 left join (select * replace ({ABSENT} as capture_packet_index) from stored) s on s.capture_file = p.capture_file and s.capture_packet_index = p.capture_packet_index
 left join addressed a on a.event_id = s.event_id where p.packet_index < 5)"""]
ORACLES["store_summary"] = with_(view("frames"), FLOWS, select=f"""
select p.capture_file, 0 as slice, count(*) as packets, count(*) filter (where packet_index = 0) as flows, count(s.ip_hex) as frames,
 cast(sum(length(s.ip_hex) // 2) as bigint) as frame_bytes from flow_packets p
left join (select * replace ({ABSENT} as capture_packet_index) from frames) s on s.capture_file = p.capture_file and s.capture_packet_index = p.capture_packet_index
group by 1""")
ORACLES["byte_extraction"] = with_(BYTES, select="""
select capture_file, flow_id, pkt_order, md5(unhex(raw)) as digest, real_length, found, label from byte_rows""")
PACKED = [*BYTES, "classed as (select *, replace(label, ' - Attempted', '') as y from byte_rows)",
          """supported as (select y from (select distinct capture_file, flow_id, y, label from classed) c group by y
 having count(*) filter (where label not like '% - Attempted') >= 100)""",
          "usable as (select * from classed where found and y in (select y from supported))",
          "packed as (select capture_file, flow_id, min(y) as y, " + ", ".join(
              f"coalesce(max(case when pkt_order = {i} then substr(raw, 1, 512) end), repeat('0', 512)) as packet_{i}, "
              f"count(*) filter (where pkt_order = {i}) = 0 as padding_{i}, max(case when pkt_order = {i} then timestamp_rel end) as t{i}" for i in range(5))
          + " from usable group by 1, 2)"]
ORACLES["tensor_pack"] = with_(PACKED, select="select * exclude (t0, t1, t2, t3, t4) from packed")
ORACLES["byte_features"] = with_(PACKED, select="""
select capture_file, flow_id, 1280 as width, (select sum(cast(concat('0x', substr(x, 2 * i - 1, 2)) as bigint)) from range(1, 1281) r(i)) as byte_sum
from (select capture_file, flow_id, concat(packet_0, packet_1, packet_2, packet_3, packet_4) as x from packed) p""")
_ANGLE = "least(greatest(cast(t{i} as double), 0.0), 60.0) / 10.0"
ORACLES["time_encoding"] = with_(PACKED, select="select capture_file, flow_id, " + ", ".join(
    f"case when padding_{i} then 0.0 else round({fn}({_ANGLE.format(i=i)} * {omega}), 4) end as c{i}{j}"
    for i in range(5) for j, (fn, omega) in enumerate((("sin", "1.0"), ("cos", "1.0"), ("sin", "0.01"), ("cos", "0.01")))) + " from packed")

# --- scores -------------------------------------------------------------------------------------------------


def scored(source="predictions", by=""):
    """``scores``: per-class precision, recall, F1 and support."""
    b = f"{by}, " if by else ""
    return [f"""seen as (select {b}y_true as class, 1 as support, 0 as guessed, case when y_true = y_pred then 1 else 0 end as hits from {source}
 union all select {b}y_pred, 0, 1, 0 from {source})""",
            f"""scores as (select {b}class, {_SHARE.format('sum(hits)', 'sum(guessed)')} as precision, {_SHARE.format('sum(hits)', 'sum(support)')} as recall,
 {_SHARE.format('(2 * sum(hits))', '(sum(guessed) + sum(support))')} as f1, sum(support) as support from seen group by {b}class)"""]


P = view("predictions")
_ALL = "classes as (select distinct unnest([y_true, y_pred]) as class from predictions)"
ORACLES["confusion"] = with_(P, _ALL, select="""
select a.class as y_true, b.class as y_pred, (select count(*) from predictions p where p.y_true = a.class and p.y_pred = b.class) as n
from classes a, classes b""")
ORACLES["confusion_matrix"] = with_(P, _ALL, select="select class as y_true, " + ", ".join(
    f"(select count(*) from predictions p where p.y_true = c.class and p.y_pred = '{n}') as {n}" for n in ("click", "error", "purchase", "signup", "unknown", "view"))
    + " from classes c")
ORACLES["per_class_metrics"] = with_(P, scored(), select="select * from scores")
_R = "round({0}, 9) as {0}"
ORACLES["f1_summary"] = with_(P, scored(), select=f"""
select (select cast(count(*) filter (where y_true = y_pred) as double) / count(*) from predictions) as accuracy,
 round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1, (select count(*) from predictions) as rows from scores""")
MODELS = """two as (select 'one' as model, y_true, y_pred from predictions
 union all select 'two', y_true, case when row_id % 3 = 0 then 'view' else y_true end from predictions)"""
ORACLES["wide_f1"] = with_(P, MODELS, scored("two", "model"), select="""
select class, max(case when model = 'one' then f1 end) as one, max(case when model = 'two' then f1 end) as two, max(support) as support from scores group by class""")
ORACLES["model_summary"] = with_(P, MODELS, scored("two", "model"), select="""
select model, accuracy, round(macro_f1, 9) as macro_f1, round(weighted_f1, 9) as weighted_f1, rows
from (select model, avg(f1) as macro_f1, sum(f1 * support) / sum(support) as weighted_f1 from scores group by model) s
join (select model, cast(count(*) filter (where y_true = y_pred) as double) / count(*) as accuracy, count(*) as rows from two group by model) t using (model)""")
ORACLES["best_epoch"] = """
with recursive h as (select l_returnflag, l_linenumber as epoch, cast(sum(cast(round(l_tax * 100) as bigint)) as double) / count(*) as v
 from lineitem where l_linenumber <= 7 group by 1, 2),
o as (select *, row_number() over (partition by l_returnflag order by epoch) as rn from h),
run(l_returnflag, rn, epoch, best, best_at, stale) as (
 select l_returnflag, rn, epoch, v, epoch, 0 from o where rn = 1
 union all
 select o.l_returnflag, o.rn, o.epoch, greatest(r.best, o.v), case when o.v > r.best then o.epoch else r.best_at end,
  case when o.v > r.best then 0 else r.stale + 1 end
 from run r join o on o.l_returnflag = r.l_returnflag and o.rn = r.rn + 1 where r.stale < 2)
select l_returnflag, arg_max(best_at, rn) as best_epoch, max(best) as best_val_macro_f1, max(epoch) as stopped_at from run group by 1"""
REGIONS = {"ip_ttl": (8, 9), "tcp_window": (34, 36), "tcp_options": (40, 60)}
ORACLES["occlusion_drops"] = with_(P, "regional as (select ['none', 'ip_ttl', 'tcp_window', 'tcp_options'][cast(row_id % 4 as int) + 1] as region, * from predictions)",
    scored("regional", "region"), "macro as (select region, avg(f1) as m from scores group by region)", select=f"""
select region, "start", "end", "end" - "start" as n_bytes, round(m, 9) as macro_f1_occluded, round(m - b, 9) as delta_macro_f1, round(b - m, 9) as "drop"
from macro join (values {', '.join(f"('{n}', {s}, {e})" for n, (s, e) in REGIONS.items())}) v(region, "start", "end") using (region),
 (select m as b from macro where region = 'none') z""")

# --- experiments ------------------------------------------------------------------------------------------------


def spread(value, digits=9):
    return (f"count({value}) as n, round(avg({value}), {digits}) as mean, round(coalesce(stddev_samp({value}), 0), {digits}) as std")


RUNS, OCC = view("runs"), view("occlusion_runs")
ORACLES["seed_aggregate"] = with_(RUNS, select=f"select dataset, config, {spread('macro_f1')}, " + ", ".join(
    f"max(case when seed = {s} then macro_f1 end) as seed_{s}" for s in range(1, 6)) + " from runs group by 1, 2")
ORACLES["first_available"] = with_(RUNS, select="""
select dataset, config, seed, case when seed = 2 then macro_f1 + 1 else macro_f1 end as macro_f1 from runs""")
ORACLES["class_aggregate"] = with_(view("class_scores"), select=f"""
select dataset, config, class, {spread('f1')} from class_scores where class <> 'macro avg' group by 1, 2, 3""")
ORACLES["occlusion_aggregate"] = with_(OCC, select=f"select dataset, region, {spread('(-delta_macro_f1)')} from occlusion_runs group by 1, 2")
ORACLES["occlusion_baseline"] = with_(OCC, select=f"""
select dataset, {spread('baseline_macro_f1')} from (select distinct dataset, seed, baseline_macro_f1 from occlusion_runs) b group by 1""")
VOTES = """leaders as (select dataset, region, count(*) as votes from (select *, row_number() over (partition by dataset, seed
 order by delta_macro_f1, region) as place from occlusion_runs) o where place = 1 group by 1, 2)""", """voted as (select dataset, region, votes,
 sum(votes) over (partition by dataset) as "of", votes = max(votes) over (partition by dataset) as leads from leaders)"""
ORACLES["votes"] = with_(OCC, list(VOTES), select="""
select dataset, region, votes, "of", leads, leads and count(*) filter (where leads) over (partition by dataset) > 1 as tied from voted""")
_CUTS = ("pct_100", "packet_abs_5", "packet_abs_4", "packet_abs_3")
PAIRED = """paired as (select concat('window/', a.dataset, '/', replace(a.config, 'rf_', '')) as name, a.dataset, a.config as config_a, b.config as config_b,
 (a.macro_f1 - b.macro_f1) * 100 as points from runs a join runs b on a.dataset = b.dataset and a.seed = b.seed and b.config = concat(a.config, '_noInitWin')
 where a.config like 'rf_%')"""
_POINTS = "count(*) as n, round(avg(points), 9) as mean_points, round(coalesce(stddev_samp(points), 0), 9) as std_points"
ORACLES["paired_delta"] = with_(RUNS, PAIRED, select=f"select name, dataset, {_POINTS} from paired group by 1, 2")
ORACLES["probe_delta"] = with_(RUNS, select=f"""
select concat('probe/', dataset, '/strict') as name, dataset, {_POINTS} from (
 select a.dataset, (a.macro_f1 - b.macro_f1) * 100 as points from runs a join runs b using (dataset, seed)
 where a.config = 'transformer_packet_abs_3' and b.config = 'transformer_packet_abs_3_noInitWin') p group by dataset""")
ORACLES["completeness"] = with_(RUNS, select="select dataset, config, count(*) as n from runs group by 1, 2 having count(*) < 5")
ORACLES["grid_missing_inputs"] = with_(RUNS, """wanted as (select d as dataset, concat(c, '/raw_flow') as input
 from (values ('north'), ('cic_ids2018'), ('south'), ('cic_iot2023')) x(d), (values ('pct_100'), ('packet_abs_5'), ('packet_abs_4'), ('packet_abs_3')) y(c)
 union all values ('north', 'packet_abs_2/raw_flow'), ('cic_iot2023', 'packet_abs_2/raw_flow'), ('cic_iot2023', 'packet_abs_1/raw_flow'))""", select="""
select dataset, input from wanted except select dataset, concat(replace(replace(replace(config, 'rf_', ''), 'transformer_', ''), '_noInitWin', ''), '/raw_flow') from runs""")
_cell = lambda c: f"round(avg(case when config = '{c}' then macro_f1 end), 9)"
ORACLES["table_pivot"] = with_(RUNS, select=f"""
select *, (rf_pct_100 is null)::int + (rf_packet_abs_3 is null)::int + (rf_packet_abs_1 is null)::int as missing
from (select dataset, {', '.join(f'{_cell(c)} as {c}' for c in ('rf_pct_100', 'rf_packet_abs_3', 'rf_packet_abs_1'))} from runs group by dataset) t""")
ORACLES["window_table"] = with_(RUNS, PAIRED, f"stats as (select dataset, config, {spread('macro_f1')} from runs group by 1, 2)",
    f"gaps as (select name, {_POINTS} from paired group by 1)",
    "wanted as (select concat('window/', d, '/', c) as name, d as dataset, concat('rf_', c) as config_a, concat('rf_', c, '_noInitWin') as config_b from (values ('north'), ('south'), ('west')) x(d), "
    + "(values " + ", ".join(f"('{c}')" for c in _CUTS) + ") y(c))", select="""
select w.*, a.mean as mean_a, a.std as std_a, b.mean as mean_b, b.std as std_b, -mean_points as loss_points, std_points as loss_std, mean_points is null as missing
from wanted w left join stats a on a.dataset = w.dataset and a.config = config_a left join stats b on b.dataset = w.dataset and b.config = config_b
left join gaps using (name)""")
ORACLES["occlusion_table"] = with_(OCC, list(VOTES), select="""
select dataset, tcp_options, ip_checksum, tcp_window, ip_ttl, most_affected, votes, "of" from (select dataset, """ + ", ".join(
    f"round(avg(case when region = '{r}' then -delta_macro_f1 end), 9) as {r}" for r in ("tcp_options", "ip_checksum", "tcp_window", "ip_ttl")) + """ from occlusion_runs group by 1) r
join (select dataset, string_agg(region, ' / ' order by region) as most_affected, max(votes) as votes, max("of") as "of" from voted where leads group by 1) v using (dataset)""")
ORACLES["packet_series"] = with_(RUNS, select=f"""
select dataset, case when config like 'rf%' then 'rf' else 'transformer' end as family, cast(regexp_extract(config, 'abs_([0-9]+)', 1) as int) as packets, config,
 round(avg(macro_f1), 9) as mean, round(coalesce(stddev_samp(macro_f1), 0), 9) as std from runs where config like '%abs%' group by dataset, config""")
ORACLES["top_regions"] = with_(OCC, select="""
select dataset, region, round(mean, 9) as mean, round(std, 9) as std, case when region like 'tcp%' then 'tcp' when region like 'payload%' then 'payload' else 'ip' end as category
from (select dataset, region, avg(-delta_macro_f1) as mean, coalesce(stddev_samp(-delta_macro_f1), 0) as std from occlusion_runs group by 1, 2
 qualify row_number() over (partition by dataset order by mean desc, region) <= 13) t""")
ORACLES["missing_keys"] = with_(RUNS, select="""
select dataset, replace(config, 'abs_5', 'abs_6') as config from runs where config like '%abs_5%' group by all""")

# --- sources and whole builds ---------------------------------------------------------------------------------------

ORACLES["packet_file_roundtrip"] = with_(view("packet_fields"), UNIFIED, select="""
select protocol, count(*) as packets, sum(payload_len) as payload, sum(src_port) as src_ports, sum(tcp_flags) as flags, sum(ttl) as ttls, max(ts_us) as last_us
from unified group by protocol""")
ORACLES["registry_file_roundtrip"] = with_(view("registry"), select="""
select label, attempted_category, count(*) as rows, sum(flow_start_us) as starts from registry group by 1, 2""")
ORACLES["csv_clean_numeric"] = """
select cast(o_orderkey as double) as o_orderkey, cast(o_custkey as double) as o_custkey,
 case when o_orderkey % 9 <> 0 then cast(o_totalprice as double) end as o_totalprice, o_orderstatus as "Label" from orders"""
ORACLES["ingest_manifest"] = """
select concat('part_', o_orderstatus) as file, count(*) filter (where o_orderkey % 50 <> 1) as rows, 2 as columns,
 count(*) filter (where o_orderkey % 50 = 1) as dropped_headers from orders group by 1"""
ORACLES["first_packet_scan"] = with_(FLOWS, select="select capture_file, flow_id, packet_index, payload_len from flow_packets where packet_index < 3")
ORACLES["day_balance"] = with_(DAYS, select="""
select day, count(*) as rows, count(*) filter (where label_encoded = 0) as benign, count(*) filter (where label_encoded <> 0) as attack from dayed group by 1""")
ORACLES["path_labels"] = """
select concat('/data/captures/', event_type, '/host-', user_id, '.pcap') as path, event_type as class, concat('host-', user_id) as part, count(*) as rows
from events group by event_type, user_id"""
ORACLES["capture_names"] = """
select name, coalesce(suffix not in ('.lnk', '.txt'), true) as capture, count(*) as rows
from (select ['', '.pcap', '.PCAPNG', '.lnk', '.txt', '.cap', ' part 2', '-part3'][cast(event_id % 8 as int) + 1] as suffix,
 concat('UCAP172.31.69.', user_id % 200, suffix) as name from events) e group by 1, 2"""
ORACLES["bounded_files"] = """
select part, file from (select part, file, row_number() over (partition by part order by file) as place
 from (select distinct event_type as part, cast(user_id as varchar) as file from events) d) r where place <= 5"""
ORACLES["parts_union"] = """
select c_custkey as id, c_acctbal as balance, c_name as name from customer union all select s_suppkey, null, s_name from supplier"""
ORACLES["part_statistics"] = with_(RULES, HEAD, rule_labels(), select="""
select (select count(*) from flow_packets) as packet_rows, count(*) as flow_rows, count(*) filter (where label = 'Benign') as unlabeled_flow_rows,
 count(*) filter (where label = 'Benign') as na, count(*) filter (where label = 'DoS Hulk') as hulk, count(*) filter (where label = 'Botnet') as botnet,
 count(*) filter (where label = 'Portscan') as portscan from ruled""")
ORACLES["registry_cuts"] = with_(view("registry"), HEAD, registered(keep="desc"), cut_rows("packet_abs_3", "packet_abs_5"), select="""
select cut, label, matched, count(distinct concat(c.capture_file, c.flow_id)) as flows, count(*) filter (where direction = 1) as fwd,
 cast(coalesce(sum(case when direction = 0 then payload_len end), 0) as double) as bwd_bytes
from cut_packets c join labelled l on c.capture_file = l.capture_file and c.flow_id = l.flow_id group by 1, 2, 3""")
ORACLES["day_build"] = with_(RULES, DUP, f"kept as (select * from judged where not duplicate and {KEEP['pct_050']})",
    """heads as (select capture_file, flow_id, k, min(flow_src_ip) as flow_src_ip, min(flow_dst_ip) as flow_dst_ip, min(flow_src_port) as flow_src_port,
 min(flow_dst_port) as flow_dst_port, min(flow_start_us) as flow_start_us, count(*) filter (where direction = 1) as fwd, max(ts_us) - min(flow_start_us) as duration
 from kept group by capture_file, flow_id, k)""", rule_labels(), select="""
select label, label_encoded, count(*) as flows, sum(fwd) as fwd, cast(sum(duration) as double) as duration from ruled group by 1, 2""")


def _selection_oracle():
    from packetloom.operators.features import FEATURES

    columns = ["protocol", *[c for c in FEATURES if c not in ("protocol", "dst_port")]]
    clean = ", ".join(f"case when abs({c}) < cast('Infinity' as double) then cast({c} as double) else 0.0 end as {c}" for c in columns)
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    ORACLES["feature_selection"] = with_(
        TABLE, f"clean as (select row_number() over () as r, {clean} from flow_features)",
        f"long as materialized (select r, feature, position, value from (unpivot clean on {', '.join(columns)} into name feature value value) u join (values {order}) o(feature, position) using (feature))",
        "varying as (select feature, position from long group by 1, 2 having min(value) < max(value))",
        """correlated as (select distinct a.feature from (select * from long where feature in (select feature from varying)) a
 join (select * from long where feature in (select feature from varying)) b on a.r = b.r and a.position < b.position
 group by a.feature, b.feature having abs(corr(a.value, b.value)) > 0.95)""",
        select=f"""select feature, position, case when feature not in (select feature from varying) then 'constant'
 when feature in (select feature from correlated) then 'correlated' else 'kept' end as reason from (values {order}) o(feature, position)""")


_selection_oracle()
