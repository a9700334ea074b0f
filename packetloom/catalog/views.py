"""Inputs of the registered queries, derived from the given tables.

One SQL text per view serves both engines; three placeholders cover what they
spell differently. Views may use earlier views by name.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK = {
    "S": "string",
    "US": "unix_micros(cast(ts as timestamp)) div 1000",
    "DIVS": "ts_us div 1000000",
    "DIV": "div",
}
DUCK = {"S": "varchar", "US": "epoch_us(ts) // 1000", "DIVS": "ts_us // 1000000", "DIV": "//"}


def _octets(column: str) -> str:
    parts = [f"lpad(hex(cast(split_part({column},'.',{i}) as int)),2,'0')" for i in (1, 2, 3, 4)]
    return "concat(" + ", ".join(parts) + ")"


for _names in (SPARK, DUCK):
    _names["IPS"], _names["IPD"] = _octets("src_ip"), _octets("dst_ip")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

# Packets: events with time compressed 1000 times, so that 120 s timeouts bite.
VIEWS["packets"] = ((), """
select event_id, concat('UCAP172.31.0.', cast(user_id % 4 + 1 as {S})) as capture_file,
 event_id as capture_packet_index, {US} as ts_us,
 case when event_id % 3 = 0 then sip else cip end as src_ip,
 case when event_id % 3 = 0 then cip else sip end as dst_ip,
 case when event_id % 3 = 0 then sport else cport end as src_port,
 case when event_id % 3 = 0 then cport else sport end as dst_port,
 protocol, 20 as ip_hdr_len, payload_len,
 payload_len + 20 + case protocol when 6 then 20 when 17 then 8 else 0 end as ip_len,
 case when protocol <> 6 then 0 when event_type='signup' then 2 when event_type='click' then 16
      when event_type='view' then 24 when event_type='purchase' then 17
      when event_id % 4 = 0 then 20 else 16 end as tcp_flags,
 case when event_id % 3 = 0 then 64 else 128 end as ttl,
 case when protocol = 6 then cast((event_id * 7919) % 65536 as int) else 0 end as tcp_win
from (select *, concat('10.0.', cast(user_id % 5 as {S}), '.', cast(user_id % 250 as {S})) as cip,
  concat('172.31.0.', cast(user_id % 4 + 1 as {S})) as sip,
  case user_id % 5 when 4 then 0 else cast(40000 + user_id % 20000 as int) end as cport,
  case when user_id % 5 = 4 then 0 when user_id % 3 = 0 then 80 when user_id % 3 = 1 then 443 else 22 end as sport,
  case user_id % 5 when 3 then 17 when 4 then 1 else 6 end as protocol,
  cast(floor(value) as int) as payload_len from events)""")

# The same packets as decoder output: separate transport fields, hex flags, NULLs.
VIEWS["packet_fields"] = (("packets",), """
select capture_file, capture_packet_index, ts_us, src_ip, dst_ip, protocol, ip_hdr_len, ip_len,
 case when protocol = 6 then src_port end as tcp_srcport, case when protocol = 6 then dst_port end as tcp_dstport,
 case when protocol = 6 then payload_len end as tcp_len,
 case when protocol = 17 then src_port end as udp_srcport, case when protocol = 17 then dst_port end as udp_dstport,
 case when protocol = 17 then payload_len + case when event_id % 13 = 0 then 2 else 8 end end as udp_length,
 case when protocol = 6 then concat('0x', lpad(lower(hex(tcp_flags)), 4, '0')) end as tcp_flags_hex,
 case when event_id % 17 <> 0 then ttl end as ttl,
 case when protocol = 6 then tcp_win end as tcp_window
from packets""")

# A tenth of the packets run between two captured hosts and are seen by both.
VIEWS["packets_dup"] = (("packets",), """
select p.event_id, capture_file, capture_packet_index, ts_us, src_ip, dst_ip, src_port, dst_port,
  protocol, ip_hdr_len, payload_len, ip_len, tcp_flags, ttl, tcp_win from packets p where event_id % 10 <> 7
union all
select event_id, case when seen = 1 then capture_file else concat('UCAP', peer) end as capture_file,
  capture_packet_index, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, ip_hdr_len, payload_len,
  ip_len, tcp_flags, ttl, tcp_win
from (select *, case when from_client = 1 then src_ip else dst_ip end as peer from (
  select event_id, capture_file, capture_packet_index, ts_us,
   case when src_ip like '10.%' then concat('172.31.0.', cast(event_id % 3 + 1 as {S})) else src_ip end as src_ip,
   case when dst_ip like '10.%' then concat('172.31.0.', cast(event_id % 3 + 1 as {S})) else dst_ip end as dst_ip,
   case when src_ip like '10.%' then 1 else 0 end as from_client,
   src_port, dst_port, protocol, ip_hdr_len, payload_len, ip_len, tcp_flags, ttl, tcp_win
   from packets where event_id % 10 = 7) r) q
cross join (select 1 as seen union all select 2 as seen) s
where seen = 1 or concat('UCAP', peer) <> capture_file""")

# Label registry of every packet: directional 5-tuple and start time, one fifth shifted by 0.4 s, one third
# by a day, so that no flow matches those.
VIEWS["registry"] = (("packets",), """
select row_ord, capture_file, flow_src_ip, flow_src_port, flow_dst_ip, flow_dst_port, protocol,
 ts_us + case when row_ord % 5 = 1 then 400000 else 0 end + case when row_ord % 3 = 2 then 86400000000 else 0 end as flow_start_us,
 case when row_ord % 7 = 0 then 'BENIGN' when row_ord % 7 < 3 then 'DoS Hulk' when row_ord % 7 < 5 then 'Portscan'
      when row_ord % 7 = 5 then 'Botnet' else 'Botnet - Attempted' end as label,
 case when row_ord % 7 = 6 then 2 else -1 end as attempted_category
from (select event_id as row_ord, capture_file, ts_us, protocol,
  first_value(src_ip) over w as flow_src_ip, first_value(src_port) over w as flow_src_port,
  first_value(dst_ip) over w as flow_dst_ip, first_value(dst_port) over w as flow_dst_port
  from packets
  window w as (partition by capture_file, least(src_ip,dst_ip), greatest(src_ip,dst_ip),
   least(src_port,dst_port), greatest(src_port,dst_port), protocol order by ts_us, capture_packet_index)) x""")

# The registry with every key repeated under another label.
VIEWS["registry_repeated"] = (("registry",), """
select row_ord, flow_src_ip, flow_src_port, flow_dst_ip, flow_dst_port, protocol, flow_start_us, label, attempted_category
from registry
union all
select row_ord + 1000000000 as row_ord, flow_src_ip, flow_src_port, flow_dst_ip, flow_dst_port, protocol, flow_start_us,
 'Relabelled' as label, 4 as attempted_category from registry where row_ord % 2 = 0""")

# Ground truth of every packet in whole seconds with protocol names and recurring keys, three quarters of it a day late.
VIEWS["gt"] = (("packets",), """
select event_id as gt_ord, {DIVS} + case when event_id % 4 = 0 then 0 else 86400 end as ts, src_ip, src_port, dst_ip, dst_port,
 case protocol when 6 then ' TCP' when 17 then 'udp' else 'icmp' end as proto,
 case event_id % 3 when 0 then 'ddos' when 1 then 'scanning' else 'xss' end as type
from packets""")

VIEWS["rules"] = ((), """
select * from (values
 (0,'DoS Hulk','10.0.0.','172.31.0.1',-1,1704100,1706000),
 (1,'DoS Slow','10.0.0.','172.31.0.1',-1,1704500,1704900),
 (2,'Botnet','10.0.2.','172.31.0.3',-1,1704100,1705500),
 (3,'Portscan','10.0.1.','172.31.0.2',443,1705000,1706500)
) as t(rule_pos,label,attacker_prefix,victim_ip,victim_port,start_s,end_s)""")

# Rules per attacker address; victim_port -1 means any.
VIEWS["rule_ips"] = (("packets", "rules"), """
select distinct rule_pos, label, victim_ip, victim_port, start_s, end_s, p.ip as attacker_ip
from rules cross join (select src_ip as ip from packets union select dst_ip as ip from packets) p
where p.ip like concat(attacker_prefix, '%')""")

# Truth and prediction; one class is never predicted, one is never true.
VIEWS["predictions"] = ((), """
select event_id as row_id, event_type as y_true,
 case when event_id % 5 = 0 then 'view' when event_id % 11 = 0 then 'unknown'
      when event_type = 'signup' then 'click' else event_type end as y_pred
from events""")

# Seeded scores: dataset x configuration x seed from all lines; one configuration has three seeds instead of five.
VIEWS["runs"] = ((), """
select dataset, config, seed, cast(sum(discount) as double) / (sum(lines) * 10) as macro_f1 from (
 select dataset, config, case when dataset = 'west' and config = 'rf_packet_abs_3_noInitWin' then (line - 1) % 3 + 1 else (line - 1) % 5 + 1 end as seed,
  discount, lines from (
 select case l_returnflag when 'A' then 'north' when 'N' then 'south' else 'west' end as dataset,
  concat(case l_linestatus when 'O' then 'rf_' else 'transformer_' end,
   case when l_partkey % 4 = 0 then 'pct_100' when l_partkey % 4 = 1 then 'packet_abs_5'
        when l_partkey % 4 = 2 then 'packet_abs_4' else 'packet_abs_3' end,
   case when l_suppkey % 2 = 0 then '' else '_noInitWin' end) as config,
  l_linenumber as line, sum(cast(round(l_discount * 100) as bigint)) as discount, count(*) as lines
 from lineitem group by 1, 2, 3) x) y group by 1, 2, 3""")

# Occlusion results: score after zeroing a region, per dataset and seed.
VIEWS["occlusion_runs"] = ((), """
select dataset, seed, region, cast(0.9 as double) - seed * cast(0.01 as double) as baseline_macro_f1,
 -cast(lost as double) / cast(total as double) as delta_macro_f1
from (select case l_returnflag when 'A' then 'north' when 'N' then 'south' else 'west' end as dataset,
  (l_linenumber - 1) % 5 + 1 as seed,
  case l_suppkey % 5 when 0 then 'ip_ttl' when 1 then 'tcp_window' when 2 then 'tcp_options'
       when 3 then 'ip_checksum' else 'payload_60_128' end as region,
  sum(cast(l_quantity as bigint)) as lost, sum(cast(l_quantity as bigint)) + 100000 as total
 from lineitem group by 1, 2, 3) x""")

# Per-class scores of seeded runs.
VIEWS["class_scores"] = ((), """
select case l_returnflag when 'A' then 'north' when 'N' then 'south' else 'west' end as dataset,
  case l_linestatus when 'O' then 'rf_pct_100' else 'rf_packet_abs_3' end as config,
  (l_linenumber - 1) % 5 + 1 as seed,
  case when l_partkey % 4 = 3 then 'macro avg' else concat('class_', cast(l_partkey % 4 as {S})) end as class,
  cast(sum(cast(round(l_discount * 100) as bigint)) as double) / (count(*) * 10) as f1
from lineitem group by 1, 2, 3, 4""")

# A tenth of the frames carry an ordinal that no packet has, so their packets go without bytes.
ABSENT = "case when event_id % 10 = 3 then -1 - capture_packet_index else capture_packet_index end"

# IPv4 packets as hex; TCP carries 12 option bytes on even ids.
VIEWS["frames"] = (("packets",), """
select event_id, capture_file, capture_packet_index, protocol, ts_us,
 concat('4500', lpad(hex(least(ip_len + opt, 65535)), 4, '0'), lpad(hex(event_id % 65536), 4, '0'), '4000',
  lpad(hex(ttl), 2, '0'), lpad(hex(protocol), 2, '0'), 'BEEF', {IPS}, {IPD},
  case when protocol = 6 then concat(lpad(hex(src_port), 4, '0'), lpad(hex(dst_port), 4, '0'),
        lpad(hex(event_id), 8, '0'), '00000000', case when opt > 0 then '80' else '50' end,
        lpad(hex(tcp_flags), 2, '0'), lpad(hex(tcp_win), 4, '0'), 'CAFE0000',
        case when opt > 0 then '020405B40402080A00000001' else '' end)
       when protocol = 17 then concat(lpad(hex(src_port), 4, '0'), lpad(hex(dst_port), 4, '0'),
        lpad(hex(payload_len + 8), 4, '0'), '0000') else '' end,
  repeat('A5', payload_len)) as ip_hex
from (select *, case when protocol = 6 and event_id % 2 = 0 then 12 else 0 end as opt from packets)""")


def closure(names: tuple[str, ...]) -> list[str]:
    """The views needed for ``names``, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name not in VIEWS:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        out.append(name)

    for name in names:
        visit(name)
    return out


def duck_ctes(*names: str) -> list[str]:
    """``name as (...)`` texts for the oracle's WITH clause."""
    return [f"{n} as ({VIEWS[n][1].strip().format(**DUCK)})" for n in closure(names)]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame; registers what it reads as temp views."""
    if name in TABLES:
        return load(spark, sf_dir, name)
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip().format(**SPARK)})" for n in closure((name,)))
    sources = {t: load(spark, sf_dir, t) for t in ("events", "lineitem") if f" {t}" in ctes}
    text = f"with {ctes}\nselect * from {name}"
    for table, df in sources.items():
        df.createOrReplaceTempView(table)
    return spark.sql(text)
