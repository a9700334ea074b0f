"""Flow features: one hash aggregation over packets that carry look-back values.

Means and population deviations come from exact integer moments (count, sum and
sum of squares), so results do not depend on how rows were partitioned. Gaps inside
a flow sum to at most the flow timeout, so their squares fit a BIGINT; only the
final difference of moments needs a DECIMAL, once per flow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packets import TCP, has_flag, rate_per_second, ratio_or_zero
from packetloom.operators.flows import ACTIVE_GAP_SECONDS, FLOW

# The raw flow table, column by column, as (own name, published name).
RAW_FLOW_COLUMNS = [
    ("day", "day"),
    ("capture_file", "capture_file"),
    ("flow_id", "flow_id"),
    ("flow_src_ip", "flow_src_ip"),
    ("flow_dst_ip", "flow_dst_ip"),
    ("flow_src_port", "flow_src_port"),
    ("flow_dst_port", "flow_dst_port"),
    ("flow_start_ts", "flow_start_ts"),
    ("flow_end_ts", "flow_end_ts"),
    ("dst_port", "Dst Port"),
    ("protocol", "Protocol"),
    ("flow_duration", "Flow Duration"),
    ("tot_fwd_pkts", "Tot Fwd Pkts"),
    ("tot_bwd_pkts", "Tot Bwd Pkts"),
    ("totlen_fwd_pkts", "TotLen Fwd Pkts"),
    ("totlen_bwd_pkts", "TotLen Bwd Pkts"),
    ("fwd_pkt_len_max", "Fwd Pkt Len Max"),
    ("fwd_pkt_len_min", "Fwd Pkt Len Min"),
    ("fwd_pkt_len_mean", "Fwd Pkt Len Mean"),
    ("fwd_pkt_len_std", "Fwd Pkt Len Std"),
    ("bwd_pkt_len_max", "Bwd Pkt Len Max"),
    ("bwd_pkt_len_min", "Bwd Pkt Len Min"),
    ("bwd_pkt_len_mean", "Bwd Pkt Len Mean"),
    ("bwd_pkt_len_std", "Bwd Pkt Len Std"),
    ("flow_byts_s", "Flow Byts/s"),
    ("flow_pkts_s", "Flow Pkts/s"),
    ("flow_iat_mean", "Flow IAT Mean"),
    ("flow_iat_std", "Flow IAT Std"),
    ("flow_iat_max", "Flow IAT Max"),
    ("flow_iat_min", "Flow IAT Min"),
    ("fwd_iat_tot", "Fwd IAT Tot"),
    ("fwd_iat_mean", "Fwd IAT Mean"),
    ("fwd_iat_std", "Fwd IAT Std"),
    ("fwd_iat_max", "Fwd IAT Max"),
    ("fwd_iat_min", "Fwd IAT Min"),
    ("bwd_iat_tot", "Bwd IAT Tot"),
    ("bwd_iat_mean", "Bwd IAT Mean"),
    ("bwd_iat_std", "Bwd IAT Std"),
    ("bwd_iat_max", "Bwd IAT Max"),
    ("bwd_iat_min", "Bwd IAT Min"),
    ("fwd_psh_flags", "Fwd PSH Flags"),
    ("fwd_urg_flags", "Fwd URG Flags"),
    ("fwd_pkts_s", "Fwd Pkts/s"),
    ("bwd_pkts_s", "Bwd Pkts/s"),
    ("pkt_len_max", "Pkt Len Max"),
    ("pkt_len_std", "Pkt Len Std"),
    ("pkt_len_var", "Pkt Len Var"),
    ("fin_flag_cnt", "FIN Flag Cnt"),
    ("syn_flag_cnt", "SYN Flag Cnt"),
    ("rst_flag_cnt", "RST Flag Cnt"),
    ("psh_flag_cnt", "PSH Flag Cnt"),
    ("ack_flag_cnt", "ACK Flag Cnt"),
    ("urg_flag_cnt", "URG Flag Cnt"),
    ("down_up_ratio", "Down/Up Ratio"),
    ("pkt_size_avg", "Pkt Size Avg"),
    ("init_fwd_win_byts", "Init Fwd Win Byts"),
    ("init_bwd_win_byts", "Init Bwd Win Byts"),
    ("fwd_act_data_pkts", "Fwd Act Data Pkts"),
    ("fwd_seg_size_min", "Fwd Seg Size Min"),
    ("active_mean", "Active Mean"),
    ("active_std", "Active Std"),
    ("active_max", "Active Max"),
    ("active_min", "Active Min"),
    ("idle_mean", "Idle Mean"),
    ("idle_std", "Idle Std"),
    ("idle_max", "Idle Max"),
    ("idle_min", "Idle Min"),
    ("label", "Label"),
    ("label_encoded", "label_encoded"),
]

IDENTITY = ["flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "protocol", "flow_start_us"]
PACKET_INPUTS = ["payload_len", "ip_hdr_len", "tcp_win"]
FEATURES = [own for own, _ in RAW_FLOW_COLUMNS[10:67]]
UNLABELED = -1


def _moments(value: Column, name: str) -> dict[str, Column]:
    """Exact partial sums of an integer column; NULLs are ignored."""
    value = value.cast("long")
    return {
        f"{name}__n": F.count(value), f"{name}__s": F.sum(value), f"{name}__q": F.sum(value * value),
        f"{name}__max": F.max(value), f"{name}__min": F.min(value),
    }


def _mean(n: Column, s: Column) -> Column:
    return F.when(n > 0, s.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def _spread(n: Column, s: Column, q: Column) -> Column:
    """n²·variance, exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (wide(n) * wide(q) - wide(s) * wide(s)).cast("double")


def _std(n: Column, s: Column, q: Column) -> Column:
    return F.when(n > 1, F.sqrt(_spread(n, s, q)) / n.cast("double")).otherwise(F.lit(0.0))


def _stats(name: str, out: str, parts: Sequence[str] = ("mean", "std", "max", "min")) -> list[Column]:
    n, s, q = F.col(f"{name}__n"), F.col(f"{name}__s"), F.col(f"{name}__q")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    made = {
        "tot": zero(f"{name}__s"), "mean": _mean(n, s), "std": _std(n, s, q),
        "max": zero(f"{name}__max"), "min": zero(f"{name}__min"),
    }
    return [made[p].alias(f"{out}_{p}") for p in parts]


def flow_features(
    packets: DataFrame,
    by: Sequence[str] = (),
    active_gap_seconds: float = ACTIVE_GAP_SECONDS,
) -> DataFrame:
    """57 features per flow, plus identity and start/end times.

    ``packets`` come from :func:`group_into_flows` with the same gap, cut or not;
    ``by`` adds grouping columns, for instance the tag of a cut grid or a day.
    """
    gap_us = round(active_gap_seconds * 1e6)
    fwd, bwd = F.col("direction") == 1, F.col("direction") == 0
    payload, iat, side = F.col("payload_len"), F.col("iat_us"), F.col("side_iat_us")
    index = F.col("packet_index")
    any_flag = lambda name: F.coalesce(F.max(F.when(fwd, has_flag("tcp_flags", name).cast("int"))), F.lit(0))
    first_window = lambda way: F.min_by(F.when(way, F.col("tcp_win")), F.when(way, index))

    wanted: dict[str, Column] = {
        "flow_end_us": F.max("ts_us"),
        "tot_fwd_pkts": F.count_if(fwd), "tot_bwd_pkts": F.count_if(bwd),
        "fwd_act_data_pkts": F.count_if(fwd & (payload > 0)),
        "fwd_seg_size_min": F.coalesce(F.min(F.when(fwd, F.col("ip_hdr_len"))).cast("double"), F.lit(0.0)),
        "fwd_psh_flags": any_flag("psh"), "fwd_urg_flags": any_flag("urg"),
        "_win_fwd": first_window(fwd), "_win_bwd": first_window(bwd),
        "_last_active": F.max_by("active_us", index),
    }
    for name in ("fin", "syn", "rst", "psh", "ack", "urg"):
        wanted[f"{name}_flag_cnt"] = F.count_if(has_flag("tcp_flags", name))
    for name, value in {
        "_fl": F.when(fwd, payload), "_bl": F.when(bwd, payload), "_al": payload,
        "_fi": iat, "_fs": F.when(fwd, side), "_bs": F.when(bwd, side),
        "_ac": F.col("closed_active_us"), "_id": F.when(iat > gap_us, iat),
    }.items():
        wanted.update(_moments(value, name))

    rows = packets.groupBy(*by, *FLOW, *IDENTITY).agg(*[c.alias(k) for k, c in wanted.items()])

    # The running activity segment joins the closed ones.
    last = F.col("_last_active")
    rows = rows.select(
        "*",
        (F.col("_ac__n") + 1).alias("_at__n"),
        (F.coalesce("_ac__s", F.lit(0)) + last).alias("_at__s"),
        (F.coalesce("_ac__q", F.lit(0)) + last * last).alias("_at__q"),
        F.greatest("_ac__max", last).alias("_at__max"),
        F.least("_ac__min", last).alias("_at__min"),
        F.greatest(F.col("flow_end_us") - F.col("flow_start_us"), F.lit(0)).alias("_dur"),
    )
    duration = F.col("_dur").cast("double")
    packets_n = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")
    length = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double")
    n, s, q = F.col("_al__n"), F.col("_al__s"), F.col("_al__q")
    tcp = F.col("protocol") == TCP
    window = lambda c: F.when(tcp, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(-1)).cast("int")

    made = [
        F.col("flow_dst_port").alias("dst_port"),
        duration.alias("flow_duration"),
        F.col("tot_fwd_pkts").cast("int").alias("tot_fwd_pkts"),
        F.col("tot_bwd_pkts").cast("int").alias("tot_bwd_pkts"),
        length("_fl__s").alias("totlen_fwd_pkts"), length("_bl__s").alias("totlen_bwd_pkts"),
        *_stats("_fl", "fwd_pkt_len", ("max", "min", "mean", "std")),
        *_stats("_bl", "bwd_pkt_len", ("max", "min", "mean", "std")),
        rate_per_second(length("_fl__s") + length("_bl__s"), duration).alias("flow_byts_s"),
        rate_per_second(packets_n, duration).alias("flow_pkts_s"),
        *_stats("_fi", "flow_iat"),
        *_stats("_fs", "fwd_iat", ("tot", "mean", "std", "max", "min")),
        *_stats("_bs", "bwd_iat", ("tot", "mean", "std", "max", "min")),
        "fwd_psh_flags", "fwd_urg_flags",
        rate_per_second("tot_fwd_pkts", duration).alias("fwd_pkts_s"),
        rate_per_second("tot_bwd_pkts", duration).alias("bwd_pkts_s"),
        length("_al__max").alias("pkt_len_max"),
        _std(n, s, q).alias("pkt_len_std"),
        (_spread(n, s, q) / (n.cast("double") * n.cast("double"))).alias("pkt_len_var"),
        *[F.col(f"{f}_flag_cnt").cast("int").alias(f"{f}_flag_cnt") for f in ("fin", "syn", "rst", "psh", "ack", "urg")],
        ratio_or_zero("tot_bwd_pkts", "tot_fwd_pkts").alias("down_up_ratio"),
        _mean(n, s).alias("pkt_size_avg"),
        window("_win_fwd").alias("init_fwd_win_byts"), window("_win_bwd").alias("init_bwd_win_byts"),
        F.col("fwd_act_data_pkts").cast("int").alias("fwd_act_data_pkts"), "fwd_seg_size_min",
        *_stats("_at", "active"), *_stats("_id", "idle"),
    ]
    return rows.select(*by, *FLOW, *IDENTITY, "flow_end_us", *made)


def to_raw_flow_table(features: DataFrame, day: Column | str) -> DataFrame:
    """The published 69-column layout; unlabelled rows carry NULL and -1."""
    day = F.lit(day) if isinstance(day, str) else day
    full = (
        features.withColumn("day", day)
        .withColumn("flow_start_ts", F.col("flow_start_us").cast("double") / 1e6)
        .withColumn("flow_end_ts", F.col("flow_end_us").cast("double") / 1e6)
    )
    if "label" not in features.columns:
        full = full.withColumn("label", F.lit(None).cast("string"))
    if "label_encoded" not in features.columns:
        full = full.withColumn("label_encoded", F.lit(UNLABELED))
    return full.select(*[F.col(own).alias(shown) for own, shown in RAW_FLOW_COLUMNS])
