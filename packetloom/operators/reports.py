"""Report tables over labelled flows and packets. Aggregations only; rows never leave
the executors ungrouped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.classes import collapse_attempt, is_attempt, shown_label
from packetloom.functions.packets import INFINITY, is_internal

# The columns the quality report scans.
SCANNED = [
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts",
    "totlen_bwd_pkts", "flow_byts_s", "flow_pkts_s", "pkt_len_var",
]
NEVER_NEGATIVE = [
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "pkt_len_var",
]
RATES = ["flow_byts_s", "flow_pkts_s"]

# Quantiles of the match distance report.
DELTA_QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def _whole():
    """Over all rows of an already aggregated table."""
    return Window.partitionBy()


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def _is_infinite(name: str) -> Column:
    return F.coalesce(F.abs(F.col(name)) == INFINITY, F.lit(False))


def coverage(labelled: DataFrame) -> DataFrame:
    matched = F.count_if("matched")
    total = F.count(F.lit(1))
    return labelled.agg(
        total.alias("n_total"), matched.alias("n_matched"), (total - matched).alias("n_unmatched"),
        (_share(matched, total) * 100).alias("pct_matched"),
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(shown_label("label").alias("label")).agg(F.count(F.lit(1)).alias("count"))


def label_summary(labelled: DataFrame) -> DataFrame:
    """Count per label with its percentage at two digits, most frequent first."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count").cast("double") / F.sum("count").over(_whole()).cast("double") * 100
    pct = F.rint(share * 100) / 100
    return counts.withColumn("pct", pct).orderBy(F.desc("count"), "label")


def day_label_mix(labelled: DataFrame, day_order: Column | str = "day") -> DataFrame:
    counts = labelled.groupBy("day", shown_label("label").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("day"))
    order = F.col(day_order) if isinstance(day_order, str) else day_order
    return (
        counts.withColumn("day_total", total)
        .withColumn("day_share", _share(F.col("count"), F.col("day_total")))
        .orderBy(order, F.desc("count"), "label")
    )


def day_summary(labelled: DataFrame, benign: str = "Benign") -> DataFrame:
    shown = shown_label("label")
    rows, calm = F.count(F.lit(1)), F.count_if(shown == benign)
    return labelled.groupBy("day").agg(
        rows.alias("rows_total"), calm.alias("benign_rows"), (rows - calm).alias("attack_rows"),
        _share(rows - calm, rows).alias("attack_ratio"), F.countDistinct(shown).alias("distinct_labels"),
    )


def global_label_shares(labelled: DataFrame) -> DataFrame:
    counts = label_counts(labelled)
    return counts.withColumn("share", _share(F.col("count"), F.sum("count").over(_whole()))).orderBy(
        F.desc("count"), "label"
    )


def unlabelled_rows(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_if(F.col("label_encoded") == -1).alias("label_encoded_neg1"))


def feature_quality(flows: DataFrame) -> DataFrame:
    """NULL, negative and infinite rows per scanned column, with shares."""
    wanted = {}
    for c in SCANNED:
        negative = F.count_if(F.coalesce(F.col(c), F.lit(0)) < 0) if c in NEVER_NEGATIVE else F.lit(0).cast("long")
        infinite = F.count_if(_is_infinite(c)) if c in RATES else F.lit(0).cast("long")
        wanted[c] = F.struct(
            F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("null_rows"),
            negative.alias("negative_rows"), infinite.alias("inf_rows"),
        )
    one = flows.agg(F.count(F.lit(1)).alias("_rows"), *[v.alias(k) for k, v in wanted.items()])
    long = one.select("_rows", F.inline(F.array(*wanted)))
    return long.select(
        "feature", "null_rows", "negative_rows", "inf_rows",
        *[_share(F.col(f"{k}_rows"), F.col("_rows")).alias(f"{k}_share") for k in ("null", "negative", "inf")],
    ).orderBy("feature")


def _cleanup_conditions() -> dict[str, Column]:
    zero = F.col("flow_duration") == 0
    single = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts") == 1
    bytes_inf, packets_inf = _is_infinite("flow_byts_s"), _is_infinite("flow_pkts_s")
    return {
        "any_inf_rate_rows": bytes_inf | packets_inf,
        "flow_bytes_per_s_inf_rows": bytes_inf,
        "flow_pkts_per_s_inf_rows": packets_inf,
        "rows_total": F.lit(True),
        "single_packet_rows": single,
        "zero_duration_rows": zero,
        "zero_duration_single_packet_rows": zero & single,
    }


def cleanup_counters(flows: DataFrame) -> DataFrame:
    made = _cleanup_conditions()
    one = flows.agg(*[F.count_if(c).alias(k) for k, c in made.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("count")) for k in made])
    return one.select("rows_total", F.inline(pairs)).select(
        "metric", "count", _share(F.col("count"), F.col("rows_total")).alias("share")
    ).orderBy("metric")


def cleanup_by_label(labelled: DataFrame) -> DataFrame:
    """Per label: rows lost when rows with infinite rates are dropped."""
    lost = _cleanup_conditions()["any_inf_rate_rows"]
    counts = labelled.groupBy(shown_label("label").alias("label")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(lost).alias("any_inf_rate_rows")
    )
    left = F.col("total_rows") - F.col("any_inf_rate_rows")
    all_left = F.greatest(F.sum(left).over(_whole()), F.lit(1))
    return counts.select(
        "label", "total_rows", "any_inf_rate_rows", left.alias("remaining_rows_after_drop"),
        _share(F.col("any_inf_rate_rows"), F.col("total_rows")).alias("any_inf_rate_share_within_label"),
        (left.cast("double") / all_left.cast("double")).alias("remaining_share_after_drop"),
    ).orderBy(F.desc("total_rows"), "label")


def balance_before_after(labelled: DataFrame, benign: str = "Benign") -> DataFrame:
    calm = F.coalesce(F.col("label") == benign, F.lit(False))
    lost = _cleanup_conditions()["any_inf_rate_rows"]
    counts = labelled.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(calm).alias("benign_total"),
        F.count_if(lost & calm).alias("benign_any_inf"), F.count_if(lost & ~calm).alias("attack_any_inf"),
    )
    c = F.col
    attack = c("rows_total") - c("benign_total")
    after = c("rows_total") - c("benign_any_inf") - c("attack_any_inf")
    attack_after = attack - c("attack_any_inf")
    return counts.select(
        "rows_total", "benign_total", attack.alias("attack_total"),
        _share(attack, c("rows_total")).alias("attack_ratio"),
        after.alias("rows_after_drop"), (c("benign_total") - c("benign_any_inf")).alias("benign_after_drop"),
        attack_after.alias("attack_after_drop"), _share(attack_after, after).alias("attack_ratio_after_drop"),
        "benign_any_inf", "attack_any_inf",
    )


def day_share_pivot(labelled: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Day × label shares; absent combinations are 0."""
    mix = day_label_mix(labelled)
    return mix.groupBy("day").pivot("label", list(labels)).agg(F.sum("day_share")).fillna(0.0)


def class_attempts(labelled: DataFrame) -> DataFrame:
    """Real and attempted rows per collapsed class."""
    tried = F.count_if(is_attempt("label"))
    total = F.count(F.lit(1))
    return labelled.groupBy(collapse_attempt("label").alias("class")).agg(
        total.alias("total"), (total - tried).alias("real"), tried.alias("attempted")
    )


def supported_classes(labelled: DataFrame, min_real: int = 100, count: str = "real") -> DataFrame:
    """Classes with enough rows, counting real rows only or all of them."""
    return class_attempts(labelled).where(F.col(count) >= min_real)


def keep_supported(labelled: DataFrame, min_real: int = 100, count: str = "real") -> DataFrame:
    kept = supported_classes(labelled, min_real, count).select(F.col("class").alias("_class"))
    marked = labelled.withColumn("_class", collapse_attempt("label"))
    return marked.join(kept, "_class", "left_semi").drop("_class")


def class_counts_by_day(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("day", collapse_attempt("label").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def exclusion_by_length(labelled: DataFrame) -> DataFrame:
    """Unmatched flows by packet count of the flow: 1 to 5, 6-10 and above."""
    size = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")
    bucket = F.when(size <= 5, size.cast("string")).when(size <= 10, "6-10").otherwise(">10")
    counts = labelled.groupBy(bucket.alias("packets_in_flow")).agg(
        F.count(F.lit(1)).alias("reconstructed_flows"), F.count_if(~F.col("matched")).alias("excluded_flows")
    )
    whole = F.sum("excluded_flows").over(_whole())
    return counts.withColumn(
        "excluded_pct", _share(F.col("excluded_flows"), F.col("reconstructed_flows")) * 100
    ).withColumn("share_of_all_excluded_pct", _share(F.col("excluded_flows"), whole) * 100)


def registry_coverage(registry: DataFrame, flows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Registry entries per class and how many some flow matches exactly."""
    hit = flows.select(*key).distinct().withColumn("_hit", F.lit(1))
    return registry.join(hit, list(key), "left").groupBy(F.col("label").alias("class")).agg(
        F.count(F.lit(1)).alias("registry_entries"), F.count("_hit").alias("matched_entries"),
        (_share(F.count("_hit"), F.count(F.lit(1))) * 100).alias("coverage_pct"),
    )


def delta_quantiles(pairs: DataFrame) -> DataFrame:
    """Exact linear quantiles of the match distance in seconds."""
    levels = F.array(*[F.lit(q) for q in DELTA_QUANTILES])
    one = pairs.agg(F.percentile(F.abs("delta_us"), DELTA_QUANTILES).alias("_values"))
    return one.select(F.inline(F.arrays_zip(levels.alias("quantile"), F.col("_values").alias("value")))).select(
        F.col("quantile"), (F.col("value") / 1e6).alias("abs_delta_seconds")
    )


def matches_by_label(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    return pairs.join(registry.select("row_ord", "label"), "row_ord").groupBy("label").agg(
        F.count(F.lit(1)).alias("fuzzy_matches")
    )


def protocol_mix(frames: DataFrame, tcp_only: bool = False) -> DataFrame:
    """Transport mix read from byte 9 of each flow's first packet."""
    number = F.conv(F.hex(F.substring("ip_bytes", 10, 1)), 16, 10).cast("int")
    kept = frames.where(number == 6) if tcp_only else frames
    return kept.agg(
        F.count_if(number == 6).alias("tcp"), F.count_if(number == 17).alias("udp"),
        F.count_if(~number.isin(6, 17)).alias("other"),
    )


def split_distribution(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("count"))


# --- claim audit ------------------------------------------------------------------------

ABSENT, ABSENT_IN_WINDOW, BOUNDED_IN_WINDOW = "absent", "absent_in_window", "bounded_in_window"
PORT_EXCLUSIVE, EXTERNAL_ZERO = "port_exclusive", "external_zero"
CLAIM_SCHEMA = (
    "claim_id int, category string, day string, label string, kind string, ip string, "
    "port int, start_us long, end_us long, min_total long, max_count long"
)


def audit_claims(packets: DataFrame, claims: DataFrame, internal_prefix: str = "172.31.") -> DataFrame:
    """Check every claim about an address in one scan of the packets.

    Claims meet packets by day and address (either end), counts are pre-aggregated
    per claim, and claims without any packet keep a count of 0.
    """
    ends = packets.select(
        "day", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port",
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"),
    )
    c = F.col
    in_window = c("start_us").isNull() | c("ts_us").between(c("start_us"), c("end_us"))
    on_port = (c("src_port") == c("port")) | (c("dst_port") == c("port"))
    outside = ((c("src_ip") == c("ip")) & ~is_internal("dst_ip", internal_prefix)) | (
        (c("dst_ip") == c("ip")) & ~is_internal("src_ip", internal_prefix)
    )
    second = F.when(c("kind") == PORT_EXCLUSIVE, on_port).when(c("kind") == EXTERNAL_ZERO, outside)
    counts = (
        ends.join(claims, ["day", "ip"])
        .groupBy("claim_id")
        .agg(F.count_if(in_window).alias("count"), F.count_if(F.coalesce(second, F.lit(False))).alias("secondary"))
    )
    judged = claims.join(counts, "claim_id", "left").withColumns({
        "count": F.coalesce("count", F.lit(0)),
        "secondary": F.when(c("kind").isin(PORT_EXCLUSIVE, EXTERNAL_ZERO), F.coalesce("secondary", F.lit(0))),
    })
    passed = (
        F.when(c("kind").isin(ABSENT, ABSENT_IN_WINDOW), c("count") == 0)
        .when(c("kind") == BOUNDED_IN_WINDOW, c("count") <= c("max_count"))
        .when(c("kind") == PORT_EXCLUSIVE, (c("count") >= c("min_total")) & (c("secondary") == c("count")))
        .when(c("kind") == EXTERNAL_ZERO, (c("count") >= c("min_total")) & (c("secondary") == 0))
    )
    return judged.withColumn("passed", passed)


def audit_verdict(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
    )
