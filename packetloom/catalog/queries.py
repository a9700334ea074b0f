"""The registered queries: one callable per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.catalog.views import ABSENT, load, view
from packetloom.functions import classes as cl
from packetloom.functions import header_bytes as hb
from packetloom.functions import packets as pk
from packetloom.operators import cuts as ct
from packetloom.operators import experiments as ex
from packetloom.operators import flows as fl
from packetloom.operators import forests as fo
from packetloom.operators import labels as lb
from packetloom.operators import metrics as mt
from packetloom.operators import models as md
from packetloom.operators import reports as rp
from packetloom.operators import sampling as sp
from packetloom.operators import selection as sel
from packetloom.operators import tensors as tn
from packetloom.operators.features import FEATURES, PACKET_INPUTS, flow_features, to_raw_flow_table
from packetloom.operators.ordered import stored
from packetloom.plans import builds
from packetloom.session import scratch_path
from packetloom.sources import configs, frames as fr, sinks, tables as tb
from packetloom.sources.store import KEY, PacketStore, open_store, write_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42
CODES = {"Benign": 0, "DoS Hulk": 1, "DoS Slow": 2, "Portscan": 4}


def six_hundred_seconds():
    """A day label: 600 s of the compressed clock."""
    return F.concat(F.lit("day_"), F.expr("flow_start_us div 600000000").cast("string"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------------------

def grouped(spark: SparkSession, sf: str, carry=()) -> DataFrame:
    return fl.group_into_flows(view(spark, sf, "packets"), carry=list(carry))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return flow_features(grouped(spark, sf, PACKET_INPUTS))


STORES: dict[tuple[str, str], str] = {}


def packet_store(spark: SparkSession, sf: str) -> PacketStore:
    """The stored base of the packets and their frames: the first job of a session writes it, later ones read it."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in STORES:
        path = scratch_path(spark, "store")
        write_store(grouped(spark, sf, PACKET_INPUTS), path, _some_absent(byte_frames(spark, sf)), spark.sparkContext.defaultParallelism)
        STORES[at] = path
    return open_store(spark, STORES[at])


def stored_heads(store: PacketStore) -> DataFrame:
    return store.flows().select(
        *fl.FLOW, "flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "protocol", "flow_start_us", "flow_total_packets"
    )


def flow_heads(spark: SparkSession, sf: str) -> DataFrame:
    return fl.first_packets(grouped(spark, sf)).select(
        *fl.FLOW, "flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "protocol", "flow_start_us"
    )


def array_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules in the array form a rule file has."""
    return view(spark, sf, "rule_ips").groupBy("rule_pos", "label", "start_s", "end_s").agg(
        F.collect_set("attacker_ip").alias("attacker_ips"), F.collect_set("victim_ip").alias("victim_ips"),
        F.max("victim_port").alias("_port"),
    ).select(
        "rule_pos", "label", "attacker_ips", "victim_ips",
        F.when(F.col("_port") >= 0, F.array(F.col("_port").cast("int"))).alias("victim_ports"),
        (F.col("start_s").cast("long") * 1_000_000).alias("start_us"), (F.col("end_s").cast("long") * 1_000_000).alias("end_us"),
    )


def registry_labelled(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = flow_heads(spark, sf) if rows is None else rows
    return lb.label_from_registry(rows, view(spark, sf, "registry").drop("capture_file"), "first")


def rule_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Features, rule labels and a day made of 600 s of the compressed clock."""
    labelled = lb.label_by_rules(features(spark, sf), array_rules(spark, sf), "first", codes=CODES)
    return labelled.withColumn("day", six_hundred_seconds())


def byte_frames(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "frames").select(
        "event_id", "capture_file", "capture_packet_index", F.unhex("ip_hex").alias("ip_bytes")
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a class made of language and quality label."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = load(spark, sf, "labels").select("doc_id", "quality")
    joined = docs.join(marks, "doc_id", "left")
    return joined.select("doc_id", F.col("source").alias("day"), "n_chars",
                         F.when(F.coalesce("quality", F.lit(0)) == 1, "Benign").otherwise(F.col("lang")).alias("label"))


# --- scalar functions ------------------------------------------------------------------------

@query
def packet_fields_unified(spark, sf):
    return tb.unify_packet_fields(view(spark, sf, "packet_fields"))


@query
def payload_length(spark, sf):
    return tb.unify_packet_fields(view(spark, sf, "packet_fields")).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("payload_bytes"), F.max("payload_len").alias("largest"))


@query
def packet_ordinals(spark, sf):
    rows = view(spark, sf, "packets").drop("capture_packet_index")
    return tb.number_packets(rows, ["event_id"]).select("event_id", "capture_file", "capture_packet_index")


@query
def canonical_key(spark, sf):
    keyed = fl.with_canonical_key(view(spark, sf, "packets"))
    return keyed.groupBy("capture_file", "ip_a", "ip_b", "port_a", "port_b", "protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if("from_b").alias("from_b"))


@query
def endpoint_keys(spark, sf):
    key = pk.endpoint_key("protocol", "src_ip", "src_port", "dst_ip", "dst_port")
    return view(spark, sf, "packets").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("packets"))


@query
def micros_half_even(spark, sf):
    rows = load(spark, sf, "events").select("event_id", (F.col("event_id") / 8_000_000.0).alias("seconds"))
    return rows.select("event_id", pk.seconds_to_micros("seconds").alias("us"))


@query
def clock_windows(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("d"),
                                              F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    clock = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":"),
                     F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    day = F.concat(F.lit("Someday-"), "d")
    return orders.select(
        "o_orderkey", pk.est_clock_to_micros(day, clock).alias("est_us"),
        pk.utc_clock_to_micros("iso", F.concat(clock, F.lit(":07"))).alias("utc_us"),
        F.date_format(pk.day_date(day), "yyyy-MM-dd").alias("day_date"))


@query
def day_names(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "Thuesday-20-02-2018").when(F.col("event_id") % 3 == 1, "Tuesday-20-02-2018") \
        .otherwise("Friday-WorkingHours")
    return load(spark, sf, "events").select("event_id", raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("rows")).select(
        "raw", cl.canonical_day("raw").alias("canonical"), cl.rule_day("raw").alias("rules"),
        cl.weekday_date("raw").alias("date"), "rows")


@query
def capture_host_names(spark, sf):
    name = F.concat(F.lit("UCAP"), ((F.col("user_id") * 7) % 400).cast("string"), F.lit(".31.0."),
                    (F.col("user_id") % 300).cast("string"))
    rows = load(spark, sf, "events").select(name.alias("capture_file")).groupBy("capture_file").agg(F.count(F.lit(1)).alias("rows"))
    host = pk.capture_host("capture_file")
    return rows.select("capture_file", host.alias("host"), pk.ipv4_number(host).alias("host_number"), "rows")


@query
def attempts_collapsed(spark, sf):
    return view(spark, sf, "registry").groupBy("label").agg(F.count(F.lit(1)).alias("rows")).select(
        "label", cl.collapse_attempt("label").alias("at_end"), cl.collapse_attempt("label", anywhere=True).alias("anywhere"),
        cl.is_attempt("label").alias("attempt"), "rows")


@query
def class_groups(spark, sf):
    names = sorted(cl.GROUP_OF)
    folder = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names)).cast("int") + 1)
    rows = load(spark, sf, "events").select(folder.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("class", cl.class_group("class").alias("group"), cl.is_benign_folder("class").alias("benign"), "rows")


@query
def label_codes(spark, sf):
    rows = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("seen"))
    codes = {"view": 0, "click": 1, "purchase": 2}
    ids = cl.label_index(rows, "event_type", first="view").select(F.col("class").alias("event_type"), F.col("class_id").alias("sorted_id"))
    seen = cl.label_index(rows, "event_type", "first_seen", by="seen").select(F.col("class").alias("event_type"), F.col("class_id").alias("seen_id"))
    return rows.select("event_type", "rows", cl.encode_label("event_type", codes).alias("code"),
                       cl.encode_label("event_type", codes, 0).alias("code_or_normal")).join(ids, "event_type").join(seen, "event_type")


@query
def flag_tests(spark, sf):
    return view(spark, sf, "packets").groupBy("tcp_flags").agg(
        *[F.count_if(pk.has_flag("tcp_flags", n)).alias(n) for n in pk.TCP_FLAG_BITS])


@query
def rates_and_ratios(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("l_linenumber")) - F.count(F.lit(1))).alias("dur"),
        F.count_if(F.col("l_returnflag") == "A").alias("fwd"))
    return rows.select("l_orderkey", pk.rate_per_second("n", "dur").alias("rate"), pk.rate_per_second("fwd", "dur").alias("fwd_rate"),
                       pk.ratio_or_zero(F.col("n") - F.col("fwd"), "fwd").alias("ratio"))


@query
def finite_policies(spark, sf):
    rows = features(spark, sf).select(*fl.FLOW, "flow_byts_s", "flow_pkts_s")
    dropped = pk.apply_finite_policy(rows, ["flow_byts_s", "flow_pkts_s"], "drop").withColumn("policy", F.lit("drop"))
    zeroed = pk.apply_finite_policy(rows, ["flow_byts_s", "flow_pkts_s"], "zero").withColumn("policy", F.lit("zero"))
    return dropped.unionByName(zeroed)


@query
def flow_keys_and_offsets(spark, sf):
    rows = load(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("flow_id"), F.count(F.lit(1)).alias("rows"))
    return rows.select("event_type", pk.flow_key("event_type", "flow_id").alias("flow_key"),
                       pk.hashed_offset("event_type").alias("offset"), "rows")


@query
def endpoint_predicates(spark, sf):
    p = view(spark, sf, "packets")
    window = pk.inside_window("ts_us", 1_704_500_000_000, 1_705_000_000_000)
    return p.groupBy("capture_file").agg(
        F.count_if(pk.on_either_side("172.31.0.1")).alias("with_host"),
        F.count_if(pk.on_either_side("172.31.0.1") & window).alias("in_window"),
        F.count_if(pk.port_on("src", 443)).alias("src_443"), F.count_if(pk.port_on("dst", 443)).alias("dst_443"),
        F.count_if(pk.port_on("either", 443)).alias("any_443"), F.count_if(pk.is_internal("src_ip")).alias("internal_src"))


@query
def protocol_numbers(spark, sf):
    return view(spark, sf, "gt").groupBy("proto").agg(F.count(F.lit(1)).alias("rows")).select(
        "proto", pk.protocol_number("proto").alias("number"), "rows")


# --- flows --------------------------------------------------------------------------------------

FLOW_COLUMNS = ["capture_file", "capture_packet_index", "flow_id", "packet_index", "direction", "src_ip", "dst_ip", "src_port",
                "dst_port", "flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "flow_start_us"]


@query
def flow_grouping(spark, sf):
    return grouped(spark, sf).select(*FLOW_COLUMNS)


@query
def flow_direction(spark, sf):
    return grouped(spark, sf).groupBy("capture_file", "flow_src_ip", "flow_dst_ip").agg(
        F.count_if(F.col("direction") == 1).alias("forward"), F.count_if(F.col("direction") == 0).alias("backward"))


@query
def flow_total_packets(spark, sf):
    return fl.first_packets(grouped(spark, sf)).select(*fl.FLOW, "flow_total_packets")


@query
def flow_numbers(spark, sf):
    return fl.dense_flow_numbers(fl.first_packets(grouped(spark, sf)).select(*fl.FLOW))


@query
def grouping_summary(spark, sf):
    return fl.grouping_summary(grouped(spark, sf))


def _dup_grouped(spark, sf):
    packets = view(spark, sf, "packets_dup")
    return fl.group_into_flows(packets, carry=[]), fl.capture_hosts(packets)


@query
def cross_capture_dedup(spark, sf):
    rows, hosts = _dup_grouped(spark, sf)
    return fl.drop_cross_capture_duplicates(rows, hosts).select("capture_file", "capture_packet_index", "flow_id", "packet_index")


@query
def cross_capture_drops(spark, sf):
    return fl.cross_capture_drops(*_dup_grouped(spark, sf))


# --- cuts ------------------------------------------------------------------------------------------

def _cut(spark, sf, cut):
    return ct.apply_cut(grouped(spark, sf), cut).select(*fl.FLOW, "capture_packet_index", "packet_index")


@query
def cut_packet_pct(spark, sf):
    return _cut(spark, sf, ct.Cut(ct.PACKET_SHARE, 0.25))


@query
def cut_time_abs(spark, sf):
    return _cut(spark, sf, ct.Cut(ct.SECONDS, 3.0))


@query
def cut_packet_abs(spark, sf):
    return _cut(spark, sf, ct.Cut(ct.PACKET_COUNT, 3))


@query
def cut_grid(spark, sf):
    return ct.cut_grid(grouped(spark, sf)).groupBy("cut").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.col("packet_index") == 0).alias("flows"), F.sum("packet_index").alias("positions"))


@query
def first_packets_for_bytes(spark, sf):
    return ct.first_packets_for_bytes(grouped(spark, sf), 5)


# --- features -------------------------------------------------------------------------------------------

def _feature_part(*names):
    return lambda spark, sf: features(spark, sf).select(*fl.FLOW, *names)


FEATURE_PARTS = {
    "flow_features_identity": ["flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "protocol", "flow_start_us",
                               "flow_end_us", "dst_port", "flow_duration"],
    "flow_features_counts": ["tot_fwd_pkts", "tot_bwd_pkts", "fwd_act_data_pkts", "down_up_ratio", "fwd_seg_size_min",
                             "init_fwd_win_byts", "init_bwd_win_byts"],
    "flow_features_lengths": [c for c in FEATURES if "len" in c or c == "pkt_size_avg"],
    "flow_features_iat": [c for c in FEATURES if "_iat_" in c],
    "flow_features_active_idle": [c for c in FEATURES if c.startswith(("active", "idle"))],
    "flow_features_flags": [c for c in FEATURES if "flag" in c],
    "flow_features_rates": [c for c in FEATURES if c.endswith("_s")],
}
for _name, _columns in FEATURE_PARTS.items():
    QUERIES[_name] = _feature_part(*_columns)


@query
def flow_features_full(spark, sf):
    return features(spark, sf)


@query
def early_flow_features(spark, sf):
    """The flagship: packets to flows, first three packets, all features."""
    return flow_features(ct.apply_cut(grouped(spark, sf, PACKET_INPUTS), ct.Cut(ct.PACKET_COUNT, 3)))


@query
def feature_cut_grid(spark, sf):
    cuts = [ct.Cut(ct.PACKET_COUNT, 3), ct.Cut(ct.SECONDS, 1.0), ct.Cut(ct.PACKET_SHARE, 0.5), ct.Cut(ct.PACKET_SHARE, 1.0)]
    rows = flow_features(ct.cut_grid(grouped(spark, sf, PACKET_INPUTS), cuts), by=["cut"])
    return rows.select("cut", *fl.FLOW, "tot_fwd_pkts", "tot_bwd_pkts", "flow_duration", "flow_iat_mean", "pkt_len_std", "active_max")


@query
def raw_flow_table(spark, sf):
    return to_raw_flow_table(features(spark, sf), "Tuesday-20-02-2018")


# --- labels --------------------------------------------------------------------------------------------

def _rules(spark, sf, policy):
    out = lb.label_by_rules(flow_heads(spark, sf), array_rules(spark, sf), policy, codes=CODES)
    return out.select(*fl.FLOW, "label", "label_encoded")


@query
def label_rules_first(spark, sf):
    return _rules(spark, sf, "first")


@query
def label_rules_narrowest(spark, sf):
    return _rules(spark, sf, "narrowest")


@query
def label_attach_default(spark, sf):
    labels = lb.label_by_rules(flow_heads(spark, sf), array_rules(spark, sf), codes=CODES).where("label <> 'Benign'")
    calm = lb.label_attack_free(flow_heads(spark, sf).where("protocol = 1"))
    both = lb.attach_labels(flow_heads(spark, sf), labels.select(*fl.FLOW, "label", "label_encoded"))
    picked = both.where("protocol <> 1").unionByName(calm)
    return picked.select(*fl.FLOW, "label", "label_encoded")


@query
def label_registry_exact(spark, sf):
    return lb.to_label_registry(registry_labelled(spark, sf)).select(*fl.FLOW, "flow_start_us", "label", "attempted_category", "matched")


def _dedup(spark, sf, keep):
    return lb.dedup_registry(view(spark, sf, "registry_repeated"), keep).select("flow_src_ip", "flow_start_us", "row_ord", "label", "attempted_category")


@query
def registry_dedup_first(spark, sf):
    return _dedup(spark, sf, "first")


@query
def registry_dedup_last(spark, sf):
    return _dedup(spark, sf, "last")


@query
def registry_on_cut(spark, sf):
    registry = lb.to_label_registry(registry_labelled(spark, sf)).where("matched")
    cut = flow_features(ct.apply_cut(grouped(spark, sf, PACKET_INPUTS), ct.Cut(ct.PACKET_COUNT, 3)))
    return lb.attach_registry(cut, registry).select(*fl.FLOW, "tot_fwd_pkts", "label", "attempted_category", "matched")


@query
def ground_truth_index(spark, sf):
    return lb.ground_truth_index(lb.prepare_ground_truth(view(spark, sf, "gt")))


@query
def label_nearest(spark, sf):
    truth = lb.prepare_ground_truth(view(spark, sf, "gt"))
    out = lb.label_by_nearest(flow_heads(spark, sf), truth, cl.GROUND_TRUTH_CODES)
    return out.select(*fl.FLOW, "label", "label_encoded", "matched", "match_level")


def _fuzzy(spark, sf):
    flows = registry_labelled(spark, sf)
    registry = lb.dedup_registry(view(spark, sf, "registry").drop("capture_file"))
    return flows, registry, lb.fuzzy_match(flows, registry)


@query
def fuzzy_one_to_one(spark, sf):
    return _fuzzy(spark, sf)[2]


@query
def fuzzy_apply(spark, sf):
    flows, registry, pairs = _fuzzy(spark, sf)
    return lb.apply_matches(flows, pairs, registry).select(*fl.FLOW, "label", "attempted_category", "matched")


@query
def registry_uncovered(spark, sf):
    registry = view(spark, sf, "registry").drop("capture_file")
    return lb.uncovered_registry(registry, flow_heads(spark, sf)).select("row_ord", "label", "flow_start_us")


@query
def aligned_fetch(spark, sf):
    wanted = registry_labelled(spark, sf).where("matched and label = 'Portscan'")
    return lb.align_features(features(spark, sf), wanted).select(*fl.FLOW, "tot_fwd_pkts", "flow_duration")


@query
def anchor_selection(spark, sf):
    matched = registry_labelled(spark, sf).where("matched")
    earlier = flow_heads(spark, sf).where("flow_id % 2 = 0")
    return lb.anchor_report(matched, earlier)


@query
def packets_labelled(spark, sf):
    labels = registry_labelled(spark, sf).where("matched")
    return lb.label_packets(grouped(spark, sf), labels).groupBy("label").agg(F.count(F.lit(1)).alias("packets"))


def _some_absent(frames):
    return frames.withColumn("capture_packet_index", F.expr(ABSENT))


@query
def bytes_attached(spark, sf):
    some = _some_absent(byte_frames(spark, sf))
    first = ct.first_packets_for_bytes(grouped(spark, sf), 3)
    return lb.attach_bytes(first, some).select(
        *fl.FLOW, "pkt_order", F.col("ip_bytes").isNotNull().alias("found"), F.octet_length("ip_bytes").alias("bytes"))


# --- reports -------------------------------------------------------------------------------------------

@query
def coverage(spark, sf):
    return rp.coverage(registry_labelled(spark, sf))


@query
def label_counts(spark, sf):
    return rp.label_counts(registry_labelled(spark, sf))


@query
def label_summary(spark, sf):
    return rp.label_summary(lb.label_by_rules(flow_heads(spark, sf), array_rules(spark, sf)))


@query
def day_label_mix(spark, sf):
    return rp.day_label_mix(rule_labelled(spark, sf))


@query
def day_summary(spark, sf):
    return rp.day_summary(rule_labelled(spark, sf))


@query
def global_label_shares(spark, sf):
    return rp.global_label_shares(rule_labelled(spark, sf))


@query
def unlabelled_rows(spark, sf):
    return rp.unlabelled_rows(rule_labelled(spark, sf))


@query
def feature_quality(spark, sf):
    return rp.feature_quality(features(spark, sf))


@query
def cleanup_counters(spark, sf):
    return rp.cleanup_counters(features(spark, sf))


@query
def label_cleanup_impact(spark, sf):
    return rp.cleanup_by_label(rule_labelled(spark, sf))


@query
def balance_before_after(spark, sf):
    return rp.balance_before_after(rule_labelled(spark, sf))


@query
def day_share_pivot(spark, sf):
    return rp.day_share_pivot(rule_labelled(spark, sf), ["Benign", "Botnet", "DoS Hulk", "Portscan"])


CLAIMS = [
    (0, "fixture", "all", "always port 80 or 443", "port_exclusive", "172.31.0.1", 443, None, None, 100, None),
    (1, "fixture", "all", "absent", "absent", "10.9.9.9", None, None, None, None, None),
    (2, "fixture", "all", "absent but there", "absent", "172.31.0.2", None, None, None, None, None),
    (3, "fixture", "all", "quiet window", "absent_in_window", "172.31.0.3", None, 1, 2, None, None),
    (4, "fixture", "all", "bounded", "bounded_in_window", "172.31.0.3", None, 1_704_500_000_000, 1_704_600_000_000, None, 1_000_000),
    (5, "fixture", "all", "no outside", "external_zero", "172.31.0.4", None, None, None, 1, None),
    (6, "fixture", "all", "icmp port", "port_exclusive", "10.0.4.4", 0, None, None, 1, None),
]


@query
def claim_audit(spark, sf):
    packets = view(spark, sf, "packets").withColumn("day", F.lit("all"))
    claims = spark.createDataFrame(CLAIMS, rp.CLAIM_SCHEMA)
    return rp.audit_claims(packets, claims).select("claim_id", "kind", "ip", "count", "secondary", "passed")


@query
def claim_verdict(spark, sf):
    packets = view(spark, sf, "packets").withColumn("day", F.lit("all"))
    return rp.audit_verdict(rp.audit_claims(packets, spark.createDataFrame(CLAIMS, rp.CLAIM_SCHEMA)))


@query
def class_real_attempted(spark, sf):
    return rp.class_attempts(registry_labelled(spark, sf).where("matched"))


@query
def min_support(spark, sf):
    matched = registry_labelled(spark, sf).where("matched")
    return rp.keep_supported(matched, 300).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query
def class_counts_by_day(spark, sf):
    rows = registry_labelled(spark, sf).where("matched").withColumn("day", six_hundred_seconds())
    return rp.class_counts_by_day(rows)


@query
def exclusion_by_length(spark, sf):
    return rp.exclusion_by_length(registry_labelled(spark, sf, features(spark, sf)))


@query
def registry_coverage(spark, sf):
    return rp.registry_coverage(view(spark, sf, "registry"), flow_heads(spark, sf), lb.KEY6)


@query
def delta_quantiles(spark, sf):
    return rp.delta_quantiles(_fuzzy(spark, sf)[2])


@query
def matches_by_label(spark, sf):
    _, registry, pairs = _fuzzy(spark, sf)
    return rp.matches_by_label(pairs, registry)


@query
def protocol_mix(spark, sf):
    return rp.protocol_mix(byte_frames(spark, sf))


# --- sampling ----------------------------------------------------------------------------------------

@query
def class_cap(spark, sf):
    return sp.cap_per_class(labelled_documents(spark, sf), "label", ["doc_id"], SEED, {"en": 100, "Benign": 50}).select("doc_id", "label")


@query
def day_class_cap(spark, sf):
    rows = labelled_documents(spark, sf).where(F.col("label") != "de")
    return sp.cap_per_class(rows, "label", ["doc_id"], SEED, {"Benign": 7}, 20, ["day"]).select("doc_id", "day", "label")


@query
def assembled(spark, sf):
    truth = lb.prepare_ground_truth(view(spark, sf, "gt"))
    flows = lb.label_by_nearest(flow_heads(spark, sf), truth, cl.GROUND_TRUTH_CODES)
    return builds.assemble(flows, SEED, {"normal": 500, "ddos": 200, "scanning": 100}).select(*fl.FLOW, "label")


@query
def benign_undersample(spark, sf):
    return sp.undersample_benign(rule_labelled(spark, sf), "label", fl.FLOW, SEED).select(*fl.FLOW, "label")


@query
def seeded_shuffle(spark, sf):
    rows = labelled_documents(spark, sf)
    return sp.shuffled(rows, ["doc_id"], SEED).select("doc_id", sp.seeded_order(["doc_id"], SEED).alias("position"))


@query
def stratified_split(spark, sf):
    return sp.train_test_split(labelled_documents(spark, sf), "label", ["doc_id"], SEED).select("doc_id", "label", "split")


@query
def three_way_split(spark, sf):
    return sp.three_way_split(labelled_documents(spark, sf), "label", ["doc_id"], SEED).select("doc_id", "label", "split")


@query
def within_day_split(spark, sf):
    return sp.share_split(labelled_documents(spark, sf), "label", ["doc_id"], SEED, within=["day"]).select("doc_id", "day", "label", "split")


@query
def task_split(spark, sf):
    rows = labelled_documents(spark, sf).where(~F.col("label").isin("fr"))
    split = sp.share_split(rows, "label", ["doc_id"], SEED)
    return rp.split_distribution(split)


@query
def stratified_sample(spark, sf):
    return sp.stratified_sample(labelled_documents(spark, sf), "label", ["doc_id"], SEED, 300).select("doc_id", "label")


@query
def class_weights(spark, sf):
    return sp.class_weights(labelled_documents(spark, sf), "label")


@query
def sample_weights(spark, sf):
    return sp.with_sample_weight(labelled_documents(spark, sf), "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight"))


@query
def split_ledger(spark, sf):
    split = sp.train_test_split(labelled_documents(spark, sf), "label", ["doc_id"], SEED)
    return sp.split_ledger(split, ["doc_id"], "label")


@query
def flows_of_byte_table(spark, sf):
    rows = ct.first_packets_for_bytes(grouped(spark, sf), 5)
    return sp.flows_of_bytes(rows, fl.FLOW).select(*fl.FLOW, "capture_packet_index", "pkt_order")


# --- feature selection ------------------------------------------------------------------------------------

@query
def feature_selection(spark, sf):
    rows = features(spark, sf)
    return sel.selection_report(rows, sel.feature_columns(rows))


# --- bytes -----------------------------------------------------------------------------------------------

def _masked(spark, sf, expr):
    return byte_frames(spark, sf).select("event_id", F.hex(expr).alias("masked"))


@query
def mask_basic(spark, sf):
    return _masked(spark, sf, hb.mask_addresses(F.col("ip_bytes")))


@query
def mask_strict(spark, sf):
    return _masked(spark, sf, hb.mask_strict(F.col("ip_bytes")))


@query
def fixed_length(spark, sf):
    return byte_frames(spark, sf).select("event_id", F.hex(hb.to_fixed_length(F.col("ip_bytes"))).alias("raw_bytes"),
                                         F.octet_length("ip_bytes").alias("real_length"))


def _stored(spark, sf):
    return byte_frames(spark, sf).select("event_id", hb.to_fixed_length(hb.mask_addresses(F.col("ip_bytes"))).alias("raw_bytes"))


def _derived(variant):
    return lambda spark, sf: builds.derive_bytes(_stored(spark, sf), variant).select("event_id", F.hex("raw_bytes").alias("masked"))


for _variant in ("strict", "strict_csum", "csum_fix", *[f"occ_top{k}" for k in (1, 2, 3, 4, 5)]):
    QUERIES[f"derive_{_variant}"] = _derived(_variant)


@query
def ipv4_checksum(spark, sf):
    return byte_frames(spark, sf).select("event_id", hb.ipv4_checksum(F.col("ip_bytes")).alias("checksum"))


@query
def mask_statistics(spark, sf):
    raw = F.col("raw_bytes")
    base = hb.header_length(raw)
    return tn.mask_stats(_stored(spark, sf), raw, hb.derive_ladder(raw, 2), hb.has_sane_header(raw),
                         hb.protocol_byte(raw) == 6, hb.tcp_header_length(raw, base).between(21, 60))


@query
def link_stripped(spark, sf):
    ip = F.col("ip_bytes")
    kind = F.col("event_id") % 4
    macs = F.unhex(F.lit("0A0B0C0D0E0F1A1B1C1D1E1F"))
    frame = (
        F.when(kind == 0, F.concat(macs, F.unhex(F.lit("0800")), ip)).when(kind == 1, F.concat(macs, F.unhex(F.lit("810000070800")), ip))
        .when(kind == 2, F.concat(F.unhex(F.lit("00000001000600112233445500000800")), ip)).otherwise(F.concat(macs, F.unhex(F.lit("86DD")), ip))
    )
    link = F.when(kind == 2, hb.LINUX_COOKED).otherwise(hb.ETHERNET)
    return byte_frames(spark, sf).select("event_id", F.hex(hb.strip_link(frame, link)).alias("packet"))


def _chosen(spark, sf):
    return registry_labelled(spark, sf, stored_heads(packet_store(spark, sf))).where("matched")


def _byte_rows(spark, sf, packets=5):
    return builds.extract_stored_bytes(packet_store(spark, sf), _chosen(spark, sf), packets)


@query
def store_summary(spark, sf):
    """What the stored base holds, per capture and slice."""
    return packet_store(spark, sf).packets.groupBy("capture_file", "slice").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.col("packet_index") == 0).alias("flows"),
        F.count("ip_bytes").alias("frames"), F.sum(F.octet_length("ip_bytes").cast("long")).alias("frame_bytes"))


def _packed(spark, sf):
    flows = tn.supported_flows(stored(_chosen(spark, sf), "chosen"), 100)
    return tn.pack_flows(builds.extract_stored_bytes(packet_store(spark, sf), flows), 5, 256, None, key=KEY)


@query
def byte_extraction(spark, sf):
    return _byte_rows(spark, sf).select(*fl.FLOW, "pkt_order", F.md5("raw_bytes").alias("digest"), "real_length", "found", "label")


@query
def tensor_pack(spark, sf):
    packed = _packed(spark, sf)
    return packed.select(*fl.FLOW, "y", *[F.hex(F.get("packets", F.lit(i))).alias(f"packet_{i}") for i in range(5)],
                         *[F.get("padding", F.lit(i)).alias(f"padding_{i}") for i in range(5)])


@query
def byte_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    packed = tn.byte_features(_packed(spark, sf))
    values = vector_to_array("features")
    return packed.select(*fl.FLOW, F.size(values).alias("width"),
                         F.rint(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * 255)).cast("long").alias("byte_sum"))


@query
def time_encoding(spark, sf):
    packed = _packed(spark, sf).withColumn("code", tn.time_encoding("times", "padding", 4))
    return packed.select(*fl.FLOW, *[
        F.round(F.get(F.get("code", F.lit(i)), F.lit(j)), 4).alias(f"c{i}{j}") for i in range(5) for j in range(4)])


# --- scores ----------------------------------------------------------------------------------------------

@query
def confusion(spark, sf):
    counts = mt.confusion_counts(view(spark, sf, "predictions"))
    classes = counts.select(F.col("y_true").alias("class")).union(counts.select("y_pred")).distinct()
    return mt.confusion_long(counts, classes)


@query
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(mt.confusion_counts(view(spark, sf, "predictions")), ["click", "error", "purchase", "signup", "unknown", "view"])


@query
def per_class_metrics(spark, sf):
    return mt.per_class(mt.confusion_counts(view(spark, sf, "predictions")))


@query
def f1_summary(spark, sf):
    return _round(mt.overall(mt.confusion_counts(view(spark, sf, "predictions"))), "macro_f1", "weighted_f1")


def _two_models(spark, sf):
    p = view(spark, sf, "predictions")
    other = p.withColumn("y_pred", F.when(F.col("row_id") % 3 == 0, "view").otherwise(F.col("y_true")))
    return p.withColumn("model", F.lit("one")).unionByName(other.withColumn("model", F.lit("two")))


@query
def wide_f1(spark, sf):
    scores = mt.per_class(mt.confusion_counts(_two_models(spark, sf), ["model"]), ["model"])
    return mt.wide_f1(scores, ["one", "two"])


@query
def model_summary(spark, sf):
    return _round(md.model_summary(_two_models(spark, sf)), "macro_f1", "weighted_f1")


def _history(spark, sf):
    return load(spark, sf, "lineitem").where("l_linenumber <= 7").groupBy("l_returnflag", "l_linenumber").agg(
        F.sum((F.round(F.col("l_tax") * 100)).cast("long")).alias("_s"), F.count(F.lit(1)).alias("_n")
    ).select("l_returnflag", F.col("l_linenumber").alias("epoch"), (F.col("_s").cast("double") / F.col("_n")).alias("val_macro_f1"))


@query
def best_epoch(spark, sf):
    return mt.best_epoch(_history(spark, sf), 2, ["l_returnflag"])


def _model_rows(spark, sf):
    labelled = registry_labelled(spark, sf, features(spark, sf)).where("matched")
    named = F.when(F.col("protocol") == 6, cl.collapse_attempt("label")).otherwise(F.concat(F.lit("proto_"), F.col("protocol").cast("string")))
    return stored(labelled.withColumn("label", named), "model_rows")


@query
def forest_scores(spark, sf):
    built = builds.train_forest(_model_rows(spark, sf), SEED, 50, trees=100, depth=30)
    return built.classes


@query
def forest_importances(spark, sf):
    built = builds.train_forest(_model_rows(spark, sf), SEED, 50, trees=100, depth=30, extra_drop=sel.INITIAL_WINDOW)
    return built.importances


def _classifier(name):
    """A model at full rounds; boosting and the perceptron end by a validation share that is not trained on."""
    def run(spark, sf):
        rows = _model_rows(spark, sf)
        columns = sel.feature_columns(rows)
        clean = pk.apply_finite_policy(rows.select(*fl.FLOW, "label", *columns), columns, "zero")
        split = stored((sp.three_way_split if name in ("xgb", "mlp") else sp.train_test_split)(clean, "label", fl.FLOW, SEED), "split")
        train, test = split.where("split = 'train'"), split.where("split = 'test'")
        if name == "mlp":
            model, _ = md.train_on(train, split.where(F.col("split") == sp.VALID), columns, SEED)
            stacked = md.predict(model, test).select("y_true", "y_pred").withColumn("model", F.lit(name))
        elif name == "xgb":
            seen = split.where("split <> 'test'").withColumn("held_out", F.col("split") == sp.VALID)
            stacked = md.run_models([name], seen, test, columns, SEED, options={name: {"held_out": "held_out"}})
        else:
            stacked = md.run_models([name], train, test, columns, SEED)
        return md.model_summary(stacked)
    return run


for _name in ("xgb", "gnb", "logreg", "svm", "mlp"):
    QUERIES[f"classifier_{_name}"] = _classifier(_name)


@query
def occlusion_sweep(spark, sf):
    packed = stored(_packed(spark, sf).withColumnRenamed("y", "label").select(*fl.FLOW, "label", "packets"), "packed")
    split = stored(tn.joined_bytes(sp.train_test_split(packed, "label", fl.FLOW, SEED)).drop("packets"), "split")
    forest = fo.grow(split.where("split = 'train'"), fl.FLOW, "label", "bytes", SEED, trees=100, depth=30)
    scored = fo.predict_zeroed(forest, split.where("split = 'test'"), fl.FLOW, "label", tn.region_places())
    drops, _ = tn.drops_from_counts(stored(mt.confusion_counts(scored, ["region"]), "counts"))
    return drops


@query
def occlusion_drops(spark, sf):
    """The sweep's arithmetic on given predictions: regions stand for event types."""
    p = view(spark, sf, "predictions")
    region = F.element_at(F.array(*[F.lit(r) for r in ("none", "ip_ttl", "tcp_window", "tcp_options")]), (F.col("row_id") % 4).cast("int") + 1)
    counts = mt.confusion_counts(p.withColumn("region", region), ["region"])
    return _round(tn.drops_from_counts(counts)[0], "macro_f1_occluded", "delta_macro_f1", "drop")


# --- experiments ---------------------------------------------------------------------------------------

def seeds_as_columns():
    return [F.try_element_at("seeds", F.lit(str(s))).alias(f"seed_{s}") for s in range(1, 6)]


def _round(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query
def seed_aggregate(spark, sf):
    out = ex.seed_aggregate(view(spark, sf, "runs"))
    return _round(out.select("dataset", "config", "n", "mean", "std", *seeds_as_columns()), "mean", "std")


@query
def first_available(spark, sf):
    runs = view(spark, sf, "runs").withColumn("priority", F.lit(1))
    better = runs.where("seed % 2 = 0").withColumns({"priority": F.lit(0), "macro_f1": F.when(F.col("seed") == 2, F.col("macro_f1") + 1)})
    return ex.first_available(runs.unionByName(better))


@query
def class_aggregate(spark, sf):
    out = ex.class_aggregate(view(spark, sf, "class_scores"))
    return _round(out.select("dataset", "config", "class", "n", "mean", "std"), "mean", "std")


@query
def occlusion_aggregate(spark, sf):
    out = ex.occlusion_aggregate(view(spark, sf, "occlusion_runs"))
    return _round(out.select("dataset", "region", "n", "mean", "std"), "mean", "std")


@query
def occlusion_baseline(spark, sf):
    out = ex.occlusion_baseline(view(spark, sf, "occlusion_runs"))
    return _round(out.select("dataset", "n", "mean", "std"), "mean", "std")


@query
def votes(spark, sf):
    return ex.region_votes(view(spark, sf, "occlusion_runs"))


NAMES = ("north", "south", "west")


@query
def paired_delta(spark, sf):
    out = ex.paired_difference(view(spark, sf, "runs"), ex.window_pairs(spark, NAMES))
    return _round(out, "mean_points", "std_points")


@query
def probe_delta(spark, sf):
    runs = view(spark, sf, "runs").withColumn("config", F.replace("config", F.lit("packet_abs_3_noInitWin"), F.lit("pkt3_strict"))) \
        .withColumn("config", F.replace("config", F.lit("packet_abs_3"), F.lit("pkt3_basic")))
    return _round(ex.paired_difference(runs, ex.probe_pairs(spark, NAMES)), "mean_points", "std_points")


@query
def completeness(spark, sf):
    return ex.incomplete_runs(view(spark, sf, "runs"))


@query
def grid_missing_inputs(spark, sf):
    """Grid inputs without an artifact; the listing is derived from the runs."""
    present = view(spark, sf, "runs").select("dataset", F.concat(F.regexp_replace("config", "^(rf|transformer)_|_noInitWin$", ""), F.lit("/raw_flow")).alias("input")).distinct()
    named = F.when(F.col("dataset") == "cic_ids2017", "north").when(F.col("dataset") == "toniot", "south").otherwise(F.col("dataset"))
    return ex.missing_inputs(ex.forest_grid(spark).withColumn("dataset", named), present)


@query
def table_pivot(spark, sf):
    agg = ex.seed_aggregate(view(spark, sf, "runs"))
    columns = ["rf_pct_100", "rf_packet_abs_3", "rf_packet_abs_1"]
    rows = agg.select("dataset").distinct()
    return _round(ex.result_table(agg, rows, columns, ["dataset"]), *columns)


@query
def window_table(spark, sf):
    out = ex.window_table(view(spark, sf, "runs"), ex.window_pairs(spark, NAMES))
    return _round(out, "mean_a", "std_a", "mean_b", "std_b", "loss_points", "loss_std")


@query
def occlusion_table(spark, sf):
    regions = ["tcp_options", "ip_checksum", "tcp_window", "ip_ttl"]
    return _round(ex.occlusion_table(view(spark, sf, "occlusion_runs"), regions), *regions)


@query
def packet_series(spark, sf):
    return _round(ex.packet_series(ex.seed_aggregate(view(spark, sf, "runs"))), "mean", "std")


@query
def top_regions(spark, sf):
    return _round(ex.top_regions(ex.occlusion_aggregate(view(spark, sf, "occlusion_runs"))), "mean", "std")


@query
def missing_keys(spark, sf):
    runs = view(spark, sf, "runs")
    wanted = ex.window_pairs(spark, NAMES).select("dataset", F.concat(F.col("config_a"), F.lit("_noInitWin")).alias("config")).unionByName(
        runs.select("dataset", F.replace("config", F.lit("abs_5"), F.lit("abs_6")).alias("config")))
    return ex.missing_keys(wanted, ex.seed_aggregate(runs))


# --- sources and sinks --------------------------------------------------------------------------------------

@query
def packet_file_roundtrip(spark, sf):
    """Decoder text files written from the packets and read back."""
    fields = view(spark, sf, "packet_fields")
    text = fields.select(
        (F.col("ts_us") / 1e6).alias("frame.time_epoch"), F.col("src_ip").alias("ip.src"), F.col("dst_ip").alias("ip.dst"),
        F.col("protocol").alias("ip.proto"), F.col("ip_hdr_len").alias("ip.hdr_len"), F.col("tcp_srcport").alias("tcp.srcport"),
        F.col("tcp_dstport").alias("tcp.dstport"), F.lit(None).cast("int").alias("tcp.hdr_len"), F.col("tcp_len").alias("tcp.len"),
        F.col("udp_srcport").alias("udp.srcport"), F.col("udp_dstport").alias("udp.dstport"), F.col("udp_length").alias("udp.length"),
        F.col("ip_len").alias("ip.len"), F.col("tcp_flags_hex").alias("tcp.flags"), F.col("ttl").alias("ip.ttl"),
        F.col("tcp_window").alias("tcp.window_size_value"))
    path = scratch_path(spark, "packets")
    text.write.option("sep", "\t").option("header", True).csv(path)
    read = tb.read_packet_fields(spark, path)
    return read.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("payload"),
                                        F.sum("src_port").alias("src_ports"), F.sum("tcp_flags").alias("flags"), F.sum("ttl").alias("ttls"),
                                        F.max("ts_us").alias("last_us"))


@query
def registry_file_roundtrip(spark, sf):
    rows = view(spark, sf, "registry").select(
        F.col("flow_src_ip").alias("Src IP"), F.col("flow_src_port").alias("Src Port"), F.col("flow_dst_ip").alias("Dst IP"),
        F.col("flow_dst_port").alias("Dst Port"), F.col("protocol").alias("Protocol"),
        F.date_format(F.timestamp_micros("flow_start_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"), F.col("label").alias("Label"),
        F.nullif(F.col("attempted_category"), F.lit(-1)).alias("Attempted Category"))
    path = scratch_path(spark, "registry")
    rows.write.option("header", True).csv(path)
    return tb.read_registry(spark, path).groupBy("label", "attempted_category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("flow_start_us").alias("starts"))


@query
def csv_clean_numeric(spark, sf):
    """Orders as dirty text: repeated headers and bad numbers."""
    o = load(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")],
                                         F.col("o_orderstatus").alias("Label"), F.col("o_orderkey").alias("_k"))
    bad = o.withColumn("o_totalprice", F.when(F.col("_k") % 9 == 0, "n/a").otherwise(F.col("o_totalprice")))
    header = o.where("_k % 50 = 1").select(F.lit("o_orderkey").alias("o_orderkey"), F.lit("o_custkey").alias("o_custkey"),
                                           F.lit("o_totalprice").alias("o_totalprice"), F.lit("Label").alias("Label"), "_k")
    return tb.clean_flow_table(bad.unionByName(header).drop("_k"))


@query
def ingest_manifest(spark, sf):
    o = load(spark, sf, "orders")
    raw = o.select(F.when(F.col("o_orderkey") % 50 == 1, "o_orderkey").otherwise(F.col("o_orderkey").cast("string")).alias("o_orderkey"),
                   F.col("o_totalprice").cast("string").alias("o_totalprice"), F.concat(F.lit("part_"), F.col("o_orderstatus")).alias("file"))
    return tb.ingest_manifest(raw.select("o_orderkey", "o_totalprice", "file"))


@query
def first_packet_scan(spark, sf):
    path = scratch_path(spark, "grouped")
    sinks.write_table(grouped(spark, sf, PACKET_INPUTS), path)
    return tb.read_first_packets(spark, path, 3, [*fl.FLOW, "packet_index", "payload_len"])


@query
def day_balance(spark, sf):
    return tb.day_balance(rule_labelled(spark, sf))


@query
def path_labels(spark, sf):
    path = F.concat(F.lit("/data/captures/"), F.col("event_type"), F.lit("/"), F.concat(F.lit("host-"), F.col("user_id").cast("string")), F.lit(".pcap"))
    rows = load(spark, sf, "events").select(path.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("path", cl.class_from_path("path").alias("class"), cl.part_from_path("path").alias("part"), "rows")


@query
def capture_names(spark, sf):
    from packetloom.sources.files import is_capture_name

    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", ".pcap", ".PCAPNG", ".lnk", ".txt", ".cap", " part 2", "-part3")]),
                          (F.col("event_id") % 8).cast("int") + 1)
    name = F.concat(F.lit("UCAP172.31.69."), (F.col("user_id") % 200).cast("string"), suffix)
    rows = load(spark, sf, "events").select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("name", is_capture_name(F.col("name")).alias("capture"), "rows")


@query
def bounded_files(spark, sf):
    listing = load(spark, sf, "events").select(F.col("event_type").alias("part"), F.col("user_id").cast("string").alias("file")).distinct()
    return tb.bounded_files(listing, 5)


@query
def parts_union(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    b = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tb.union_parts([a, b])


@query
def part_statistics(spark, sf):
    labelled = lb.attach_labels(flow_heads(spark, sf), lb.label_by_rules(flow_heads(spark, sf), array_rules(spark, sf), codes=CODES)
                                .where("label <> 'Benign'").select(*fl.FLOW, "label", "label_encoded"))
    stats = sinks.part_stats(grouped(spark, sf), labelled)
    counts = [F.try_element_at("label_counts", F.lit(n)).alias(a) for n, a in (("<NA>", "na"), ("DoS Hulk", "hulk"), ("Botnet", "botnet"), ("Portscan", "portscan"))]
    return stats.select("packet_rows", "flow_rows", "unlabeled_flow_rows", *counts)


@query
def registry_cuts(spark, sf):
    built = builds.registry_labelled_cuts(packet_store(spark, sf), view(spark, sf, "registry").drop("capture_file"),
                                          [ct.Cut(ct.PACKET_COUNT, 3), ct.Cut(ct.PACKET_COUNT, 5)], "last")
    return built.flows.groupBy("cut", "label", "matched").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("tot_fwd_pkts").alias("fwd"), F.sum("totlen_bwd_pkts").alias("bwd_bytes"))


@query
def day_build(spark, sf):
    built = builds.rule_labelled_flows(view(spark, sf, "packets_dup"), array_rules(spark, sf), CODES, ct.Cut(ct.PACKET_SHARE, 0.5))
    return built.groupBy("label", "label_encoded").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("tot_fwd_pkts").alias("fwd"), F.sum("flow_duration").alias("duration"))
