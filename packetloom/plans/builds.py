"""Whole jobs composed of the operators: from packets to labelled cuts, bytes, scores.

Each build is one lazy plan over all parts at once; ``part`` is a column, not a loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import header_bytes as hb
from packetloom.functions.classes import (
    DAY_EXCLUDED, GROUND_TRUTH_CODES, collapse_attempt,
)
from packetloom.functions.packets import apply_finite_policy
from packetloom.operators import cuts as ct
from packetloom.operators import flows as fl
from packetloom.operators import forests as fo
from packetloom.operators import labels as lb
from packetloom.operators import metrics as mt
from packetloom.operators import reports as rp
from packetloom.operators import sampling as sp
from packetloom.operators.features import PACKET_INPUTS, flow_features
from packetloom.operators.ordered import stored
from packetloom.operators.selection import feature_columns
from packetloom.sources.store import KEY, PacketStore, per_slice, write_store

WHOLE = ct.Cut(ct.PACKET_SHARE, 1.0)


def packet_base(packets: DataFrame, dedup: bool = True, carry: Sequence[str] = tuple(PACKET_INPUTS)) -> DataFrame:
    """Grouped packets of all captures, duplicates between captured hosts dropped."""
    grouped = fl.group_into_flows(packets, carry=carry)
    return fl.drop_cross_capture_duplicates(grouped, fl.capture_hosts(packets)) if dedup else grouped


def rule_labelled_flows(
    packets: DataFrame, rules: DataFrame | None, codes: Mapping[str, int], cut: ct.Cut = WHOLE,
    policy: str = "first", dedup: bool = True,
) -> DataFrame:
    """One day (or several): base, cut, features, rule labels. ``rules`` None means an
    attack-free day."""
    features = flow_features(ct.apply_cut(packet_base(packets, dedup), cut))
    if rules is None:
        return lb.label_attack_free(features)
    return lb.label_by_rules(features, rules, policy, codes=codes)


def single_capture_flows(packets: DataFrame, capture: str, rules, codes, cut: ct.Cut = WHOLE) -> DataFrame:
    """One capture alone; nothing to deduplicate."""
    return rule_labelled_flows(packets.where(F.col("capture_file") == capture), rules, codes, cut, dedup=False)


@dataclass(frozen=True)
class RegistryBuild:
    registry: DataFrame
    flows: DataFrame


def registry_labelled_cuts(
    packets: DataFrame | PacketStore, registry: DataFrame, cuts: Sequence[ct.Cut], keep: str = "last",
    match_path: str | None = None, dedup: bool = False,
) -> RegistryBuild:
    """Labels come from the whole flows, features from every cut of them.

    The grouped packets are used twice; with ``match_path`` they are written there
    once as a store and read back, which is what a large run should do. A store may also
    be given in place of packets.
    """
    if isinstance(packets, PacketStore):
        base = packets.packets
    else:
        base = packet_base(packets, dedup)
        base = base if match_path is None else write_store(base, match_path).packets
    whole = fl.first_packets(base).select(
        *fl.FLOW, "flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "protocol", "flow_start_us"
    )
    labels = lb.to_label_registry(lb.label_from_registry(whole, registry, keep))
    features = flow_features(ct.cut_grid(base, cuts), by=["cut"])
    return RegistryBuild(labels, lb.attach_registry(features, labels))


def folder_labelled_flows(
    packets: DataFrame, cuts: Sequence[ct.Cut], seed: int = 42, caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """Class-folder data: the label is the packet's folder; the same flows in every cut.

    All flows are kept unless ``caps`` are given (the study's own are ``FOLDER_CAPS``)."""
    base = fl.group_into_flows(packets, carry=["label", *PACKET_INPUTS])
    kept = sp.cap_per_class(fl.first_packets(base).select(*fl.FLOW, "label"), "label", fl.FLOW, seed, caps or {})
    chosen = base.join(kept.select(*fl.FLOW), fl.FLOW, "left_semi")
    return flow_features(ct.cut_grid(chosen, cuts), by=["label", "cut"])


def truth_labelled_flows(
    packets: DataFrame, ground_truth: DataFrame, cut: ct.Cut, codes: Mapping[str, int] = GROUND_TRUTH_CODES,
) -> DataFrame:
    base = fl.group_into_flows(packets, carry=PACKET_INPUTS)
    features = flow_features(ct.apply_cut(base, cut))
    return lb.label_by_nearest(features, lb.prepare_ground_truth(ground_truth), codes)


def assemble(flows: DataFrame, seed: int = 42, caps: Mapping[str, int] | None = None) -> DataFrame:
    """Flows of all scenarios, whole unless ``caps`` are given (the study's own are
    ``GROUND_TRUTH_CAPS``). The order key is the flow, so every cut keeps the same flows."""
    return sp.cap_per_class(flows, "label", fl.FLOW, seed, caps or {})


def flows_for_bytes(
    registry: DataFrame, seed: int = 42, caps: Mapping[str, int] | None = None, default: int | None = None,
    excluded: Sequence[str] = DAY_EXCLUDED, within: Sequence[str] = (), anchor: DataFrame | None = None,
) -> DataFrame:
    """Matched flows of wanted classes, or those anchored to an earlier extraction.

    All are kept unless ``caps`` or a ``default`` cap per day and class are given (the study's
    own are ``DAY_CAPS`` and ``DAY_CAP_DEFAULT``)."""
    matched = registry.where("matched").withColumn("y", collapse_attempt("label"))
    wanted = matched.where(~F.col("y").isin(list(excluded)))
    if anchor is not None:
        return lb.anchor_flows(wanted, anchor)
    return sp.cap_per_class(wanted, "y", fl.FLOW, seed, caps or {}, default, within)


def extract_bytes(
    base: DataFrame, chosen: DataFrame, frames: DataFrame, packets: int = 5, n_bytes: int = hb.N_BYTES,
    strict: bool = False,
) -> DataFrame:
    """First packets of the chosen flows with masked, fixed-length bytes."""
    first = ct.first_packets_for_bytes(base, packets)
    labelled = first.join(chosen.select(*fl.FLOW, "label", "attempted_category"), fl.FLOW)
    mask = hb.mask_strict if strict else hb.mask_addresses
    joined = lb.attach_bytes(labelled, frames).withColumn("_masked", mask(F.col("ip_bytes")))
    return joined.select(
        *fl.FLOW, "pkt_order", "capture_packet_index", "timestamp_rel",
        hb.to_fixed_length(F.col("_masked"), n_bytes).alias("raw_bytes"),
        F.coalesce(F.octet_length("_masked"), F.lit(0)).cast("int").alias("real_length"),
        F.col("ip_bytes").isNotNull().alias("found"), "label", "attempted_category",
    )


def extract_stored_bytes(
    store: PacketStore, chosen: DataFrame, packets: int = 5, n_bytes: int = hb.N_BYTES, strict: bool = False,
) -> DataFrame:
    """:func:`extract_bytes` on a store with frames, keyed by ``KEY``: packets are neither grouped nor shuffled again.

    ``chosen`` needs ``flow_total_packets``.
    """
    since = ((F.col("ts_us") - F.col("flow_start_us")).cast("double") / 1e6).cast("float")
    first = store.packets.where(F.col("packet_index") < packets)
    mask = hb.mask_strict if strict else hb.mask_addresses
    first = first.select(*KEY, "packet_index", "capture_packet_index", since.alias("timestamp_rel"), mask(F.col("ip_bytes")).alias("_masked"))
    wanted = per_slice(chosen.select(*fl.FLOW, "label", "attempted_category", "flow_total_packets"), packets)
    return first.join(wanted.drop("flow_total_packets"), KEY).select(
        *KEY, F.col("packet_index").cast("byte").alias("pkt_order"), "capture_packet_index", "timestamp_rel",
        hb.to_fixed_length(F.col("_masked"), n_bytes).alias("raw_bytes"),
        F.coalesce(F.octet_length("_masked"), F.lit(0)).cast("int").alias("real_length"),
        F.col("_masked").isNotNull().alias("found"), "label", "attempted_category",
    )


def derive_bytes(byte_rows: DataFrame, variant: str) -> DataFrame:
    """Stored bytes under a derived mask."""
    raw = F.col("raw_bytes")
    if variant == "csum_fix":
        made: Column = hb.repair_checksum(raw)
    elif variant in ("strict", "strict_csum"):
        made = hb.derive_strict(raw, checksum_too=variant == "strict_csum")
    elif variant.startswith("occ_top"):
        made = hb.derive_ladder(raw, int(variant.removeprefix("occ_top")))
    else:
        raise ValueError(f"unknown mask variant {variant!r}")
    return byte_rows.withColumn("raw_bytes", made)


@dataclass(frozen=True)
class FuzzyBuild:
    pairs: DataFrame
    quantiles: DataFrame
    by_label: DataFrame
    flows: DataFrame | None
    coverage: DataFrame | None


def fuzzy_labelling(
    flows: DataFrame, registry: DataFrame, tolerance_seconds: float = 1.0, labels: Sequence[str] | None = None,
    keep: str = "first", apply: bool = False,
) -> FuzzyBuild:
    """One-to-one matching with its reports; ``apply`` also relabels the flows."""
    single = lb.dedup_registry(registry, keep)
    pairs = lb.fuzzy_match(flows, single, tolerance_seconds, labels)
    relabelled = lb.apply_matches(flows, pairs, single) if apply else None
    return FuzzyBuild(
        pairs, rp.delta_quantiles(pairs), rp.matches_by_label(pairs, single), relabelled,
        rp.coverage(relabelled) if apply else None,
    )


def distribution_report(labelled: DataFrame, day_order: Column | str = "day") -> dict[str, DataFrame]:
    """The report tables by name; write each with :func:`sinks.write_csv`."""
    return {
        "day_label_distribution": rp.day_label_mix(labelled, day_order), "day_summary": rp.day_summary(labelled),
        "global_label_distribution": rp.global_label_shares(labelled), "feature_quality": rp.feature_quality(labelled),
        "cleanup_summary": rp.cleanup_counters(labelled), "cleanup_label_impact": rp.cleanup_by_label(labelled),
        "balance": rp.balance_before_after(labelled), "unlabelled": rp.unlabelled_rows(labelled),
    }


@dataclass(frozen=True)
class ForestBuild:
    model: object
    predictions: DataFrame
    summary: DataFrame
    classes: DataFrame
    importances: DataFrame
    rows: DataFrame  # persisted; unpersist when done with the tables above


def train_forest(
    labelled: DataFrame, seed: int = 42, min_rows: int = 100, finite: str = "zero", extra_drop: Sequence[str] = (),
    test_share: float = 0.25, support: str = "real", **options,
) -> ForestBuild:
    """Supported classes, clean features, exact split, forest, scores."""
    rows = rp.keep_supported(labelled, min_rows, support).withColumn("label", collapse_attempt("label"))
    features = feature_columns(rows, extra=extra_drop, strict=bool(extra_drop))
    clean = apply_finite_policy(rows.select(*fl.FLOW, "label", *features), features, finite).persist()
    split = stored(sp.train_test_split(clean, "label", fl.FLOW, seed, test_share), "split")
    model = fo.grow(split.where(F.col("split") == sp.TRAIN), fl.FLOW, "label", features, seed, **options)
    scored = fo.predict(model, split.where(F.col("split") == sp.TEST), fl.FLOW, "label")
    counts = mt.confusion_counts(scored)
    return ForestBuild(model, scored, mt.overall(counts), mt.per_class(counts), fo.importances(model), clean)
