"""Labels for flows: rule ranges, registries, ground truth and one-to-one matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.classes import encode_label
from packetloom.functions.packets import endpoint_key, protocol_number
from packetloom.operators.flows import FLOW
from packetloom.operators.ordered import MAX_KEY_ROWS, Kernel, ordered_fold, stored

KEY5 = ["flow_src_ip", "flow_src_port", "flow_dst_ip", "flow_dst_port", "protocol"]
KEY6 = [*KEY5, "flow_start_us"]
BENIGN = "Benign"
RULE_MARGIN_SECONDS = 300
NEAREST_TOLERANCE_SECONDS = 5.0
FUZZY_TOLERANCE_SECONDS = 1.0


# --- rule ranges ---------------------------------------------------------------

def label_by_rules(
    flows: DataFrame,
    rules: DataFrame,
    policy: str = "first",
    margin_seconds: float = RULE_MARGIN_SECONDS,
    default: str = BENIGN,
    codes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Adds ``label`` (and ``label_encoded``) from attacker/victim time windows.

    ``rules``: rule_pos, label, attacker_ips[], victim_ips[], victim_ports[] or NULL,
    start_us, end_us. ``policy``: ``first`` rule wins, or the ``narrowest`` window.
    ``rule_pos`` is unique. Rules are gathered per attacker, so each end of a flow meets
    them in an equi join that keeps one row per flow; victims are tested and the winner
    is picked inside the row. Nothing grows with attackers times victims.
    """
    if policy not in ("first", "narrowest"):
        raise ValueError(f"unknown policy {policy!r}")
    if rules.isEmpty():
        raise ValueError("no attack rules: label an attack-free part with label_attack_free")
    margin = round(margin_seconds * 1e6)
    width = F.col("end_us") - F.col("start_us") if policy == "narrowest" else F.lit(0)
    rule = F.struct(
        width.alias("width"), F.col("rule_pos").alias("pos"), F.col("label").alias("label"),
        F.col("victim_ips").alias("victims"), F.col("victim_ports").alias("ports"),
        (F.col("start_us") - margin).alias("start"), (F.col("end_us") + margin).alias("end"),
    )
    attacks = rules.withColumn("_attacker", F.explode(F.array_distinct("attacker_ips"))).select("_attacker", rule.alias("rule"))
    attacks = attacks.groupBy("_attacker").agg(F.collect_list("rule").alias("_rules"))

    def applying(own: str, other: str, far_ip: str, far_port: str, near_port: str) -> Column:
        """Rules under which one end attacks the other; ``other`` are those the far end attacks under."""
        def applies(rule: Column) -> Column:
            both = F.exists(other, lambda r: r["pos"] == rule["pos"])
            free = rule["ports"].isNull() | (F.size(rule["ports"]) == 0)
            on_port = F.array_contains(rule["ports"], F.col(far_port)) | (both & F.array_contains(rule["ports"], F.col(near_port)))
            return (
                F.array_contains(rule["victims"], F.col(far_ip))
                & F.col("flow_start_us").between(rule["start"], rule["end"]) & (free | on_port)
            )
        return F.filter(own, applies)

    def attacking(end: str, name: str) -> DataFrame:
        return attacks.select(F.col("_attacker").alias(end), F.col("_rules").alias(name))

    def held(name: str) -> Column:
        return F.coalesce(name, F.array().cast(attacks.schema["_rules"].dataType)).alias(name)

    met = flows.drop("label", "label_encoded")
    columns = [F.col(c) for c in met.columns]
    met = met.join(attacking("flow_src_ip", "_src_rules"), "flow_src_ip", "left").join(
        attacking("flow_dst_ip", "_dst_rules"), "flow_dst_ip", "left"
    ).select(*columns, held("_src_rules"), held("_dst_rules"))
    found = F.concat(
        applying("_src_rules", "_dst_rules", "flow_dst_ip", "flow_dst_port", "flow_src_port"),
        applying("_dst_rules", "_src_rules", "flow_src_ip", "flow_src_port", "flow_dst_port"),
    )
    labelled = met.select(*columns, F.coalesce(F.array_min(found)["label"], F.lit(default)).alias("label"))
    return labelled if codes is None else labelled.withColumn("label_encoded", encode_label("label", codes))


def label_attack_free(flows: DataFrame, label: str = BENIGN, code: int = 0) -> DataFrame:
    """Every flow of a part without attacks."""
    return flows.drop("label", "label_encoded").select(
        "*", F.lit(label).alias("label"), F.lit(code).alias("label_encoded")
    )


def attach_labels(flows: DataFrame, labels: DataFrame, unlabeled: int = -1) -> DataFrame:
    """Labels by flow; flows without one get NULL and ``unlabeled``."""
    picked = labels.select(*FLOW, "label", "label_encoded")
    joined = flows.drop("label", "label_encoded").join(picked, FLOW, "left")
    return joined.withColumn("label_encoded", F.coalesce("label_encoded", F.lit(unlabeled)))


# --- registries ------------------------------------------------------------------

def dedup_registry(registry: DataFrame, keep: str = "first", key: Sequence[str] = tuple(KEY6)) -> DataFrame:
    """One row per key, the ``first`` or ``last`` by row order; aggregates map-side."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep is 'first' or 'last', got {keep!r}")
    rest = [c for c in registry.columns if c not in key]
    whole = F.struct(*rest)
    pick = F.min_by if keep == "first" else F.max_by
    return registry.groupBy(*key).agg(pick(whole, F.col("row_ord")).alias("_row")).select(
        *key, *[F.col("_row")[c].alias(c) for c in rest]
    )


def label_from_registry(flows: DataFrame, registry: DataFrame, keep: str = "first") -> DataFrame:
    """Exact join on directional 5-tuple and start microsecond, at most one partner."""
    single = dedup_registry(registry, keep).select(
        *KEY6, F.col("label").alias("_label"), F.col("attempted_category").alias("_category")
    )
    return (
        flows.drop("label", "attempted_category", "matched")
        .join(single, KEY6, "left")
        .withColumn("matched", F.col("_label").isNotNull())
        .withColumn("attempted_category", F.coalesce("_category", F.lit(-1)))
        .withColumnRenamed("_label", "label")
        .drop("_category")
    )


def unlabelled_registry(flows: DataFrame) -> DataFrame:
    """What a part without any registry yields."""
    return flows.drop("label", "attempted_category", "matched").select(
        "*", F.lit(None).cast("string").alias("label"),
        F.lit(-1).alias("attempted_category"), F.lit(False).alias("matched"),
    )


def to_label_registry(labelled: DataFrame) -> DataFrame:
    """The per-flow registry kept beside the flows (10 columns plus the capture)."""
    return labelled.select(
        *FLOW, "flow_src_ip", "flow_dst_ip", "flow_src_port", "flow_dst_port", "protocol",
        "flow_start_us", "label", "attempted_category", "matched",
    )


def attach_registry(flows: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry labels by flow id, for flows of any cut."""
    picked = registry.select(*FLOW, "label", "attempted_category", "matched")
    joined = flows.drop("label", "attempted_category", "matched").join(picked, FLOW, "left")
    return joined.withColumns({
        "attempted_category": F.coalesce("attempted_category", F.lit(-1)),
        "matched": F.coalesce("matched", F.lit(False)),
    })


# --- nearest ground truth ----------------------------------------------------------

def prepare_ground_truth(gt: DataFrame) -> DataFrame:
    """Ground-truth rows as (gt_ord, key, gt_us, type); rows without time or type go."""
    port = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).cast("long")
    return gt.select(
        "gt_ord",
        endpoint_key(protocol_number("proto"), "src_ip", port("src_port"), "dst_ip", port("dst_port")).alias("key"),
        F.rint(F.col("ts").cast("double") * 1e6).cast("long").alias("gt_us"),
        F.lower(F.trim("type")).alias("type"),
    ).dropna(subset=["gt_us", "type"])


def ground_truth_index(prepared: DataFrame) -> DataFrame:
    """Adds ``key_dup``: the key occurs more than once."""
    counts = prepared.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("key_dup"))
    return prepared.join(counts, "key")


def label_by_nearest(
    flows: DataFrame,
    prepared: DataFrame,
    codes: Mapping[str, int],
    tolerance_seconds: float = NEAREST_TOLERANCE_SECONDS,
    normal: str = "normal",
) -> DataFrame:
    """Label from the nearest ground-truth row of the same direction-free 5-tuple.

    A key that occurs once is accepted at any distance, otherwise the gap may be at
    most the tolerance; equal gaps go to the earlier ground-truth row. No pairs are
    formed: time is cut into slices as wide as the tolerance, every slice also sees
    the last row of the slice before and the first of the slice after, and a sorted
    pass finds the neighbours. A busy key spreads over its slices.
    """
    width = round(tolerance_seconds * 1e6)
    slice_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    per_key = prepared.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("type", "gt_ord").alias("_only")
    )
    marks = (
        prepared.groupBy("key", "gt_us")
        .agg(F.min_by(F.struct("gt_us", "gt_ord", "type"), "gt_ord").alias("_gt"))
        .select("key", "_gt", F.col("gt_us").alias("_at"), slice_of("gt_us").alias("_slice"))
    )
    edges = marks.groupBy("key", "_slice").agg(
        F.min_by("_gt", "_at").alias("head"), F.max_by("_gt", "_at").alias("tail")
    )
    shifted = lambda gt, step: edges.select(
        "key", F.col(gt).alias("_gt"), F.col(gt)["gt_us"].alias("_at"), (F.col("_slice") + step).alias("_slice")
    )
    truth = marks.unionByName(shifted("tail", 1)).unionByName(shifted("head", -1))

    columns = [c for c in flows.columns if c not in ("label", "label_encoded", "matched", "match_level")]
    key = endpoint_key("protocol", "flow_src_ip", "flow_src_port", "flow_dst_ip", "flow_dst_port")
    rows = flows.select(
        *columns, key.alias("key"), F.col("flow_start_us").alias("_at"),
        slice_of("flow_start_us").alias("_slice"), F.lit(1).alias("_flow"),
    )
    mixed = rows.unionByName(truth.withColumn("_flow", F.lit(0)), allowMissingColumns=True)
    upward = Window.partitionBy("key", "_slice").orderBy("_at", "_flow")
    downward = Window.partitionBy("key", "_slice").orderBy(F.desc("_at"), F.desc("_flow"))
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    near = (
        mixed.withColumn("_left", F.last("_gt", ignorenulls=True).over(back(upward)))
        .withColumn("_right", F.last("_gt", ignorenulls=True).over(back(downward)))
        .where("_flow = 1")
    )
    offer = lambda side: F.when(
        F.col(side).isNotNull() & (F.abs(F.col(side)["gt_us"] - F.col("_at")) <= width),
        F.struct(
            F.abs(F.col(side)["gt_us"] - F.col("_at")).alias("gap"),
            F.col(side)["gt_ord"].alias("ord"), F.col(side)["type"].alias("type"),
        ),
    )
    found = F.when(F.col("_n") == 1, F.col("_only")).otherwise(
        F.array_min(F.array_compact(F.array(offer("_left"), offer("_right"))))["type"]
    )
    return (
        near.join(per_key, "key", "left")
        .withColumn("_found", found)
        .select(
            *columns,
            F.coalesce("_found", F.lit(normal)).alias("label"),
            F.when(F.col("_found").isNotNull(), 1).otherwise(0).cast("byte").alias("match_level"),
        )
        .withColumn("matched", F.col("label") != normal)
        .withColumn("label_encoded", encode_label("label", codes, default=0))
    )


# --- one-to-one matching -------------------------------------------------------------

PAIRS = T.StructType([
    T.StructField("row_ord", T.LongType()),
    T.StructField("capture_file", T.StringType()),
    T.StructField("flow_id", T.LongType()),
    T.StructField("delta_us", T.LongType()),
])


class PairInOrder(Kernel):
    """Greedy one-to-one pairing of two sorted sequences within a tolerance.

    Walking both sequences together is the same as a queue that only ever holds one
    side: a newcomer of the other side takes the oldest entry still in reach.
    """

    def __init__(self, tolerance_us: int):
        self.tolerance_us = tolerance_us

    def reset(self, table: pa.Table) -> int | None:
        apart = np.flatnonzero(np.diff(table.column("at_us").to_numpy()) > self.tolerance_us)
        return int(apart[-1]) + 1 if len(apart) else None

    def __call__(self, table: pa.Table, starts: np.ndarray, carry, open_end: bool):
        if carry is not None and carry.num_rows:
            starts = np.concatenate([[0], starts[1:] + carry.num_rows])
            table = pa.concat_tables([carry, table.select(carry.column_names)]).combine_chunks()
        at = table.column("at_us").to_pylist()
        kind = table.column("kind").to_pylist()
        bounds = [*starts.tolist(), len(at)]
        left, right, waiting = [], [], []
        for begin, end in zip(bounds, bounds[1:]):
            waiting, head = [], 0
            for row in range(begin, end):
                while head < len(waiting) and at[waiting[head]] < at[row] - self.tolerance_us:
                    head += 1
                if head < len(waiting) and kind[waiting[head]] != kind[row]:
                    pair = (waiting[head], row)
                    left.append(pair[kind[pair[0]]])
                    right.append(pair[1 - kind[pair[0]]])
                    head += 1
                else:
                    waiting.append(row)
            waiting = waiting[head:]
        left, right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        stamps = table.column("at_us").to_numpy()
        out = pa.table({
            "row_ord": table.column("row_ord").take(pa.array(left)),
            "capture_file": table.column("capture_file").take(pa.array(right)),
            "flow_id": table.column("flow_id").take(pa.array(right)),
            "delta_us": pa.array(stamps[right] - stamps[left], type=pa.int64()),
        })
        return out, table.take(pa.array(waiting, type=pa.int64())) if open_end else None


def uncovered_registry(registry: DataFrame, flows: DataFrame) -> DataFrame:
    """Registry rows whose exact key no flow has."""
    return registry.join(flows.select(*KEY6), KEY6, "left_anti")


def fuzzy_match(
    flows: DataFrame,
    registry: DataFrame,
    tolerance_seconds: float = FUZZY_TOLERANCE_SECONDS,
    labels: Sequence[str] | None = None,
    max_key_rows: int = MAX_KEY_ROWS,
) -> DataFrame:
    """Pairs of uncovered registry rows and unmatched flows of one 5-tuple.

    ``flows`` carry ``matched`` from :func:`label_from_registry`; ``registry`` is
    deduplicated. Returns row_ord, capture_file, flow_id, delta_us (flow − registry).
    """
    missing = uncovered_registry(registry, flows)
    if labels is not None:
        missing = missing.where(F.col("label").isin(list(labels)))
    loose = flows.where("not matched").join(missing.select(*KEY5), KEY5, "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    events = missing.select(
        *KEY5, F.col("flow_start_us").alias("at_us"), F.lit(0).alias("kind"), "row_ord",
        none("string").alias("capture_file"), none("long").alias("flow_id"),
    ).unionByName(loose.select(
        *KEY5, F.col("flow_start_us").alias("at_us"), F.lit(1).alias("kind"),
        none("long").alias("row_ord"), "capture_file", "flow_id",
    ))
    order = ["at_us", "kind", "row_ord", "capture_file", "flow_id"]
    kernel = PairInOrder(round(tolerance_seconds * 1e6))
    return ordered_fold(stored(events, "events"), KEY5, order, kernel, PAIRS, max_key_rows)


def apply_matches(flows: DataFrame, pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """Overwrite label, category and matched on the paired flows."""
    gained = pairs.join(registry.select("row_ord", "label", "attempted_category"), "row_ord").select(
        *FLOW, F.col("label").alias("_label"), F.col("attempted_category").alias("_category")
    )
    return (
        flows.join(gained, FLOW, "left")
        .withColumns({
            "label": F.coalesce("_label", "label"),
            "attempted_category": F.coalesce("_category", "attempted_category", F.lit(-1)),
            "matched": F.col("matched") | F.col("_label").isNotNull(),
        })
        .drop("_label", "_category")
    )


# --- fetching by flow ------------------------------------------------------------------

def align_features(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features of exactly the wanted flows; a flow without features is an error."""
    keys = wanted.select(*FLOW).distinct()
    lost = keys.join(features.select(*FLOW), FLOW, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"no features for some wanted flows, e.g. {[tuple(r) for r in lost]}")
    return features.join(keys, FLOW, "left_semi")


def anchor_flows(labelled: DataFrame, earlier: DataFrame) -> DataFrame:
    """Keep exactly the flows of an earlier extraction that still carry a label."""
    return labelled.join(earlier.select(*FLOW), FLOW, "left_semi")


def anchor_report(labelled: DataFrame, earlier: DataFrame) -> DataFrame:
    """Requested, kept and lost flows of an anchored selection."""
    keys = earlier.select(*FLOW).distinct()
    present = labelled.select(*FLOW).distinct().withColumn("_kept", F.lit(1))
    return keys.join(present, FLOW, "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_kept").alias("kept"),
        (F.count(F.lit(1)) - F.count("_kept")).alias("lost"),
    )


def label_packets(packets: DataFrame, labelled: DataFrame) -> DataFrame:
    """Packets of labelled flows only, with the flow's label."""
    return packets.join(labelled.select(*FLOW, "label"), FLOW)


def attach_bytes(packets: DataFrame, frames: DataFrame) -> DataFrame:
    """Bytes by capture and ordinal; a packet without a frame keeps NULL bytes."""
    return packets.join(
        frames.select("capture_file", "capture_packet_index", "ip_bytes"),
        ["capture_file", "capture_packet_index"], "left",
    )
