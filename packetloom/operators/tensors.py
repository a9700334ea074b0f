"""Packed flows for byte models, time encoding, and the occlusion sweep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.classes import collapse_attempt, is_attempt
from packetloom.functions.header_bytes import N_BYTES, OCCLUSION_REGIONS, zero_range, zeros
from packetloom.operators.flows import FLOW
from packetloom.operators.metrics import confusion_counts, overall, per_class


def supported_flows(flows: DataFrame, min_real: int = 100) -> DataFrame:
    """Flows (one row each, with ``label``) of the classes with ``min_real`` flows that are no attempts."""
    marked = flows.withColumn("_y", collapse_attempt("label", anywhere=True))
    real = F.count_if(~is_attempt("label"))
    kept = marked.groupBy("_y").agg(real.alias("_real")).where(F.col("_real") >= min_real)
    return marked.join(kept.select("_y"), "_y", "left_semi").select(*flows.columns)


def pack_flows(
    byte_rows: DataFrame, max_packets: int = 5, n_bytes: int = N_BYTES, min_real: int | None = 100,
    count_before_found: bool = True, key: Sequence[str] = tuple(FLOW),
) -> DataFrame:
    """One row per flow: ``packets`` ARRAY<BINARY>, ``padding`` ARRAY<BOOLEAN>,
    ``times`` ARRAY<FLOAT> and the class ``y``.

    ``byte_rows``: flow, pkt_order, timestamp_rel, raw_bytes, found, label. Missing
    slots are zero bytes and padding. Classes need ``min_real`` flows that are no
    attempts; whether flows without any found packet count towards that differs
    between data sets. With None all classes stay: choose the flows by :func:`supported_flows`
    before their bytes are fetched. ``key`` names the columns that the rows are laid out by,
    where those are the flow and more.
    """
    rows = byte_rows.withColumn("y", collapse_attempt("label", anywhere=True))
    held = rows.where(F.col("found"))
    if min_real is not None:
        counted = rows if count_before_found else held
        flows = counted.groupBy(*key, "y").agg(F.bool_and(is_attempt("label")).alias("_attempt"))
        kept = flows.groupBy("y").agg(F.count_if(~F.col("_attempt")).alias("_real")).where(F.col("_real") >= min_real)
        held = held.join(kept.select("y"), "y", "left_semi")
    slot = F.struct(
        F.col("pkt_order").cast("int").alias("at"),
        F.substring("raw_bytes", 1, n_bytes).alias("raw"), F.col("timestamp_rel").alias("t"),
    )
    grouped = held.groupBy(*key).agg(
        F.min_by("y", "pkt_order").alias("y"),
        F.collect_list(F.when(F.col("pkt_order") < max_packets, slot)).alias("_slots"),
    )
    at = lambda i: F.get(F.filter("_slots", lambda s: s["at"] == i), F.lit(0))
    fixed = lambda raw: F.concat(raw, zeros(F.lit(n_bytes) - F.octet_length(raw)))
    places = [F.lit(i) for i in range(max_packets)]
    return grouped.select(
        *FLOW, "y",
        F.array(*[F.coalesce(fixed(at(i)["raw"]), zeros(n_bytes)) for i in places]).alias("packets"),
        F.array(*[at(i).isNull() for i in places]).alias("padding"),
        F.array(*[F.coalesce(at(i)["t"], F.lit(0.0)).cast("float") for i in places]).alias("times"),
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _scaled_bytes(packets: pa.Array) -> pa.Array:
    """The bytes of a whole batch as one view; lists end where their last packet ends."""
    slots = packets.flatten().cast(pa.large_binary())
    _, ends, data = slots.buffers()
    first = slots.offset
    ends = np.frombuffer(ends, dtype=np.int64)[first:first + len(slots) + 1] if len(slots) else np.zeros(1, dtype=np.int64)
    values = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    sizes = packets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bounds = (ends - ends[0])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(values / 255.0))


def byte_features(packed: DataFrame, out: str = "features") -> DataFrame:
    """All packet bytes of a flow as one vector of values in [0, 1]."""
    return packed.withColumn(out, array_to_vector(_scaled_bytes("packets")))


def time_encoding(
    times: Column | str, padding: Column | str, width: int, base: float = 10_000.0,
    clip: float = 60.0, scale: float = 10.0,
) -> Column:
    """Sine and cosine of the relative time, interleaved; zeros at padding."""
    if width % 2:
        raise ValueError("the width must be even")
    slots = F.arrays_zip(F.col(times) if isinstance(times, str) else times,
                         F.col(padding) if isinstance(padding, str) else padding)

    def one(slot: Column) -> Column:
        t = F.greatest(F.least(slot["times"].cast("double"), F.lit(clip)), F.lit(0.0)) / scale
        waves = []
        for i in range(width // 2):
            angle = t * (base ** (-2 * i / width))
            waves += [F.sin(angle), F.cos(angle)]
        return F.when(slot["padding"], F.array(*[F.lit(0.0)] * width)).otherwise(F.array(*waves))

    return F.transform(slots, one)


def occluded(packed: DataFrame, regions=OCCLUSION_REGIONS, n_bytes: int = N_BYTES) -> DataFrame:
    """Every flow once per region with that region zeroed in all packets, and once
    untouched (region ``none``). Regions past the stored length are skipped."""
    usable = [r for r in regions if r[2] <= n_bytes]
    kinds = F.array(*[
        F.struct(F.lit(name).alias("region"), F.lit(start).alias("start"), F.lit(end).alias("end"))
        for name, start, end in [("none", 0, 0), *usable]
    ])
    wide = packed.select("*", F.inline(kinds))
    return wide.withColumn(
        "packets", F.transform("packets", lambda p: zero_range(p, F.col("start"), F.col("end")))
    )


def joined_bytes(packed: DataFrame, out: str = "bytes", max_packets: int = 5) -> DataFrame:
    """All packet bytes of a flow as one binary value."""
    return packed.withColumn(out, F.concat(*[F.get("packets", F.lit(i)) for i in range(max_packets)]))


def region_places(regions=OCCLUSION_REGIONS, max_packets: int = 5, n_bytes: int = N_BYTES) -> dict[str, list[int]]:
    """The places of every region in the :func:`joined_bytes` of a flow. Regions past the stored length are skipped."""
    return {name: [p * n_bytes + i for p in range(max_packets) for i in range(start, end)] for name, start, end in regions if end <= n_bytes}


def occlusion_sweep(packed: DataFrame, score: Callable[[DataFrame], DataFrame], regions=OCCLUSION_REGIONS):
    """``(drops, per-class changes)`` of macro-F1 per region.

    ``score`` turns packed flows into ``y_true``/``y_pred`` rows and keeps ``region``.
    All regions are scored in one job and reduced to confusion counts at once.
    """
    counts = confusion_counts(score(occluded(packed, regions)), ["region"])
    return drops_from_counts(counts, regions)


def drops_from_counts(counts: DataFrame, regions=OCCLUSION_REGIONS):
    scores = overall(counts, ["region"]).select("region", "macro_f1")
    base = scores.where("region = 'none'").select(F.col("macro_f1").alias("_base"))
    spans = F.create_map(*[F.lit(x) for name, s, e in regions for x in (name, s)])
    ends = F.create_map(*[F.lit(x) for name, s, e in regions for x in (name, e)])
    c = F.col
    drops = (
        # one row: a product without a broadcast has as many tasks as its sides' partitions multiplied
        scores.where("region <> 'none'").crossJoin(F.broadcast(base))
        .withColumns({"start": spans[c("region")], "end": ends[c("region")]})
        .select(
            "region", "start", "end", (c("end") - c("start")).alias("n_bytes"),
            c("macro_f1").alias("macro_f1_occluded"), (c("macro_f1") - c("_base")).alias("delta_macro_f1"),
            (c("_base") - c("macro_f1")).alias("drop"),
        )
        .orderBy(F.desc("drop"), "region")
    )
    classes = counts.select(F.col("y_true").alias("class")).union(counts.select("y_pred")).distinct()
    table = per_class(counts, ["region"], classes).select("region", "class", "f1")
    before = table.where("region = 'none'").select("class", F.col("f1").alias("_before"))
    changes = table.where("region <> 'none'").join(before, "class").select(
        "region", "class", (F.col("f1") - F.col("_before")).alias("delta_f1")
    )
    return drops, changes


def mask_stats(byte_rows: DataFrame, before: Column, after: Column, sane: Column, tcp: Column, options: Column) -> DataFrame:
    """Rows, rows with a sane header, TCP rows, rows with TCP options, changed rows."""
    return byte_rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(sane).alias("rows_sane"), F.count_if(sane & tcp).alias("tcp_rows"),
        F.count_if(sane & tcp & options).alias("tcp_with_options"), F.count_if(before != after).alias("changed"),
    )
