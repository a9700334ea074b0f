"""Cuts of flows to what is visible early, all of them filters.

Every packet already carries its position, the flow's start and the flow's size,
so a cut neither shuffles nor rescans. All cuts keep a prefix of each flow and
always its first packet.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET_SHARE, SECONDS, PACKET_COUNT = "packet_pct", "time_abs", "packet_abs"


def check_ratio(ratio: float) -> float:
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must lie in (0, 1], got {ratio}")
    return ratio


def seconds_tag(seconds: float) -> str:
    if seconds <= 0:
        raise ValueError(f"seconds must be positive, got {seconds}")
    whole = float(seconds).is_integer()
    return f"{int(seconds)}s" if whole else f"{round(seconds * 1000)}ms"


@dataclass(frozen=True)
class Cut:
    mode: str
    value: float

    def __post_init__(self):
        if self.mode == PACKET_SHARE:
            check_ratio(self.value)
        elif self.mode in (SECONDS, PACKET_COUNT):
            if self.value <= 0:
                raise ValueError(f"{self.mode} needs a positive value, got {self.value}")
        else:
            raise ValueError(f"unknown cut mode {self.mode!r}")
        if self.mode == PACKET_COUNT and self.value != int(self.value):
            raise ValueError("a packet count is a whole number")

    @property
    def tag(self) -> str:
        if self.mode == PACKET_SHARE:
            return f"pct_{round(self.value * 100):03d}"
        if self.mode == SECONDS:
            return f"time_abs_{seconds_tag(self.value)}"
        return f"packet_abs_{int(self.value)}"


# The cuts of the published study.
STANDARD_CUTS = (
    Cut(PACKET_SHARE, 0.10), Cut(PACKET_SHARE, 0.25), Cut(PACKET_SHARE, 0.50),
    Cut(PACKET_SHARE, 0.75), Cut(PACKET_SHARE, 1.00),
    Cut(SECONDS, 1.0), Cut(SECONDS, 3.0),
    Cut(PACKET_COUNT, 5), Cut(PACKET_COUNT, 4), Cut(PACKET_COUNT, 3),
)


def parse_seconds(text: str) -> float:
    """``500ms``, ``1s`` or a plain number of seconds."""
    found = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*(ms|s)?\s*", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    amount = float(found.group(1))
    return amount / 1000 if found.group(2) == "ms" else amount


def parse_cut(tag: str) -> Cut:
    """The inverse of :attr:`Cut.tag`."""
    if tag.startswith("pct_"):
        return Cut(PACKET_SHARE, int(tag[4:]) / 100)
    if tag.startswith("time_abs_"):
        return Cut(SECONDS, parse_seconds(tag[9:]))
    if tag.startswith("packet_abs_"):
        return Cut(PACKET_COUNT, int(tag[11:]))
    raise ValueError(f"unknown cut tag {tag!r}")


def kept_by(cut: Cut) -> Column:
    """True for the packets a cut keeps."""
    index = F.col("packet_index")
    if cut.mode == PACKET_COUNT:
        return index < int(cut.value)
    if cut.mode == SECONDS:
        limit = round(cut.value * 1e6)
        return (F.col("ts_us") - F.col("flow_start_us") <= limit) | (index == 0)
    if cut.value >= 1:
        return F.lit(True)
    share = F.ceil(F.col("flow_total_packets").cast("double") * F.lit(float(cut.value)))
    return index < F.greatest(share, F.lit(1))


def apply_cut(grouped: DataFrame, cut: Cut) -> DataFrame:
    if cut.mode == PACKET_SHARE and cut.value >= 1:
        return grouped
    return grouped.where(kept_by(cut))


def cut_grid(grouped: DataFrame, cuts=STANDARD_CUTS) -> DataFrame:
    """Every cut of every flow in one pass, tagged with ``cut``.

    Each packet is repeated only for the cuts that keep it; the packets are read
    and grouped once.
    """
    tags = F.array(*[F.when(kept_by(c), F.lit(c.tag)) for c in cuts])
    return grouped.withColumn("cut", F.explode(F.array_compact(tags)))


def first_packets_for_bytes(grouped: DataFrame, count: int) -> DataFrame:
    """The first ``count`` packets of each flow with their order and relative time."""
    since = ((F.col("ts_us") - F.col("flow_start_us")).cast("double") / 1e6).cast("float")
    return grouped.where(F.col("packet_index") < count).select(
        "capture_file", "flow_id", "capture_packet_index",
        F.col("packet_index").cast("byte").alias("pkt_order"), since.alias("timestamp_rel"),
    )


def kept_packets(total: int, ratio: float) -> int:
    """How many of ``total`` packets a share keeps."""
    return max(math.ceil(total * check_ratio(ratio)), 1)
