"""A stored packet base, keyed by flow: grouped once, read by every cut, label and byte job after that.

Packets lie in buckets of ``(capture_file, flow_id, slice)``, sorted by position; ``slice`` numbers every
``SLICE`` packets of a flow, so a flow of any length is spread and all but giant flows lie whole in slice 0. Bytes of
their frames are one more column. Jobs on the base therefore need neither another grouping nor another
shuffle of packets: joins by flow and slice and aggregations per flow meet the layout, and columns that a job does not ask for
are not read.

The table is an external one under ``path``; a small manifest there holds what a later session needs to open it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.flows import FLOW

SLICE = 1 << 20
KEY = [*FLOW, "slice"]
BUCKETS = 64


def slice_of(index: Column) -> Column:
    return F.shiftright(index, SLICE.bit_length() - 1).cast("int")


@dataclass(frozen=True)
class PacketStore:
    """``packets``: the grouped packets, their ``slice``, and ``ip_bytes`` where the store holds frames."""

    packets: DataFrame

    def flows(self) -> DataFrame:
        """First packets, one row per flow."""
        return self.packets.where("packet_index = 0")


def per_slice(flows: DataFrame, packets: int | None = None) -> DataFrame:
    """Rows of ``flows`` (with ``flow_total_packets``) once per slice of their first ``packets`` packets: joined by
    ``KEY``, the packets stay where they lie."""
    last = F.col("flow_total_packets") - 1
    last = slice_of(last if packets is None else F.least(last, F.lit(packets - 1)))
    return flows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))


def _name(path: str) -> str:
    return f"packetloom_packets_{hashlib.md5(path.encode()).hexdigest()}"


def write_store(grouped: DataFrame, path: str, frames: DataFrame | None = None, buckets: int = BUCKETS) -> PacketStore:
    """Write the output of ``group_into_flows``, with the bytes of ``frames`` (by capture and ordinal) if given.

    Choose ``buckets`` so that a bucket is a good task: about the bytes of the base over 256 MB, 64 at least.
    """
    spark = grouped.sparkSession
    rows = grouped.withColumn("slice", slice_of(F.col("packet_index")))
    if frames is not None:
        place = ["capture_file", "capture_packet_index"]
        rows = rows.join(frames.select(*place, "ip_bytes"), place, "left")
    # the shuffle and the buckets use one hash, so each task writes one file
    laid = rows.repartition(buckets, *KEY).sortWithinPartitions(*KEY, "packet_index")
    writer = laid.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY, "packet_index")
    writer.option("path", f"{path}/packets").saveAsTable(_name(path))
    manifest = spark.createDataFrame([(spark.table(_name(path)).schema.json(), buckets)], "columns string, buckets int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> PacketStore:
    """A finished store: its manifest is written last, so half a store cannot be opened."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        row = spark.read.parquet(f"{path}/manifest").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(row["columns"])))
        keys = ", ".join(KEY)
        spark.sql(
            f"create table {name} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}, packet_index) "
            f"into {row['buckets']} buckets location '{path}/packets'"
        )
    return PacketStore(spark.table(name))
