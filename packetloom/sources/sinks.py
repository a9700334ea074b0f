"""Writers: partitioned Parquet, optional CSV, manifests.

Spark commits a table as a whole, so a failed job leaves no half-written part and a
rerun replaces exactly the partitions it writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.classes import shown_label


def exists(df: DataFrame, path: str) -> bool:
    """Committed output is present; what a failed job left (``_temporary``) is not."""
    try:
        return bool(df.sparkSession.read.parquet(path).columns)
    except AnalysisException:  # no such folder, or no finished file in it
        return False


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "snappy", force: bool = True,
) -> bool:
    """Write Parquet; with ``force`` off a finished table is left alone."""
    if not force and exists(df, path):
        return False
    writer = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    return True


def write_bytes(df: DataFrame, path: str, partition_by: Sequence[str] = (), force: bool = True) -> bool:
    return write_table(df, path, partition_by, "zstd", force)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def part_stats(packets: DataFrame, flows: DataFrame, drops: DataFrame | None = None) -> DataFrame:
    """Build statistics of a part: packets, flows, unlabelled flows, label counts, drops."""
    stats = flows.agg(
        F.count(F.lit(1)).alias("flow_rows"), F.count_if(F.col("label").isNull()).alias("unlabeled_flow_rows"),
    )
    labels = flows.groupBy(shown_label("label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    rows = packets.agg(F.count(F.lit(1)).alias("packet_rows"))
    out = rows.join(stats).join(counts)
    if drops is not None:
        out = out.join(drops.agg(
            F.sum("dropped_flow_rows").alias("dropped_flow_rows"), F.sum("dropped_packet_rows").alias("dropped_packet_rows")
        ))
    return out


def build_manifest(
    stats: DataFrame, part: str, labels_available: bool, issues: DataFrame | None = None,
    timeout_seconds: float = 120.0, gap_seconds: float = 5.0, scope: str = "per_capture_file", dedup: bool = True,
) -> DataFrame:
    """One manifest row: parameters, labelling and statistics."""
    reason = None if labels_available else "No attack rules configured for this part."
    out = stats.select(
        F.lit(1).alias("schema_version"), F.lit(part).alias("part"),
        F.struct(
            F.lit(float(timeout_seconds)).alias("active_timeout_seconds"),
            F.lit(float(gap_seconds)).alias("active_idle_threshold_seconds"),
            F.lit(scope).alias("flow_grouping_scope"), F.lit(dedup).alias("cross_capture_dedup_applied"),
        ).alias("build"),
        F.struct(
            F.lit(labels_available).alias("labels_available"), F.lit(labels_available).alias("training_ready"),
            F.lit(reason).cast("string").alias("unlabeled_reason"),
        ).alias("labeling"),
        F.struct(*stats.columns).alias("stats"),
    )
    if issues is None:
        return out.withColumn("known_issues", F.array().cast("array<string>"))
    listed = issues.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "issue"))), lambda s: s["issue"]).alias("known_issues"))
    return out.join(listed)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)
