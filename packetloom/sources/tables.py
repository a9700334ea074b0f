"""Readers of packet fields, registries, ground truth, flow CSVs and partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.packets import flags_from_hex, payload_length, port_of, seconds_to_micros
from packetloom.operators.ordered import ranked_within

# The fields a decoder exports, in order, with their types.
DECODED_FIELDS = [
    ("frame.time_epoch", "double"), ("ip.src", "string"), ("ip.dst", "string"), ("ip.proto", "int"),
    ("ip.hdr_len", "int"), ("tcp.srcport", "int"), ("tcp.dstport", "int"), ("tcp.hdr_len", "int"),
    ("tcp.len", "int"), ("udp.srcport", "int"), ("udp.dstport", "int"), ("udp.length", "int"),
    ("ip.len", "int"), ("tcp.flags", "string"), ("ip.ttl", "int"), ("tcp.window_size_value", "int"),
]
# Header of a label registry file.
REGISTRY_FIELDS = ["Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp", "Label", "Attempted Category"]
REGISTRY_NAMES = ["flow_src_ip", "flow_src_port", "flow_dst_ip", "flow_dst_port", "protocol", "timestamp", "label", "attempted_category"]
# Header of a ground-truth file.
TRUTH_FIELDS = ["ts", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "type"]
BOM = "﻿"


def file_name(path: Column | str = "_metadata.file_path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def read_packet_fields(spark: SparkSession, path: str, max_packets: int | None = None) -> DataFrame:
    """Decoder output (tab separated, header, empty = NULL) as clean packets.

    Rows without addresses go; the ordinal is the packet's place in time within its
    capture, ``max_packets`` keeps the first of them.
    """
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in DECODED_FIELDS])
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="", mode="PERMISSIVE")
    raw = raw.select("*", file_name().alias("capture_file"))
    named = {n: n.replace(".", "_") for n, _ in DECODED_FIELDS}
    flat = raw.select("capture_file", *[F.col(f"`{n}`").alias(v) for n, v in named.items()])
    rows = flat.select(
        "capture_file", seconds_to_micros("frame_time_epoch").alias("ts_us"), F.col("ip_src").alias("src_ip"),
        F.col("ip_dst").alias("dst_ip"), F.col("ip_proto").alias("protocol"), "ip_hdr_len", "ip_len",
        F.col("tcp_srcport"), F.col("tcp_dstport"), "tcp_len", "udp_srcport", "udp_dstport", "udp_length",
        F.col("tcp_flags").alias("tcp_flags_hex"), F.col("ip_ttl").alias("ttl"),
        F.col("tcp_window_size_value").alias("tcp_window"),
    )
    clean = unify_packet_fields(rows)
    numbered = number_packets(clean)
    return numbered if max_packets is None else numbered.where(F.col("capture_packet_index") < max_packets)


def unify_packet_fields(fields: DataFrame) -> DataFrame:
    """TCP and UDP columns to one set of packet columns, NULL numbers to 0."""
    rows = fields.dropna(subset=["src_ip", "dst_ip"]).select(
        *[c for c in ("capture_file", "capture_packet_index", "ts_us") if c in fields.columns],
        "src_ip", "dst_ip",
        port_of("tcp_srcport", "udp_srcport").alias("src_port"), port_of("tcp_dstport", "udp_dstport").alias("dst_port"),
        *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("protocol", "ip_len", "ip_hdr_len", "ttl")],
        flags_from_hex(F.coalesce("tcp_flags_hex", F.lit(""))).alias("tcp_flags"),
        F.coalesce("tcp_window", F.lit(0)).cast("int").alias("tcp_win"),
        *[F.coalesce(c, F.lit(0)).alias(f"_{c}") for c in ("tcp_len", "udp_length")],
    )
    length = payload_length("protocol", "_tcp_len", "_udp_length", "ip_len", "ip_hdr_len")
    return rows.withColumn("payload_len", length).drop("_tcp_len", "_udp_length")


def number_packets(packets: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """``capture_packet_index``: 0-based place in time within the capture."""
    ties = list(tie_break) or [c for c in ("src_ip", "dst_ip", "src_port", "dst_port", "ip_len", "tcp_flags") if c in packets.columns]
    order = [F.col("ts_us"), *[F.col(c) for c in ties]]
    ranked = ranked_within(packets, ["capture_file"], F.expr("ts_us div 1000000"), order, "_rank")
    return ranked.withColumn("capture_packet_index", F.col("_rank") - 1).drop("_rank")


def in_file_order(raw: DataFrame, name: str) -> DataFrame:
    """``name``: a number that rises with file path and place in the file, however the files are split.

    Rows are numbered within their block; a block starts at its byte offset, which no earlier block's
    rows reach, since a row takes at least a byte. One row per block is joined back.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_row"))
    blocks = placed.groupBy("_file", "_block").agg(F.min("_row").alias("_first"))
    files = blocks.groupBy("_file").agg(F.count(F.lit(1))).select("_file", F.row_number().over(Window.orderBy("_file")).alias("_nth"))  # one row per file
    full = placed.join(blocks.join(files, "_file"), ["_file", "_block"])
    number = F.shiftleft(F.col("_nth").cast("long"), 42) + F.col("_block") + F.col("_row") - F.col("_first")
    return full.select(*raw.columns, number.alias(name))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Label registry CSV; text timestamps to microseconds, no category is -1."""
    schema = ", ".join(f"`{c}` string" for c in REGISTRY_FIELDS)
    raw = in_file_order(spark.read.csv(path, header=True, schema=schema), "row_ord")
    named = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(REGISTRY_FIELDS, REGISTRY_NAMES)], "row_ord")
    return clean_registry(named)


def clean_registry(named: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).try_cast("int").alias(c)
    moment = F.unix_micros(F.to_timestamp(F.concat(F.regexp_replace("timestamp", "T", " "), F.lit("+00:00"))))
    return named.select(
        "row_ord", "flow_src_ip", number("flow_src_port"), "flow_dst_ip", number("flow_dst_port"), number("protocol"),
        moment.alias("flow_start_us"), "label",
        F.coalesce(F.col("attempted_category").try_cast("int"), F.lit(-1)).alias("attempted_category"),
    )


def read_ground_truth(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Ground-truth CSVs; a byte order mark before the first header name is ignored.

    Columns go by name, so the header is read from the files; all values stay text
    until :func:`prepare_ground_truth`.
    """
    raw = in_file_order(spark.read.csv(paths, header=True, inferSchema=False), "gt_ord")
    names = {c: c.replace(BOM, "").strip() for c in raw.columns}
    flat = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if n in (*TRUTH_FIELDS, "gt_ord")])
    missing = set(TRUTH_FIELDS) - set(flat.columns)
    if missing:
        raise ValueError(f"ground truth lacks columns {sorted(missing)}")
    return flat.select(*TRUTH_FIELDS, "gt_ord").withColumn(
        "ts", F.col("ts").try_cast("double")
    )


def clean_flow_table(raw: DataFrame, text: Sequence[str] = ("Label",)) -> DataFrame:
    """Drop repeated header rows, turn every other column into a number (bad → NULL)."""
    first = raw.columns[0]
    body = raw.where(F.col(f"`{first}`").isNull() | (F.col(f"`{first}`") != first))
    return body.select(*[
        F.col(f"`{c}`") if c in text else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns
    ])


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_flow_table(spark.read.csv(path, header=True, inferSchema=False))


def header_rows(raw: DataFrame) -> Column:
    return F.count_if(F.col(f"`{raw.columns[0]}`") == raw.columns[0])


def ingest_manifest(raw: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Rows, columns and dropped headers per source file; with ``original`` (the files
    as ``binaryFile``) also their size. ``raw`` has ``file``."""
    body = raw.drop("file")
    made = raw.groupBy("file").agg(
        (F.count(F.lit(1)) - header_rows(body)).alias("rows"), F.lit(len(body.columns)).alias("columns"),
        header_rows(body).alias("dropped_headers"),
    )
    if original is None:
        return made
    sizes = original.select(file_name("path").alias("file"), F.col("length").alias("bytes"))
    return made.join(sizes, "file", "left")


def with_size_ratio(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """Adds the written size and its ratio to the source size, per file."""
    sizes = written.select(file_name("path").alias("file"), F.col("length").alias("written_bytes"))
    ratio = F.when(F.col("written_bytes") > 0, F.col("bytes").cast("double") / F.col("written_bytes"))
    return manifest.join(sizes, "file", "left").withColumn("ratio", ratio)


def read_first_packets(spark: SparkSession, path: str, count: int, columns: Sequence[str]) -> DataFrame:
    """Grouped packets below a position; filter and columns reach the Parquet scan."""
    return spark.read.parquet(path).where(F.col("packet_index") < count).select(*columns)


def load_parts(
    spark: SparkSession, path: str, parts: Sequence[str] | None = None, cut: str | None = None,
    manifest: DataFrame | None = None, include_untrainable: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Parts of a table partitioned by ``part`` (and ``cut``); by default only parts
    the manifest calls ready for training."""
    table = spark.read.parquet(path)
    if parts is not None:
        table = table.where(F.col("part").isin(list(parts)))
    if cut is not None:
        table = table.where(F.col("cut") == cut)
    if manifest is not None and not include_untrainable:
        table = table.join(manifest.where("training_ready").select("part"), "part", "left_semi")
    return table if columns is None else table.select(*columns)


def list_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("part").distinct().orderBy("part")


def day_balance(labelled: DataFrame) -> DataFrame:
    """Rows, benign and attack rows per day, by label code."""
    return labelled.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label_encoded") == 0).alias("benign"),
        F.count_if(F.col("label_encoded") != 0).alias("attack"),
    )


def conform(df: DataFrame, template: T.StructType) -> DataFrame:
    """Template columns in order and type; missing ones are NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in template.fields
    ])


def union_parts(parts: Sequence[DataFrame], template: T.StructType | None = None) -> DataFrame:
    """One table from parts with differing columns; the first part sets the layout."""
    template = template or parts[0].schema
    shaped = [conform(p, template) for p in parts]
    out = shaped[0]
    for part in shaped[1:]:
        out = out.unionByName(part)
    return out


def bounded_files(files: DataFrame, most: int, by: str = "part") -> DataFrame:
    """The first ``most`` files of each part, by name; works on the listing only."""
    from pyspark.sql import Window

    rank = F.dense_rank().over(Window.partitionBy(by).orderBy("file"))
    return files.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
