"""Frames out of capture files (pcap and pcapng).

A capture can be large and cannot be cut blindly, so reading takes two passes: a
light walk over the record headers notes a restart point every ``range_bytes``, then
the ranges are decoded in parallel. Only IPv4 frames are numbered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.header_bytes import strip_link
from packetloom.sources.tables import file_name

RANGE_BYTES = 128 << 20
PCAPNG_MAGIC = 0x0A0D0D0A
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
PEEK = 22
IPV4, VLAN, COOKED = 0x0800, 0x8100, 113
ROWS_PER_BATCH = 4096

RANGE_SCHEMA = (
    "path string, start long, stop long, first_ordinal long, order string, nanos boolean, "
    "links array<int>, ticks array<long>"
)
FRAME_SCHEMA = "path string, capture_packet_index long, ts_us long, link_type int, frame binary"


def open_capture(path: str):
    if re.match(r"^file:/+", path):
        path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        filesystem, inner = pafs.FileSystem.from_uri(path)
        return filesystem.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def is_ipv4(head: bytes, link: int) -> bool:
    at = 14 if link == COOKED else 12
    if len(head) < at + 2:
        return False
    kind = int.from_bytes(head[at:at + 2], "big")
    if kind == VLAN and len(head) >= at + 6:
        kind = int.from_bytes(head[at + 4:at + 6], "big")
    return kind == IPV4


class Walker:
    """Steps through the records of one capture from a restart point."""

    def __init__(self, stream, order="<", nanos=False, links=(), ticks=()):
        self.stream, self.order, self.nanos = stream, order, nanos
        self.links, self.ticks = list(links), list(ticks)

    def open(self) -> int:
        """Read the file header; offset of the first record, or -1 for no capture."""
        head = self.stream.read(24)
        if len(head) < 24:
            return -1
        self.ng = int.from_bytes(head[:4], "little") == PCAPNG_MAGIC
        if self.ng:
            return 0
        for order in "<>":
            magic = struct.unpack(order + "I", head[:4])[0]
            if magic in (0xA1B2C3D4, 0xA1B23C4D):
                self.order, self.nanos = order, magic == 0xA1B23C4D
                self.links = [struct.unpack(order + "I", head[20:24])[0] & 0xFFFF]
                self.ticks = []
                return 24
        return -1

    def records(self, start: int, stop: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(record offset, next offset, data offset, data length, (ts, link)) per frame."""
        self.ng = bool(self.ticks) or getattr(self, "ng", False)
        return self._blocks(start, stop) if self.ng else self._records(start, stop)

    def _at(self, offset: int, count: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(count)

    def _records(self, at, stop):
        while at < stop:
            head = self._at(at, 16)
            if len(head) < 16:
                return
            seconds, part, size, _ = struct.unpack(self.order + "IIII", head)
            ts = seconds * 1_000_000 + (part // 1000 if self.nanos else part)
            yield at, at + 16 + size, at + 16, size, ts, self.links[0]
            at += 16 + size

    def _blocks(self, at, stop):
        while at < stop:
            head = self._at(at, 28)
            if len(head) < 12:
                return
            kind = struct.unpack(self.order + "I", head[:4])[0]
            if kind == SECTION:
                self.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
                self.links, self.ticks = [], []
            size = struct.unpack(self.order + "I", head[4:8])[0]
            if size < 12:
                return
            if kind == INTERFACE:
                body = self._at(at + 8, size - 12)
                self.links.append(struct.unpack(self.order + "H", body[:2])[0])
                self.ticks.append(self._resolution(body[8:]))
            elif kind == ENHANCED and len(head) == 28:
                which, high, low, length = struct.unpack(self.order + "IIII", head[8:24])
                ticks = self.ticks[which] if which < len(self.ticks) else 1_000_000
                ts = ((high << 32) | low) * 1_000_000 // ticks
                link = self.links[which] if which < len(self.links) else 1
                yield at, at + size, at + 28, length, ts, link
            elif kind == SIMPLE:
                length = min(struct.unpack(self.order + "I", head[8:12])[0], size - 16)
                yield at, at + size, at + 12, length, None, self.links[0] if self.links else 1
            at += size

    def _resolution(self, options: bytes) -> int:
        at = 0
        while at + 4 <= len(options):
            code, length = struct.unpack(self.order + "HH", options[at:at + 4])
            if code == 9 and length:
                value = options[at + 4]
                return 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
            if code == 0:
                break
            at += 4 + (length + 3) // 4 * 4
        return 1_000_000


def _cut_ranges(range_bytes: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open_capture(path) as stream:
                    yield _ranges_of(path, stream, range_bytes)
    return walk


def _ranges_of(path, stream, range_bytes) -> pd.DataFrame:
    walker, rows = Walker(stream), []
    start = walker.open()
    ordinal = begin = 0
    state = None

    def mark(offset):
        nonlocal begin, state
        begin = offset
        state = (ordinal, walker.order, walker.nanos, list(walker.links), list(walker.ticks))

    def close(stop):
        rows.append((path, begin, stop, *state))

    if start >= 0:
        mark(start)
        after = start
        for at, after, data, length, _, link in walker.records(start, 1 << 62):
            if at - begin >= range_bytes:
                close(at)
                mark(at)
            ordinal += is_ipv4(walker._at(data, min(length, PEEK)), link)
        close(after)
    return pd.DataFrame(rows, columns=["path", "start", "stop", "first_ordinal", "order", "nanos", "links", "ticks"])


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "capture_packet_index", "ts_us", "link_type", "frame"]
    for batch in batches:
        for span in batch.itertuples(index=False):
            rows, ordinal = [], span.first_ordinal
            with open_capture(span.path) as stream:
                walker = Walker(stream, span.order, span.nanos, span.links, span.ticks)
                walker.ng = int.from_bytes(stream.read(4), "little") == PCAPNG_MAGIC
                for _, _, data, length, ts, link in walker.records(span.start, span.stop):
                    frame = walker._at(data, length)
                    if not is_ipv4(frame[:PEEK], link):
                        continue
                    rows.append((span.path, ordinal, ts, link, frame))
                    ordinal += 1
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def spread(spark: SparkSession) -> int:
    """An explicit number of partitions: rows here are a few bytes that stand for megabytes, so they must not be merged."""
    return max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def capture_ranges(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Restart points of every capture; ``files`` has ``path``."""
    return files.select("path").repartition(spread(spark)).mapInPandas(_cut_ranges(range_bytes), RANGE_SCHEMA)


def read_frames(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, max_packets: int | None = None) -> DataFrame:
    """IPv4 frames of all captures below ``path``: capture_file, ordinal, time, link
    type, the frame and its IP packet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ranges = capture_ranges(spark, files, range_bytes)
    if max_packets is not None:
        ranges = ranges.where(F.col("first_ordinal") < max_packets)
    frames = ranges.repartition(spread(spark), "path", "start").mapInPandas(_decode, FRAME_SCHEMA)
    if max_packets is not None:
        frames = frames.where(F.col("capture_packet_index") < max_packets)
    return frames.select(
        file_name("path").alias("capture_file"), "capture_packet_index", "ts_us", "link_type", "frame",
        strip_link(F.col("frame"), F.col("link_type")).alias("ip_bytes"),
    )
