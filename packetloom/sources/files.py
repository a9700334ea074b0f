"""File listings: captures by name, parts, integrity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.classes import class_from_path, part_from_path
from packetloom.sources.frames import open_capture, spread
from packetloom.sources.tables import file_name

# What a capture's name looks like besides having no suffix.
CAPTURE_SUFFIX = r"(?i)\.(pcap|pcapng|cap)$"
NUMBERED_SUFFIX = r"\.[0-9]+$"
MULTIPART_NAME = r"(?i)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[- ]*part *[0-9]+$"

# First bytes of capture files.
MAGICS = {"0A0D0D0A": "pcapng", "D4C3B2A1": "pcap", "A1B2C3D4": "pcap", "4D3CB2A1": "pcap", "A1B23C4D": "pcap"}


AUDIT_BLOCK = 8 << 20


def is_capture_name(name: Column) -> Column:
    base = F.element_at(F.split(name, "/"), -1)
    no_suffix = ~base.rlike(r".\.[^.]+$")
    return no_suffix | base.rlike(CAPTURE_SUFFIX) | base.rlike(MULTIPART_NAME) | base.rlike(NUMBERED_SUFFIX)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file, part, class, bytes; only metadata is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(
        "path", file_name("path").alias("file"), F.col("length").alias("bytes"),
        part_from_path("path").alias("part"), class_from_path("path").alias("class"),
    )


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    return list_files(spark, path).where(is_capture_name(F.col("file")))


def parts_with_captures(spark: SparkSession, path: str, by: str = "class") -> DataFrame:
    """Scenarios, days or classes that have at least one capture."""
    return list_captures(spark, path).groupBy(by).agg(
        F.count(F.lit(1)).alias("captures"), F.sum("bytes").alias("bytes")
    ).orderBy(by)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MD5 and first bytes of every file, read block by block."""
    for batch in batches:
        for path, size in zip(batch["path"], batch["bytes"]):
            digest, magic = hashlib.md5(), b""
            with open_capture(path) as stream:
                while block := stream.read(AUDIT_BLOCK):
                    magic = magic or block[:4]
                    digest.update(block)
            yield pd.DataFrame([(path, size, digest.hexdigest(), magic.hex().upper())], columns=["path", "bytes", "found_md5", "magic"])


def audit_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Size, kind and MD5 against ``expected`` (file, md5); files of any size."""
    found = list_files(spark, path).select("path", "bytes").repartition(spread(spark))
    facts = found.mapInPandas(_digest, "path string, bytes long, found_md5 string, magic string").select(
        file_name("path").alias("file"), "bytes", "found_md5", "magic"
    )
    kinds = F.create_map(*[F.lit(x) for kv in MAGICS.items() for x in kv])
    return expected.join(facts, "file", "left").withColumns({
        "kind": F.coalesce(F.try_element_at(kinds, F.col("magic")), F.lit("other")),
        "intact": F.coalesce(F.lower("md5") == F.col("found_md5"), F.lit(False)),
    })
