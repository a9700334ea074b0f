"""What the operators of this package share: written intermediates and Arrow streams of bounded pieces."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import scratch_path

PIECE_BYTES = 1 << 20
#: Private memory that an idle Python worker may keep.
IDLE_BYTES = 128 << 20


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read again: short lineage, known size."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the next longer one that no column of ``df`` has, however it is spelled."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Shared:
    """A value broadcast by value, code included, and unpacked once per Python worker, so it may keep what it learns."""

    def __init__(self, spark: SparkSession, value: object):
        self.box = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    @property
    def value(self):
        box = self.box.value
        if isinstance(box[0], bytes):
            box[0] = cloudpickle.loads(box[0])
        return box[0]


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text counts as empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each; a longer row stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    group = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def by_piece(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES):
    """A ``mapInArrow`` function which calls ``fn`` on pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, most):
                yield fn(part)

    return run


def private_bytes() -> int:
    """Memory of this process without shared pages; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as told:
            _, resident, shared = map(int, told.read().split()[:3])
    except OSError:
        return 0
    return (resident - shared) * os.sysconf("SC_PAGE_SIZE")


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn`` for ``mapInArrow``, whose worker gives freed memory back to the system when the task ends, if it holds more
    than ``IDLE_BYTES``: workers outlive their tasks, and what idle ones keep counts beside the next stage's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            if private_bytes() > IDLE_BYTES:
                pa.default_memory_pool().release_unused()
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
                if trim:
                    trim(0)

    return run


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths over one flat array."""
    edges = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values, type=kind))


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of ``batch`` followed by new ones."""
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keep] + list(new.values())
    return pa.RecordBatch.from_arrays(columns, names=[*keep, *new])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Calls ``fn(table, starts of the groups)`` on tables of whole groups of about ``rows`` rows, from batches sorted by ``keys``."""
    from packetloom.operators.ordered import key_starts

    held: list[pa.RecordBatch] = []
    size, wanted = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = key_starts(table, keys)
        last = int(starts[-1])
        if last:
            yield from fn(table.slice(0, last).combine_chunks(), starts[:-1]).combine_chunks().to_batches(65_536)
        rest = table.slice(last)
        held, size = rest.to_batches(), rest.num_rows
        wanted = max(rows, 2 * size)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from fn(table, key_starts(table, keys)).combine_chunks().to_batches(65_536)
