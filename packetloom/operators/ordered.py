"""Ordered work inside keys that may hold any share of the data.

Two helpers carry every operator that needs an order:

``ordered_fold``
    runs a vectorised kernel over rows sorted within their key. Keys of ordinary
    size are hash-partitioned and streamed. A key larger than ``max_key_rows`` is
    cut into range-partitioned chunks which run in parallel; the little state
    that crosses a chunk edge is handed over explicitly.

``ranked_within``
    numbers rows inside a key without sorting the key in one task: rows are
    counted per order-preserving bucket, and only the rows of one bucket are
    ever sorted together.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.session import scratch_path

MAX_KEY_ROWS = 4_000_000
#: Rows that a kernel is given at once, unless one key has more: what a Python worker holds follows this, not the input.
BLOCK_ROWS = 32_768
CHUNK = "_chunk"


class Kernel:
    """What a fold does with sorted rows. Instances travel to the tasks."""

    def __call__(self, table: pa.Table, starts: np.ndarray, carry, open_end: bool):
        """``(output table, state of the last key)``.

        ``starts`` are the offsets at which keys start. ``carry`` is the state left
        by earlier rows of the first key, None when that key starts here;
        ``open_end`` says that the last key may go on in a later chunk.
        """
        raise NotImplementedError

    def reset(self, table: pa.Table) -> int | None:
        """In rows of ONE key, the last one whose outcome needs nothing before it."""
        raise NotImplementedError


def key_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Offsets at which any key column differs from the row above."""
    rows = table.num_rows
    changed = np.zeros(rows, dtype=bool)
    changed[0] = True
    for name in keys:
        column = table.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, rows - 1))
        changed[1:] |= np.asarray(differs.to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(changed)


def _stream(batches: Iterator[pa.RecordBatch], keys, kernel: Kernel, schema: pa.Schema):
    """Feed whole keys to the kernel in blocks, whatever the batch edges are.

    A key that fills a block is looked at again only when the rows held have doubled, so
    the work stays linear in the rows of a long key.
    """
    held: list[pa.RecordBatch] = []
    held_rows, wanted = 0, BLOCK_ROWS

    def emit(table: pa.Table, starts: np.ndarray):
        """Whole keys, a block of rows at a time; a long key goes alone."""
        edges, at = np.append(starts, table.num_rows), 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK_ROWS, side="right")) - 1)
            first = int(edges[at])
            block = table.slice(first, int(edges[upto]) - first).combine_chunks()
            out, _ = kernel(block, starts[at:upto] - first, None, False)
            yield from out.select(schema.names).cast(schema).combine_chunks().to_batches(65_536)
            at = upto

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        held_rows += batch.num_rows
        if held_rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = key_starts(table, keys)
        last = int(starts[-1])
        if last == 0:
            held, wanted = table.to_batches(), 2 * held_rows
            continue
        yield from emit(table.slice(0, last), starts[:-1])
        # a copy, so that the rows before it can go
        rest = table.slice(last).combine_chunks()
        held, held_rows = rest.to_batches(), rest.num_rows
        wanted = max(BLOCK_ROWS, 2 * held_rows)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from emit(table, key_starts(table, keys))


def heavy_keys(df: DataFrame, keys: Sequence[str], max_key_rows: int) -> DataFrame | None:
    """Keys above the limit, or None. At most rows/limit keys can come back; the count
    reads the key columns only and is combined before its shuffle."""
    heavy = df.groupBy(*keys).count().where(F.col("count") > max_key_rows).select(*keys)
    found = heavy.collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, heavy.schema)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: computed once, safe
    against lost executors, for inputs that are read several times."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    kernel: Kernel,
    schema: T.StructType,
    max_key_rows: int = MAX_KEY_ROWS,
    finish_heavy: Callable[[DataFrame], DataFrame] = lambda out: out,
    fold_heavy: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Apply ``kernel`` to ``df`` sorted by ``order`` within ``keys``.

    ``fold_heavy`` folds the keys above the limit (by default chunk after chunk where no reset parts
    them); ``finish_heavy`` completes values of those keys that no single chunk knows.
    """
    keys, order = list(keys), list(order)
    arrow_schema = to_arrow_schema(schema)

    def light(part: DataFrame) -> DataFrame:
        # Hashed, not plain keys: a shuffle by the plain keys may be dropped in favour of
        # one a join below already made, and that one the adaptive planner may read
        # locally or split, since nothing tells it that whole keys are needed here.
        ordered = part.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
        return ordered.mapInArrow(lambda it: _stream(it, keys, kernel, arrow_schema), schema)

    heavy = heavy_keys(df, keys, max_key_rows)
    if heavy is None:
        return light(df)
    cold = df.join(heavy, keys, "left_anti").select(*df.columns)
    hot = df.join(heavy, keys, "left_semi").select(*df.columns)
    folded = (fold_heavy or _fold_in_turn)(hot, keys, order, kernel, schema, max_key_rows)
    return light(cold).unionByName(finish_heavy(folded))


def frozen_chunks(hot: DataFrame, keys, order, max_key_rows: int) -> DataFrame:
    """``hot`` in range-partitioned chunks under ``CHUNK``, written so that their edges never move."""
    chunks = max(2, math.ceil(hot.count() / max(1, max_key_rows // 2)))
    ranged = hot.repartitionByRange(chunks, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return stored(ranged, "chunks")


def sorted_rows(table: pa.Table, keys, order) -> tuple[pa.Table, np.ndarray]:
    """A chunk in order, and the offsets at which its keys start."""
    table = table.sort_by([(c, "ascending") for c in [*keys, *order]]).combine_chunks()
    return table, key_starts(table, keys)


def _fold_in_turn(hot, keys, order, kernel, schema, max_key_rows) -> DataFrame:
    """Chunked fold: settle the state at the chunks' edges, run all."""
    spark = hot.sparkSession
    arrow_schema = to_arrow_schema(schema)
    frozen = frozen_chunks(hot, keys, order, max_key_rows)

    def tidy(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        return sorted_rows(table, keys, order)

    def key_at(table: pa.Table, row: int) -> tuple:
        return tuple(table.column(c)[row].as_py() for c in keys)

    edge_schema = "chunk int, first_key binary, last_key binary, settled boolean, state binary"
    edge_arrow = pa.schema(
        [("chunk", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()),
         ("settled", pa.bool_()), ("state", pa.binary())]
    )

    def edge_row(chunk, first, last, settled, state) -> pa.Table:
        values = [[chunk], [pickle.dumps(first)], [pickle.dumps(last)], [settled], [pickle.dumps(state)]]
        return pa.Table.from_arrays(
            [pa.array(v, type=f.type) for v, f in zip(values, edge_arrow)], schema=edge_arrow
        )

    def beside(states: dict) -> DataFrame:
        """(chunk, state) as a table: states go to the tasks by a join, whatever their size."""
        rows = [(chunk, bytearray(pickle.dumps(state))) for chunk, state in states.items()]
        return spark.createDataFrame(rows, f"{CHUNK} int, state binary")

    def with_states(part: DataFrame, states: dict, work, out_schema) -> DataFrame:
        """``work(table, state)`` for every chunk of ``part``."""
        def meet(table: pa.Table, held: pa.Table) -> pa.Table:
            return work(table, pickle.loads(held.column("state")[0].as_py()))
        return part.groupBy(CHUNK).cogroup(beside(states).groupBy(CHUNK)).applyInArrow(meet, out_schema)

    def survey(table: pa.Table) -> pa.Table:
        """State after a chunk when it can be known without the chunk before."""
        chunk = table.column(CHUNK)[0].as_py()
        table, starts = tidy(table)
        tail_at = int(starts[-1])
        settled, state = tail_at > 0, None
        tail = table.slice(tail_at).combine_chunks()
        if not settled:
            cut = kernel.reset(tail)
            if cut is not None:
                tail, settled = tail.slice(cut).combine_chunks(), True
        if settled:
            _, state = kernel(tail, np.array([0]), None, True)
        return edge_row(chunk, key_at(table, 0), key_at(table, table.num_rows - 1), settled, state)

    edges = {}
    for row in frozen.groupBy(CHUNK).applyInArrow(survey, edge_schema).collect():
        edges[row["chunk"]] = {
            "first": pickle.loads(row["first_key"]), "last": pickle.loads(row["last_key"]),
            "settled": row["settled"], "state": pickle.loads(row["state"]),
        }
    present = sorted(edges)
    before = {c: present[i - 1] for i, c in enumerate(present) if i}

    def carry_into(chunk):
        """(known, state) at the start of a chunk."""
        prev = before.get(chunk)
        if prev is None or edges[prev]["last"] != edges[chunk]["first"]:
            return True, None
        return edges[prev]["settled"], edges[prev]["state"]

    while True:
        ready = {}
        for chunk in present:
            if not edges[chunk]["settled"]:
                known, state = carry_into(chunk)
                if known:
                    ready[chunk] = state
        if not ready:
            break

        def settle(table: pa.Table, carry) -> pa.Table:
            chunk = table.column(CHUNK)[0].as_py()
            table, starts = tidy(table)
            _, state = kernel(table, starts, carry, True)
            key = key_at(table, 0)
            return edge_row(chunk, key, key, True, state)

        pending = frozen.where(F.col(CHUNK).isin(list(ready)))
        for row in with_states(pending, ready, settle, edge_schema).collect():
            edges[row["chunk"]].update(settled=True, state=pickle.loads(row["state"]))

    carries = {c: carry_into(c)[1] for c in present}

    def run(table: pa.Table, carry) -> pa.Table:
        table, starts = tidy(table)
        out, _ = kernel(table, starts, carry, True)
        return out.select(arrow_schema.names).cast(arrow_schema)

    return with_states(frozen, carries, run, schema)


def ranked_within(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str,
    size_name: str | None = None,
) -> DataFrame:
    """1-based rank of each row within ``by``, ordered by ``order``; ``size_name`` also
    adds the number of rows within ``by``.

    ``bucket`` must not decrease along ``order``. Bucket counts are pre-aggregated,
    so a key with a third of the rows is spread over all of its buckets.
    """
    by = list(by)
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wholes = [F.sum("_n").over(Window.partitionBy(*by)).alias(size_name)] if size_name else []
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *wholes
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_bucket", "_before", "_at")
    )
