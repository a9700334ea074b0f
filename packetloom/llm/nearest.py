"""Operator 6: approximate nearest neighbours by cross-polytope hashing.

Candidates are parted into bands of norms between two powers of two, so that within a band the
largest inner product is nearly the nearest direction, and every query visits every band.
Vectors are brought to unit length, padded to a power of two and turned by three rounds of
random signs and fast Hadamard transforms. The nearest signed axis is the bucket; each table
has its own signs. A query visits, in every table and band, the ``PROBES`` signed axes nearest
to it, and ``SHARE`` of the axes at least. Candidates met are scored exactly, in double
precision, on the original vectors, and the best are merged over tables and bands. Queries that
met fewer candidates than they can return are scored against all of them, in blocks.

Equal vectors are reduced to as many copies as one query can return before hashing. Rows of
a table lie in groups of neighbouring buckets; a group with more than ``BLOCK`` candidates is
split by vec_id, and queries are sent in blocks too, so no task holds more than
BLOCK candidates and BLOCK queries however a bucket fills. The number of groups (tables x
groups x bands, of which doubles have 2098 at most) is fixed, so their counts may be broadcast.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part; only vectors of one length are compared with each other; ties go to the
smaller vec_id; repeated vec_ids of a vector count once; fewer candidates than asked for give
them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import list_column, stored

TABLES, PROBES, SHARE, GROUPS = 4, 48, 3 / 8, 8
BLOCK = 4096


def turned(x: np.ndarray, table: int) -> np.ndarray:
    """Rows of ``x`` (unit, padded to a power of two) after the table's pseudo-rotation."""
    d = x.shape[1]
    signs = np.random.default_rng(7919 * table + d).integers(0, 2, (3, d)) * 2.0 - 1
    for flips in signs:
        x = x * flips
        width = 1
        while width < d:  # fast Hadamard transform
            pairs = x.reshape(len(x), -1, 2, width)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), d)
            width *= 2
        x = x / np.sqrt(d)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, padded to a power of two."""
    n, d = x.shape
    out = np.zeros((n, 1 << (d - 1).bit_length()))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the largest doubles are not finite
    out[:, :d] = x / np.linalg.norm(x, axis=1)[:, None]
    return out


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row: axis i is bucket i, its opposite i + d."""
    signed = np.concatenate([y, -y], axis=1)
    probes = min(probes, signed.shape[1])
    return np.argpartition(-signed, probes - 1, axis=1)[:, :probes] if probes > 1 else signed.argmax(axis=1)[:, None]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec, dim, band) of the vectors that take part; the band is the norm's power of two."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    # double the component, since infinity less itself is not a number and null stays null
    sound = rows.where(F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    band = F.floor(F.log2(F.least("norm", F.lit(1.7e308)))).cast("int")
    return sound.withColumn("dim", F.size("vec")).withColumn("norm", norm).where("norm > 0").withColumn("band", band).drop("norm")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors).dropDuplicates(["vec_id", "vec"])
    place = Window.partitionBy("vec").orderBy("vec_id")
    # a vector's copies score alike, so no query can return more than its k smallest ids besides itself
    points = stored(rows.withColumn("copy", F.row_number().over(place)).where(F.col("copy") <= k + 1).drop("copy"), "points")
    asked = stored(rows.where(F.col("vec_id") % every == 0), "queries")

    def hashed(query: bool):
        def fn(batches):
            for batch in batches:
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    for lo in range(0, part.num_rows, 512):
                        yield from hash_part(part.slice(lo, 512))

        def hash_part(part: pa.RecordBatch):
            base = unit(_matrix(part.column(1)))
            span = -(-2 * base.shape[1] // GROUPS)
            visits = max(probes, round(SHARE * 2 * base.shape[1])) if query else 1
            for table in range(tables):
                found = np.sort(axes(turned(base, table), visits), axis=1)
                where, group = np.repeat(np.arange(len(base)), found.shape[1]), found.ravel() // span
                starts = np.flatnonzero(np.r_[True, (np.diff(where) != 0) | (np.diff(group) != 0)])
                lengths = np.diff(np.r_[starts, len(where)])
                at = pa.array(where[starts])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in part.columns), pa.array(np.full(len(starts), table, dtype=np.int32)),
                     pa.array(group[starts].astype(np.int32)), list_column(found.ravel().astype(np.int32), lengths, pa.int32())],
                    names=["vec_id", "vec", "dim", "band", "part", "grp", "buckets"])

        return fn

    schema = "vec_id long, vec array<double>, dim int, band int, part int, grp int, buckets array<int>"
    index = points.select("vec_id", "vec", "dim", "band").mapInArrow(hashed(False), schema)
    probe = asked.select("vec_id", "vec", "dim", "band").mapInArrow(hashed(True), schema).drop("band")  # a query visits all bands
    best = _best(index, probe, k)
    merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = _completed(stored(merged, "met"), points, asked, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _completed(merged: DataFrame, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``merged``, with queries that met fewer than k candidates, and fewer than there are, scored against all of their length."""
    ids = points.groupBy("dim").agg(F.count_distinct("vec_id").alias("ids"))
    there = asked.select("vec_id", "dim").distinct().join(F.broadcast(ids), "dim").groupBy("vec_id").agg(F.sum(F.col("ids") - 1).alias("there"))
    met = merged.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("met"))
    lacking = there.join(met, "vec_id", "left").where(F.coalesce("met", F.lit(0)) < F.least("there", F.lit(k)))
    short = stored(asked.join(lacking.select("vec_id"), "vec_id", "left_semi"), "short")
    if short.isEmpty():
        return merged
    one = {"part": F.lit(0), "grp": F.lit(0), "buckets": F.array(F.lit(0))}  # a single bucket for all
    whole = _best(points.withColumns(one), short.drop("band").withColumns(one), k)
    return merged.unionByName(whole).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _best(index: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every block of candidates that a query visits."""
    cell = ["dim", "part", "grp"]
    counts = lambda df, keys, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cells = counts(index, [*cell, "band"], "rows").join(counts(probe, cell, "asks"), cell)
    cells = F.broadcast(stored(cells, "cells"))  # lengths x bands x tables x groups rows
    salt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(17)), F.col(n)).cast("int")
    keys = [*cell, "band", "row_block", "ask_block"]
    left = index.join(cells, [*cell, "band"]).withColumn("row_block", salt("rows")).withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    right = probe.join(cells, cell).withColumn("ask_block", salt("asks")).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    take = [*keys, "vec_id", "vec", "buckets"]
    return left.select(*take).groupBy(*keys).cogroup(right.select(*take).groupBy(*keys)).applyInArrow(
        lambda a, b: _block_best(a, b, k), "query_id long, vec_id long, score double")


def _block_best(rows: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """The k best candidates of each query among those in buckets that it probes."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not rows.num_rows or not asks.num_rows:
        return empty
    rows, asks = rows.combine_chunks(), asks.combine_chunks()
    x, q = _matrix(rows["vec"].chunk(0)), _matrix(asks["vec"].chunk(0))
    ids, names = rows["vec_id"].to_numpy(), asks["vec_id"].to_numpy()
    bucket = rows["buckets"].chunk(0).flatten().to_numpy()
    lists = asks["buckets"].chunk(0)
    wide = int(max(bucket.max(), lists.flatten().to_numpy().max())) + 1
    probed = np.zeros((len(q), wide), dtype=bool)
    probed[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    parts = []
    for lo in range(0, len(q), 256):
        near = np.where(probed[lo:lo + 256][:, bucket] & (ids[None, :] != names[lo:lo + 256, None]), q[lo:lo + 256] @ x.T, -np.inf)
        if near.shape[1] > k:
            edge = -np.partition(-near, k - 1, axis=1)[:, k - 1:k]
            slack = np.abs(np.where(np.isfinite(edge), edge, 0)) * 1e-9 + 1e-12  # matrix products round differently by place
            near = np.where(near >= edge - slack, near, -np.inf)
        a, b = np.nonzero(np.isfinite(near))
        exact = np.zeros(len(a))
        for c in range(x.shape[1]):  # one order of summation for every pair, so that ties are ties
            exact += q[lo + a, c] * x[b, c]
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        starts = np.flatnonzero(np.r_[True, np.diff(a) != 0]) if len(a) else a
        top = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)])) < k
        parts.append(pa.table({"query_id": names[lo + a[top]], "vec_id": ids[b[top]], "score": exact[top]}))
    return pa.concat_tables(parts)
