"""Operator 11: near duplicates by MinHash with banding, verified, as connected components.

Every set of shingles gets ``PERMS`` minima of universal hashes ``(a x + b) mod 2^64 >> 32``. ``ROWS`` minima make a band,
and documents that agree in a band share a bucket: of two sets with Jaccard 0.85 the chance to share none of the
``BANDS`` is (1 - 0.85^6)^40 = 6e-9. A candidate pair must then agree in enough of all its minima (their low bytes; the bound
lies five standard deviations below the threshold), and is confirmed on the full sets. Components come from
alternating large-star and small-star steps.

1. Equal sets (128-bit sums over all shingles, and the size) are one class; only one document of a class goes on.
2. In every bucket the other classes are compared with its least one, so a bucket of n classes gives n - 1 pairs.
3. In buckets whose classes still lie in several components, all are compared with the class that agrees best with the
   bucket's most frequent minima: copies of one original are often alike only through it.
4. Buckets that are still mixed are compared inside, across components only, a pair in the first bucket it shares. A
   crowded bucket is split into blocks, whose pairs are worked on apart. A pair leaves its task only if it agrees in enough minima, and if 16 bits of every shingle allow
   the similarity: a bound that no shared shingle escapes.

So no link between different texts is lost, and groups of copies never list their pairs.

Words are runs of bytes other than white space (0x20, 0x09-0x0D) with A-Z lower-cased. Defined results: null, empty and blank texts
have no shingles and are their own component; a text with fewer words than a shingle is one shingle; equal rows are one
class; a component is named by the least doc_id in it, null where it has none; ``kept`` compares null-safely. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packetloom.llm.common import stored, whole_groups
from packetloom.llm.components import components
from packetloom.llm.hashes import mixed
from packetloom.llm.jaccard_join import Sets, enough, texts_in_sets, verified

BANDS, ROWS = 40, 6
PERMS = BANDS * ROWS
MARGIN = 0.12
CROWD = 4096
_DRAWN = np.random.default_rng(20240911).integers(0, 1 << 64, (2, PERMS), dtype=np.uint64)
FACTOR, SHIFT = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def minima(sets: Sets) -> np.ndarray:
    """(sets x PERMS) least hash values; empty sets have the greatest."""
    x = sets.hash >> np.uint64(22)
    full = np.flatnonzero(sets.sizes)
    out = np.full((len(sets.sizes), PERMS), 0xFFFFFFFF, dtype=np.uint32)
    if len(full):
        heads, room = sets.edges[full], np.empty_like(x)
        for k in range(PERMS):
            np.multiply(x, FACTOR[k], out=room)
            np.add(room, SHIFT[k], out=room)
            out[full, k] = np.minimum.reduceat(room, heads) >> np.uint64(32)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """(sets x BANDS) bucket names; a band's number is part of its names."""
    name = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for r in range(ROWS):
        name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS].astype(np.uint64))
    return name.astype(np.int64)


def alike(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether minima and sizes allow the similarity."""
    met = (a == b).sum(axis=-1, dtype=np.int64)
    return (met >= PERMS * (percent / 100 - MARGIN)) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def described(base: DataFrame, width: int) -> DataFrame:
    """(doc, doc_id, n, name_a, name_b, sig, bands) of every row of ``base``."""
    like = base.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("doc_id", like), T.StructField("n", T.LongType()), T.StructField("name_a", T.LongType()),
        T.StructField("name_b", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.BinaryType())])

    def fn(batches):
        for batch in batches:
            for part, sets in texts_in_sets(batch, 2, width):
                least = minima(sets)
                total = [np.r_[np.uint64(0), np.cumsum(mixed(sets.hash ^ np.uint64(salt)))] for salt in (0x5BD1E995, 0x27D4EB2F165667C5)]
                names = [(t[sets.edges[1:]] - t[sets.edges[:-1]]).astype(np.int64) for t in total]
                low, keys = (least & 0xFF).astype(np.uint8), bands(least)
                full = sets.sizes > 0
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1).cast(to_arrow_type(like)), pa.array(sets.sizes, pa.int64()), pa.array(names[0]), pa.array(names[1]),
                    *[pa.array([r.tobytes() if f else None for r, f in zip(rows, full)], pa.binary()) for rows in (low, keys)]], names=schema.names)

    return base.select("doc", "doc_id", "text").mapInArrow(fn, schema)


def entries(classes: DataFrame) -> DataFrame:
    """(bucket, sid, band) for every band of every class."""

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                own = batch.slice(lo, 2048)
                keys = np.frombuffer(b"".join(x.as_py() for x in own.column(1)), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), pa.array(np.repeat(np.asarray(own.column(0)), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), own.num_rows))], names=["bucket", "sid", "band"])

    return classes.select("sid", "bands").mapInArrow(fn, "bucket long, sid long, band int")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(len(column), PERMS)


def similar(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (sid, pivot) whose signatures allow the similarity."""
    own = classes.select("sid", "n", "sig")
    other = classes.select(F.col("sid").alias("pivot"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
    both = pairs.join(own, "sid").join(other, "pivot").select("sid", "pivot", "n", "n2", "sig", "sig2")

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                p = batch.slice(lo, 4096)
                ok = alike(matrix(p.column(4)), np.asarray(p.column(2)), matrix(p.column(5)), np.asarray(p.column(3)), percent)
                yield p.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(fn, "sid long, pivot long")


def _stars(percent: int):
    """Pairs of one block with its centre: the class that agrees most with the block's most frequent minima."""

    def fn(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        sid, comp, n, sig = _block_columns(rows)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for lo, hi in zip(starts, np.r_[starts[1:], rows.num_rows]):
            own = sig[lo:hi]
            seen = np.bincount((np.arange(PERMS) * 256 + own).ravel(), minlength=PERMS * 256).reshape(PERMS, 256)
            k = lo + int((own == seen.argmax(axis=1)).sum(axis=1).argmax())
            rest = np.arange(lo, hi)[comp[lo:hi] != comp[k]]
            rest = rest[alike(sig[k], n[k], sig[rest], n[rest], percent)]
            found.append(np.stack([np.maximum(sid[k], sid[rest]), np.minimum(sid[k], sid[rest])]))
        return _pair_table(found)

    return fn


def _across(percent: int):
    """Pairs of one block, or of two blocks, of different components and similar signatures, where they share no earlier band."""

    def fn(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        sid, comp, n, sig = _block_columns(rows)
        own, x, y, band = (np.asarray(rows.column(c).chunk(0)) for c in ("own", "x", "y", "band"))
        keys = np.frombuffer(b"".join(v.as_py() for v in rows.column("bands").chunk(0)), dtype=np.int64).reshape(-1, BANDS)
        codes = [np.frombuffer(v.as_buffer(), dtype=np.uint16) for v in rows.column("codes").chunk(0)]
        held = np.zeros(1 << 16, dtype=np.int64)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for lo, hi in zip(starts, np.r_[starts[1:], rows.num_rows]):
            names, size = np.unique(comp[lo:hi], return_counts=True)
            largest = names[size.argmax()]
            first = np.arange(lo, hi)
            for k in first[comp[lo:hi] != largest]:  # pairs inside the largest component are none
                rest = first[(comp[lo:hi] != comp[k]) & ((first > k) | (comp[lo:hi] == largest)) & ((x[k] == y[k]) | (own[lo:hi] != own[k]))]
                rest = rest[alike(sig[k], n[k], sig[rest], n[rest], percent)]
                rest = rest[(keys[rest] == keys[k]).argmax(axis=1) == band[k]]
                held[codes[k]] = 1
                shared = np.array([held[codes[r]].sum() for r in rest], dtype=np.int64)  # at least what the sets share
                held[codes[k]] = 0
                rest = rest[enough(shared, n[rest], n[k], percent)]
                found.append(np.stack([np.maximum(sid[k], sid[rest]), np.minimum(sid[k], sid[rest])]))
        return _pair_table(found)

    return fn


def _block_columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return (*(np.asarray(rows.column(c).chunk(0)) for c in ("sid", "comp", "n")), matrix(rows.column("sig").chunk(0)))


def _pair_table(found: list[np.ndarray]) -> pa.Table:
    both = np.concatenate(found, axis=1)
    return pa.table({"sid": pa.array(both[0], pa.int64()), "pivot": pa.array(both[1], pa.int64())})


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, sid, comp, blocks) of buckets whose classes lie in several components."""
    rows = met.select("bucket", "band", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    rows = stored(rows.select("bucket", "band", "sid", F.coalesce("component", "sid").alias("comp")), "labelled")
    sizes = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / CROWD).cast("int").alias("blocks"))
    return rows.join(sizes.where("lo != hi").select("bucket", "blocks"), "bucket").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))


def coded(base: DataFrame, sids: DataFrame, width: int) -> DataFrame:
    """(sid, codes): 16 bits of every shingle of these classes, whose matches are no fewer than the shingles shared."""

    def fn(batches):
        for batch in batches:
            for part, sets in texts_in_sets(batch, 1, width):
                low = (sets.hash & np.uint64(0xFFFF)).astype(np.uint16)
                raw = [low[lo:hi].tobytes() for lo, hi in zip(sets.edges[:-1], sets.edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["sid", "codes"])

    return base.join(sids.select(F.col("sid").alias("doc")), "doc", "left_semi").select("doc", "text").mapInArrow(fn, "sid long, codes binary")


def centre_pairs(met: DataFrame, labels: DataFrame, classes: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (sid, pivot) of each block of a mixed bucket with the block's centre, where sizes and minima allow the similarity."""
    rows = _mixed(met, labels).join(classes.select("sid", "n", "sig"), "sid").select("bucket", "own", "sid", "comp", "n", "sig")
    laid = rows.repartition("bucket", "own").sortWithinPartitions("bucket", "own")
    return laid.mapInArrow(lambda batches: whole_groups(batches, ["bucket", "own"], _stars(percent), CROWD), "sid long, pivot long").distinct()


def open_pairs(met: DataFrame, labels: DataFrame, classes: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (sid, pivot) of different components that share a bucket, where sizes, minima and codes allow the similarity; each in one bucket only."""
    rows = stored(_mixed(met, labels), "mixed")
    codes = coded(base, rows.select("sid").distinct(), width)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # each block meets itself and every other
    placed = rows.select("bucket", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "sid", "comp")
    laid = placed.join(classes.select("sid", "n", "sig", "bands"), "sid").join(codes, "sid").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return laid.mapInArrow(lambda batches: whole_groups(batches, ["bucket", "x", "y"], _across(percent), CROWD), "sid long, pivot long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    # the number of a row is fixed once it is written
    base = stored(docs.select(F.monotonically_increasing_id().alias("doc"), F.lit(0).alias("key"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "base")
    rows = stored(described(base, width), "minima")
    full = rows.where("n > 0")
    heads = stored(full.groupBy("name_a", "name_b", "n").agg(F.min("doc").alias("sid")), "classes")
    classes = stored(full.join(heads.select(F.col("sid").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("sid"), "n", "sig", "bands"), "signatures")
    points = classes.select("sid", F.col("sid").alias("doc"), F.lit(0).alias("key"))
    places = entries(classes)
    shared = places.groupBy("bucket").agg(F.min("sid").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("bucket", "pivot")
    met = stored(places.join(shared, "bucket"), "met")
    # texts are fetched again below, but only of classes that met another
    texts = stored(base.join(met.select(F.col("sid").alias("doc")).distinct(), "doc", "left_semi").select("doc", "key", "doc_id", "text"), "texts")
    stars = stored(met.where("sid != pivot").select("sid", "pivot").distinct(), "stars")
    linked = stored(verified(stored(similar(stars, classes, percent), "near"), points, texts, width, percent), "linked")
    asked = stars
    for pairs in (centre_pairs, open_pairs):
        labels = components(linked)
        fresh = stored(pairs(met, labels, classes, texts, width, percent).join(asked, ["sid", "pivot"], "left_anti"), "pairs")
        linked = stored(linked.unionByName(verified(fresh, points, texts, width, percent)), "linked")
        asked = asked.unionByName(fresh)
    labels = components(linked)
    members = stored(full.select("doc", "doc_id", "name_a", "name_b", "n").join(heads, ["name_a", "name_b", "n"]).select("doc_id", "n", "sid"), "members")
    # names are found per class first, so that a component of many classes is not one join key of all its documents
    least = members.groupBy("sid").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    least = stored(least.select("sid", "least", F.coalesce("component", "sid").alias("comp")), "least")
    named = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("sid", "component_id")
    found = members.join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
