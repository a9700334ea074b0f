"""Operator 3: benchmark decontamination by size-partitioned MinHash containment.

Test items are partitioned by their number of word shingles into powers of two. The MinHash
signature of an item is its k smallest shingle hashes, with k set by the partition so that
a document which contains at least ``threshold`` of the item must hold one of them
(k > (1 - threshold) x the partition's upper size). A document is probed with all of its
shingle hashes up to the largest signature value, so the search loses nothing, however long the
document: banded signatures of whole documents would, since a short item is a tiny share of a
long document. Candidates are verified by exact shingles, as strings, and their
share of the item's shingles is returned. DataFrame functions only.

Shingles are made inside generated code: a document's word array is indexed by position and
only the hashes that pass the bound leave the row. Signatures are written first, so
the planner knows their size and broadcasts them only below its threshold. Documents without a
candidate are never shuffled once that holds for the candidates too.

Words are runs of letters and digits, lower-cased. Defined results: items and documents that
are null or without words match nothing; an item with fewer words than a shingle is one
shingle of its own length; items with equal item_id are judged one by one and the best is
reported; rows with equal doc_id likewise; null ids are kept as ids; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stored

WIDTH, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle(width: int) -> Column:
    """Hash of the words i .. i + width - 1 of ``w``."""
    return F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(width)])


def _shingles(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One row per position with its hash; the words stay in the row for those who need them."""
    ready = rows.where(F.size("w") >= width)
    placed = ready.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("i"))
    return placed.select(*keys, "w", "i", _shingle(width).alias("h"))


def _spelled(width: int) -> Column:
    return F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(width)])


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_key, width, n, h, s): the distinct shingles of every item."""
    base = items.select(F.col(item_id).alias("item_id"), F.xxhash64(text).alias("item_key"), words(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    parts = [base.where(F.size("w") >= WIDTH).transform(_shingles, ["item_id", "item_key"], WIDTH).select("item_id", "item_key", F.lit(WIDTH).alias("width"), "h", _spelled(WIDTH).alias("s"))]
    for width in range(1, WIDTH):
        short = base.where(F.size("w") == width)
        parts.append(_shingles(short, ["item_id", "item_key"], width).select("item_id", "item_key", F.lit(width).alias("width"), "h", _spelled(width).alias("s")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = union.distinct()
    return union.withColumn("n", F.count("*").over(Window.partitionBy("item_id", "item_key")))


def signatures(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(width, h, item_id, item_key): the k smallest hashes of each item, k by size partition."""
    upper = F.pow(F.lit(2), F.ceil(F.log2("n")))
    k = F.floor((1 - threshold) * upper + F.lit(1e-9)) + 1
    order = Window.partitionBy("item_id", "item_key").orderBy("h", "s")
    return shingles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("width", "h", "item_id", "item_key")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_key, item_id, n_item, n_shared, containment) of every pair at or above ``threshold``."""
    shingles = stored(item_shingles(items), "item-shingles")
    signed = stored(signatures(shingles, threshold), "signatures")
    bounds = signed.groupBy("width").agg(F.max("h").alias("h")).collect()  # at most WIDTH rows
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("doc_key"), F.col(text).alias("text")).where("text is not null")
    keys, item = ["doc_id", "doc_key"], ["item_id", "item_key"]
    worded = base.select(*keys, words(F.col("text")).alias("w"))
    found = docs.sparkSession.createDataFrame([], base.select(*keys).join(signed.select(*item)).schema)
    for row in bounds:
        probes = _shingles(worded, keys, row["width"]).where(F.col("h") <= row["h"]).select(*keys, "h")
        found = found.unionByName(probes.join(signed.where(F.col("width") == row["width"]).drop("width"), "h").select(*keys, *item))
    candidates = stored(found.distinct(), "candidates")
    held = candidates.select(F.col("doc_id").alias("c_id"), F.col("doc_key").alias("c_key")).distinct()
    suspects = base.join(held, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key")), "left_semi")
    suspects = suspects.select(*keys, words(F.col("text")).alias("w"))
    shared = docs.sparkSession.createDataFrame([], suspects.select(*keys).join(shingles.select(*item, "n", "s")).schema)
    for row in bounds:
        own = shingles.where(F.col("width") == row["width"]).select(*item, "n", "s", F.col("h").alias("item_h"))
        spelled = _shingles(suspects, keys, row["width"]).join(own, F.col("h") == F.col("item_h")).where(_spelled(row["width"]) == F.col("s"))
        shared = shared.unionByName(spelled.select(*keys, *item, "n", "s"))
    counted = shared.groupBy(*keys, *item, "n").agg(F.countDistinct("s").alias("n_shared"))
    close = counted.withColumn("containment", F.col("n_shared") / F.col("n")).where(F.col("n_shared") >= threshold * F.col("n") - 1e-9)
    return close.select(*keys, "item_id", F.col("n").alias("n_item"), "n_shared", "containment")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the best of each pair of ids."""
    best = F.max(F.struct("containment", "n_shared", "n_item"))
    pairs = contained(docs, items, threshold).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return pairs.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, that contain no item."""
    bad = contained(docs, items, threshold).select(F.col("doc_id").alias("bad_id"), F.col("doc_key").alias("bad_key")).distinct()
    # whole rows travel in a struct, so their column names meet no others
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    holds = F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key"))
    return rows.join(bad, holds, "left_anti").select("row.*")
