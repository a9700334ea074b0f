"""Seeded caps, splits and weights.

All of them rest on one order: the MD5 of key and seed. It is the same on every
run, on every cluster and for every cut of the same flows. Ranks come from
:func:`ranked_within`, so a class with most of the rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.classes import lookup
from packetloom.operators.ordered import ranked_within

TRAIN, VALID, TEST = "train", "validation", "test"
RANK, ORDER = "_rank", "_order"


def seeded_order(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))


def seeded_rank(
    df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, size_name: str | None = None
) -> DataFrame:
    """Adds ``_rank``: 1-based position within ``by`` in the seeded order.

    ``df`` is read twice, to count and to rank; give a stored or persisted table.
    """
    hashed = df.withColumn(ORDER, seeded_order(key, seed))
    bucket = F.substring(ORDER, 1, 4)
    order = [F.col(ORDER), *[F.col(k) for k in key]]
    return ranked_within(hashed, by, bucket, order, RANK, size_name).drop(ORDER)


def cap_per_class(
    df: DataFrame, label: str, key: Sequence[str], seed: int,
    caps: Mapping[str, int], default: int | None = None, within: Sequence[str] = (),
) -> DataFrame:
    """At most the cap of its class, without replacement; no cap keeps the class whole.

    ``within`` applies the caps per day or scenario. Classes without a cap are not
    ranked at all.
    """
    if default is None:
        capped = F.coalesce(F.col(label).isin(list(caps)), F.lit(False))
        free, bound = df.where(~capped), df.where(capped)
    else:
        free, bound = None, df
    ranked = seeded_rank(bound, [*within, label], key, seed)
    kept = ranked.where(F.col(RANK) <= lookup(label, dict(caps), default)).drop(RANK)
    return kept if free is None else free.unionByName(kept)


def undersample_benign(
    df: DataFrame, label: str, key: Sequence[str], seed: int, ratio: float = 3.0, benign: str = "Benign",
) -> DataFrame:
    """Benign rows down to ``ratio`` times the attacks; for the training part only."""
    calm = F.coalesce(F.col(label) == benign, F.lit(False))
    target = df.agg(F.floor(F.count_if(~calm) * F.lit(float(ratio))).alias("_target"))
    ranked = seeded_rank(df.where(calm), [], key, seed)
    kept = ranked.join(target, F.col(RANK) <= F.col("_target")).drop(RANK, "_target")
    return df.where(~calm).unionByName(kept)


def shuffled(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    return df.orderBy(seeded_order(key, seed), *key)


def _half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def _ranked_with_size(df, label, key, seed, within):
    return seeded_rank(df, [*within, label], key, seed, "_size")


def train_test_split(
    df: DataFrame, label: str, key: Sequence[str], seed: int, test_share: float = 0.25, within: Sequence[str] = (),
) -> DataFrame:
    """Adds ``split``; every class gives round(n·share) rows to the test part."""
    ranked = _ranked_with_size(df, label, key, seed, within)
    tests = _half_up(F.col("_size") * F.lit(test_share))
    return ranked.withColumn("split", F.when(F.col(RANK) <= tests, TEST).otherwise(TRAIN)).drop(RANK, "_size")


def three_way_split(
    df: DataFrame, label: str, key: Sequence[str], seed: int,
    test_share: float = 0.25, valid_share_of_rest: float = 0.2, within: Sequence[str] = (),
) -> DataFrame:
    """Test share of all rows, then a validation share of what is left, per class."""
    ranked = _ranked_with_size(df, label, key, seed, within)
    tests = _half_up(F.col("_size") * F.lit(test_share))
    valid = _half_up((F.col("_size") - tests) * F.lit(valid_share_of_rest))
    part = F.when(F.col(RANK) <= tests, TEST).when(F.col(RANK) <= tests + valid, VALID).otherwise(TRAIN)
    return ranked.withColumn("split", part).drop(RANK, "_size")


def share_split(
    df: DataFrame, label: str, key: Sequence[str], seed: int,
    valid_share: float = 0.15, test_share: float = 0.15, within: Sequence[str] = (),
) -> DataFrame:
    """70/15/15 per class, or per day and class with ``within``: what training leaves
    over is cut in proportion."""
    ranked = _ranked_with_size(df, label, key, seed, within)
    held = _half_up(F.col("_size") * F.lit(valid_share + test_share))
    tests = _half_up(held * F.lit(test_share / (valid_share + test_share)))
    part = F.when(F.col(RANK) <= tests, TEST).when(F.col(RANK) <= held, VALID).otherwise(TRAIN)
    return ranked.withColumn("split", part).drop(RANK, "_size")


def stratified_sample(df: DataFrame, label: str, key: Sequence[str], seed: int, rows: int) -> DataFrame:
    """About ``rows`` rows, the same fraction of every class."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = _ranked_with_size(df, label, key, seed, []).join(total)
    quota = F.rint(F.col("_size") * F.least(F.lit(float(rows)) / F.col("_total"), F.lit(1.0)))
    return ranked.where(F.col(RANK) <= quota).drop(RANK, "_size", "_total")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes · n of the class)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weight = F.col("_n").cast("double") / (F.col("_k") * F.col("count")).cast("double")
    return counts.join(whole).select("class", "count", weight.alias("weight"))


def with_sample_weight(df: DataFrame, label: str) -> DataFrame:
    weights = class_weights(df, label).select(F.col("class").alias(label), "weight")
    return df.join(weights, label)


def split_ledger(split: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    return split.select(*key, F.col(label).alias("class"), "split")


def flows_of_bytes(byte_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per flow of a byte table: the row of its earliest packet."""
    rest = [c for c in byte_rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.col("pkt_order"))
    return byte_rows.groupBy(*key).agg(first.alias("_row")).select(
        *key, *[F.col("_row")[c].alias(c) for c in rest]
    )
