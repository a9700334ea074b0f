"""Tables over repeated runs: seeds, paired differences, votes, grids, pivots.

Results are long tables, one value per row. Runs have dataset, config, seed, macro_f1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The study's data sets, seeds and grids.
DATASETS = ("cic_ids2017", "cic_ids2018", "toniot", "cic_iot2023")
SEEDS = (42, 1, 2, 3, 4)
FEATURE_CUTS = ("pct_100", "packet_abs_5", "packet_abs_4", "packet_abs_3")
NO_WINDOW = "_noInitWin"
AVERAGE_ROWS = ("accuracy", "macro avg", "weighted avg", "")
ABSENT_CELL = "missing"

# Region groups used to colour the region chart.
REGION_FAMILIES = {
    "tcp_options": "tcp", "tcp_window": "tcp", "tcp_seq": "tcp", "tcp_ack": "tcp", "tcp_off_flags": "tcp",
    "tcp_checksum": "tcp", "tcp_urgent": "tcp", "tcp_sport": "tcp", "tcp_dport": "tcp",
    "payload_60_128": "payload", "payload_128_192": "payload", "payload_192_256": "payload",
}


def _over_seeds(value: Column | str) -> list[Column]:
    value = F.col(value) if isinstance(value, str) else value
    entries = F.array_sort(F.collect_list(F.struct(F.col("seed").cast("string").alias("key"), value.alias("value"))))
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.map_from_entries(entries).alias("seeds"),
    ]


def seed_aggregate(runs: DataFrame, by: Sequence[str] = ("dataset", "config"), value: str = "macro_f1") -> DataFrame:
    """n, mean, sample deviation (0 for one seed) and the values by seed."""
    return runs.where(F.col(value).isNotNull()).groupBy(*by).agg(*_over_seeds(value))


def first_available(artifacts: DataFrame, by: Sequence[str] = ("dataset", "config", "seed")) -> DataFrame:
    """One score per run: the artifact of the best priority that has one.

    ``artifacts``: run columns, priority (0 is best), macro_f1 or NULL.
    """
    present = artifacts.where(F.col("macro_f1").isNotNull())
    return present.groupBy(*by).agg(F.min_by("macro_f1", "priority").alias("macro_f1"))


def class_aggregate(scores: DataFrame) -> DataFrame:
    """Seed aggregate per class; average rows of a report are no classes."""
    return seed_aggregate(scores.where(~F.col("class").isin(*AVERAGE_ROWS)), ("dataset", "config", "class"), "f1")


def occlusion_aggregate(runs: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean loss per region; losses are the negated changes."""
    return runs.withColumn("loss", -F.col("delta_macro_f1")).groupBy(*by, "region").agg(*_over_seeds("loss"))


def occlusion_baseline(runs: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return seed_aggregate(runs.select(*by, "seed", "baseline_macro_f1").distinct(), by, "baseline_macro_f1")


def region_votes(runs: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Votes for the most affected region, one per seed; ties between winners show."""
    first = Window.partitionBy(*by, "seed").orderBy(F.asc("delta_macro_f1"), "region")
    leaders = runs.withColumn("_at", F.row_number().over(first)).where("_at = 1")
    votes = leaders.groupBy(*by, "region").agg(F.count(F.lit(1)).alias("votes"))
    part = Window.partitionBy(*by)
    most = F.max("votes").over(part)
    return votes.withColumns({
        "of": F.sum("votes").over(part), "leads": F.col("votes") == most,
        "tied": F.sum(F.when(F.col("votes") == most, 1).otherwise(0)).over(part) > 1,
    }).withColumn("tied", F.col("tied") & F.col("leads")).select(*by, "region", "votes", "of", "leads", "tied")


def paired_difference(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a − b) in points over the seeds both have: n, mean_points, std_points.

    ``pairs``: name, dataset, config_a, config_b. Pairs without a common seed vanish.
    """
    a = runs.select("dataset", F.col("config").alias("config_a"), "seed", F.col("macro_f1").alias("_a"))
    b = runs.select("dataset", F.col("config").alias("config_b"), "seed", F.col("macro_f1").alias("_b"))
    both = pairs.join(a, ["dataset", "config_a"]).join(b, ["dataset", "config_b", "seed"])
    diff = both.withColumn("points", (F.col("_a") - F.col("_b")) * 100)
    return diff.groupBy("name", "dataset").agg(
        F.count("points").alias("n"), F.avg("points").alias("mean_points"),
        F.coalesce(F.stddev_samp("points"), F.lit(0.0)).alias("std_points"),
    )


def window_pairs(spark: SparkSession, datasets: Sequence[str] = DATASETS, cuts: Sequence[str] = FEATURE_CUTS) -> DataFrame:
    """All features against those without the initial window, per data set and cut."""
    rows = [(f"window/{d}/{c}", d, f"rf_{c}", f"rf_{c}{NO_WINDOW}") for d in datasets for c in cuts]
    return spark.createDataFrame(rows, "name string, dataset string, config_a string, config_b string")


def probe_pairs(spark: SparkSession, datasets: Sequence[str] = DATASETS, packets: int = 3) -> DataFrame:
    """The basic mask against the strict and the derived one."""
    base = f"transformer_pkt{packets}_basic"
    probes = (("strict", "strict"), ("derived", "occ_top5"))
    rows = [(f"probe/{d}/{n}", d, base, f"transformer_pkt{packets}_{v}") for d in datasets for n, v in probes]
    return spark.createDataFrame(rows, "name string, dataset string, config_a string, config_b string")


def incomplete_runs(runs: DataFrame, seeds: int = len(SEEDS)) -> DataFrame:
    counts = runs.where(F.col("macro_f1").isNotNull()).groupBy("dataset", "config").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") < seeds)


# --- grids ---------------------------------------------------------------------------------

#: Byte-model inputs as (scope, mask, packet counts). ``first`` is the first data set, ``rest`` the others.
BYTE_INPUTS = (
    ("first", "basic", (1, 2, 3, 4, 5)), ("first", "strict", (1, 2, 3, 4, 5)),
    ("first", "csum_fix", (3, 5)), ("first", "strict_csum", (3, 5)),
    ("first", "occ_top1", (3, 5)), ("first", "occ_top2", (3, 5)), ("first", "occ_top3", (3, 5)), ("first", "occ_top4", (3, 5)), ("first", "occ_top5", (3, 5)),
    ("rest", "basic", (3, 4, 5)), ("rest", "strict", (3,)), ("rest", "occ_top5", (3,)),
)
BYTE_SIZES = (("", ("transformer", "bigru")), ("_d16", ("transformer",)), ("_d128", ("transformer",)))


def byte_grid(spark: SparkSession) -> DataFrame:
    """Byte-model configurations: dataset, kind, config, inputs, seed.

    The table of inputs, joined with the models that are trained on them: both on every input of the first
    data set, masked inputs of the others by the transformer alone, other sizes on five unmasked packets.
    """
    inputs = spark.createDataFrame(BYTE_INPUTS, "scope string, mask string, packets array<int>").withColumn("packets", F.explode("packets"))
    data = spark.createDataFrame([(d, "first" if d == DATASETS[0] else "rest") for d in DATASETS], "dataset string, scope string")
    models = spark.createDataFrame([(a + s, a, s) for s, archs in BYTE_SIZES for a in archs], "model string, arch string, size string")
    plain, first = F.col("mask") == "basic", F.col("scope") == "first"
    trained = F.when(F.col("size") != "", first & plain & (F.col("packets") == 5)).otherwise(first | plain | (F.col("arch") == "transformer"))
    table = data.join(inputs, "scope").join(models, trained)
    held = F.when(first & (F.col("size") == ""), F.col("packets")).otherwise(F.lit(5))
    config = F.concat_ws("_", "model", F.concat(F.lit("pkt"), F.col("packets").cast("string")), "mask")
    stored = F.concat(F.lit("raw_bytes_pkt"), held.cast("string"), F.lit("_b256"), F.when(plain, "").otherwise(F.concat(F.lit("_"), F.col("mask"))))
    return _with_seeds(table.select("dataset", F.lit("byte").alias("kind"), config.alias("config"), stored.alias("input")))


def forest_grid(spark: SparkSession) -> DataFrame:
    rows = [(d, c, w) for d in DATASETS for c in FEATURE_CUTS for w in ("", NO_WINDOW)]
    rows += [(DATASETS[0], "packet_abs_2", ""), (DATASETS[3], "packet_abs_2", ""), (DATASETS[3], "packet_abs_1", "")]
    table = spark.createDataFrame(rows, "dataset string, cut string, variant string")
    return _with_seeds(table.select(
        "dataset", F.lit("rf").alias("kind"), F.concat(F.lit("rf_"), "cut", "variant").alias("config"),
        F.concat("cut", F.lit("/raw_flow")).alias("input"),
    ))


def occlusion_grid(spark: SparkSession) -> DataFrame:
    rows = [(DATASETS[0], a, n) for a in ("transformer", "bigru") for n in (5, 3)]
    rows += [(d, a, n) for d in DATASETS[1:] for a, n in (("transformer", 5), ("transformer", 3), ("bigru", 5))]
    table = spark.createDataFrame(rows, "dataset string, arch string, packets int")
    own = F.when(F.col("dataset") == DATASETS[0], F.col("packets")).otherwise(F.lit(5))
    return _with_seeds(table.select(
        "dataset", F.lit("occl").alias("kind"),
        F.concat(F.lit("occl_"), "arch", F.lit("_pkt"), F.col("packets").cast("string")).alias("config"),
        F.concat(F.lit("raw_bytes_pkt"), own.cast("string"), F.lit("_b256")).alias("input"),
    ))


def _with_seeds(table: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    return table.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def experiment_grid(spark: SparkSession) -> DataFrame:
    return byte_grid(spark).unionByName(forest_grid(spark)).unionByName(occlusion_grid(spark))


def missing_inputs(grid: DataFrame, present: DataFrame) -> DataFrame:
    """Inputs a grid names that the listing (dataset, input) does not have."""
    return grid.select("dataset", "input").distinct().join(present, ["dataset", "input"], "left_anti")


# --- tables and series -----------------------------------------------------------------------

def result_table(
    aggregated: DataFrame, rows: DataFrame, columns: Sequence[str], row_key: Sequence[str], column_key: str = "config",
    value: str = "mean",
) -> DataFrame:
    """Grid of wanted rows × columns; absent cells are NULL and counted, never invented."""
    wide = aggregated.groupBy(*row_key).pivot(column_key, list(columns)).agg(F.first(value))
    joined = rows.join(wide, list(row_key), "left")
    lacking = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return joined.withColumn(ABSENT_CELL, lacking)


def class_table(class_scores: DataFrame, classes: Sequence[str], dataset: str, configs: Sequence[str]) -> DataFrame:
    """Per-class F1, a column per configuration, in the given class order."""
    spark = class_scores.sparkSession
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "position int, class string")
    mine = class_scores.where(F.col("dataset") == dataset)
    return result_table(mine, rows, configs, ["class"]).orderBy("position")


def window_table(runs_by_seed: DataFrame, pairs: DataFrame) -> DataFrame:
    """With and without the initial window, and the paired loss (negative)."""
    agg = seed_aggregate(runs_by_seed).select("dataset", "config", "mean", "std")
    side = lambda s: agg.select(
        "dataset", F.col("config").alias(f"config_{s}"), F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}")
    )
    delta = paired_difference(runs_by_seed, pairs).select(
        "name", (-F.col("mean_points")).alias("loss_points"), F.col("std_points").alias("loss_std")
    )
    return (
        pairs.join(side("a"), ["dataset", "config_a"], "left").join(side("b"), ["dataset", "config_b"], "left")
        .join(delta, "name", "left")
        .withColumn(ABSENT_CELL, F.col("loss_points").isNull())
    )


def occlusion_table(runs: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Mean loss for chosen regions and the most affected region with its votes."""
    agg = occlusion_aggregate(runs)
    wide = agg.groupBy("dataset").pivot("region", list(regions)).agg(F.first("mean"))
    top = region_votes(runs).where("leads").groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_list("region")), " / ").alias("most_affected"),
        F.first("votes").alias("votes"), F.first("of").alias("of"),
    )
    return wide.join(top, "dataset", "left")


def mask_ladder_table(aggregated: DataFrame, masks: Sequence[str], archs: Sequence[str], packets: Sequence[int]) -> DataFrame:
    """Mask variants × packet counts for each architecture, in ladder order."""
    spark = aggregated.sparkSession
    cells = [(i, m, a, n, f"{a}_pkt{n}_{m}") for i, m in enumerate(masks) for a in archs for n in packets]
    grid = spark.createDataFrame(cells, "position int, mask string, arch string, packets int, config string")
    joined = grid.join(aggregated.select("config", "mean"), "config", "left")
    wide = joined.groupBy("position", "mask", "arch").pivot("packets", list(packets)).agg(F.first("mean"))
    return wide.orderBy("position", F.desc("arch"))


def packet_series(aggregated: DataFrame) -> DataFrame:
    """Mean and deviation by number of packets, one series per data set and family."""
    packets = F.regexp_extract("config", r"(?:packet_abs_|pkt)(\d+)", 1)
    return (
        aggregated.where(packets != "")
        .select("dataset", F.regexp_extract("config", r"^([a-z]+)", 1).alias("family"),
                packets.cast("int").alias("packets"), "config", "mean", "std")
        .orderBy("dataset", "family", "packets", "config")
    )


def top_regions(aggregated: DataFrame, count: int = 13) -> DataFrame:
    """The regions of each data set with the largest mean loss, and the header they belong to."""
    family = F.create_map(*[F.lit(x) for kv in REGION_FAMILIES.items() for x in kv])
    order = Window.partitionBy("dataset").orderBy(F.desc("mean"), "region")
    return aggregated.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= count).select(
        "dataset", "region", "mean", "std", F.coalesce(F.try_element_at(family, F.col("region")), F.lit("ip")).alias("category")
    ).orderBy("dataset", F.desc("mean"), "region")


def missing_keys(wanted: DataFrame, aggregated: DataFrame, key: Sequence[str] = ("dataset", "config")) -> DataFrame:
    return wanted.select(*key).distinct().join(aggregated.select(*key), list(key), "left_anti")
