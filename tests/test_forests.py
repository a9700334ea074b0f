"""Forests as tables: the same trees however rows are dealt and wherever tasks finish them, and they learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import forests as fo
from packetloom.operators import tensors as tn
from packetloom.operators.metrics import confusion_counts, overall


@pytest.fixture(scope="module")
def table(spark):
    """Three classes in five columns; the middle columns are noise, the last is constant."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        turn = 2.1 * (i % 3) + rng.normal() * 0.6
        rows.append((i, "abc"[i % 3 if i % 10 else 0], float(np.cos(turn)), float(np.sin(turn)), float(rng.normal()), int(rng.integers(4)), 1))
    return spark.createDataFrame(rows, "id long, label string, x double, y double, noise double, few int, one int").coalesce(1)


NAMES = ["x", "y", "noise", "few", "one"]


def picks(forest, rows):
    return sorted(map(tuple, fo.predict(forest, rows, ["id"], "label").select("id", "y_true", "y_pred").collect()))


def test_large_nodes_change_nothing(spark, table, monkeypatch):
    train, test = table.where("id % 4 > 0"), table.where("id % 4 = 0")
    whole = fo.grow(train, ["id"], "label", NAMES, 7, trees=6, depth=12)
    assert [len(t.heap) for t in whole.tops] == [1] * 6
    shares = {r.feature: r.importance for r in fo.importances(whole).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["one"] == 0 and shares["x"] > shares["few"]
    monkeypatch.setattr(fo, "NODE_VALUES", 5 * 60)
    monkeypatch.setattr(fo, "JOB_CELLS", 2000)
    parted = fo.grow(train.repartition(5), ["id"], "label", NAMES, 7, trees=6, depth=12)
    assert all(len(t.heap) > 10 for t in parted.tops)
    assert picks(whole, test) == picks(parted, test.repartition(3))
    again = {r.feature: r.importance for r in fo.importances(parted).collect()}
    assert again == pytest.approx(shares)


def test_a_leaf_among_the_large_nodes_votes(spark, table, monkeypatch):
    monkeypatch.setattr(fo, "NODE_VALUES", 5 * 60)
    shallow = fo.grow(table, ["id"], "label", NAMES, 7, trees=5, depth=2)
    assert any(v is not None for t in shallow.tops for v in t.votes)
    monkeypatch.setattr(fo, "NODE_VALUES", 10**9)
    assert picks(shallow, table) == picks(fo.grow(table, ["id"], "label", NAMES, 7, trees=5, depth=2), table)


def test_forests_learn(table):
    train, test = table.where("id % 4 > 0"), table.where("id % 4 = 0")
    forest = fo.grow(train, ["id"], "label", NAMES, 1, trees=30, depth=20)
    scored = fo.predict(forest, test, ["id"], "label")
    assert scored.count() == test.count()
    assert overall(confusion_counts(scored)).first()["macro_f1"] > 0.7
    # deep trees know their own rows
    assert overall(confusion_counts(fo.predict(forest, train, ["id"], "label"))).first()["macro_f1"] > 0.95


def test_best_split_against_every_split():
    rng = np.random.default_rng(1)
    bins, code, times = rng.integers(0, 5, (40, 3)).astype(np.uint8), rng.integers(0, 3, 40), rng.integers(1, 3, 40)
    weights = np.array([1.0, 2.0, 0.5])

    def gini(mask):
        own = np.bincount(code[mask], weights=times[mask], minlength=3) * weights
        return own.sum(), 1 - ((own / own.sum()) ** 2).sum()

    best = 0.0
    whole, impurity = gini(np.ones(40, dtype=bool))
    for f in range(3):
        for b in range(4):
            left = bins[:, f] <= b
            (wl, gl), (wr, gr) = gini(left), gini(~left)
            best = max(best, impurity - wl / whole * gl - wr / whole * gr)
    counts = fo.histograms(np.zeros(40, dtype=np.int64), np.array([[0, 1, 2]]), bins, code, times, 3)
    _, _, gain, mass = fo.best_splits(counts, weights)
    assert gain[0] == pytest.approx(best) and mass[0] == pytest.approx(whole)


def test_bins_keep_few_values_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") == 7, 2).when(F.col("id") % 2500 == 1, 1).otherwise(0).alias("rare"), "id")
    rare, ids = fo.bin_edges(rows, ["rare", "id"])
    assert rare.tolist() == [0.5, 1.5] and 25 <= len(ids) <= 31


@pytest.fixture(scope="module")
def packed(spark):
    """Flows of two packets of four bytes: three classes that differ in some bytes, other bytes noise or constant."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        kind = i % 3 if i % 8 else 0
        first = bytes([69, 40 * kind + int(rng.integers(60)), int(rng.integers(256)), 0])
        second = bytes([69, int(rng.integers(3)), 165 * (kind == 2 or i % 5 == 0), int(rng.integers(90))])
        rows.append((i, "abc"[kind], [bytearray(first), bytearray(second)]))
    table = spark.createDataFrame(rows, "id long, label string, packets array<binary>").coalesce(1)
    return tn.joined_bytes(table, "bytes", 2)


REGIONS = (("size", 1, 2), ("rest", 2, 4), ("front", 0, 2), ("past", 3, 9))


def test_bytes_are_features(spark, packed):
    places = [f"b{i}" for i in range(8)]
    wide = packed.select("*", *[F.conv(F.hex(F.substring("bytes", i + 1, 1)), 16, 10).cast("int").alias(c) for i, c in enumerate(places)])
    few = [0, 3, 4, 5, 6]
    by_byte, by_column = fo.byte_edges(packed, "bytes"), fo.bin_edges(wide, places)
    assert [by_byte[i].tolist() for i in few] == [by_column[i].tolist() for i in few]
    assert all(25 <= len(by_byte[i]) <= 31 for i in (1, 2, 7))
    forest = fo.grow(packed, ["id"], "label", "bytes", 3, trees=8, depth=12)
    same = fo.grow(wide, ["id"], "label", places, 3, trees=8, depth=12)
    agree = fo.predict(forest, packed, ["id"], "label").join(fo.predict(same, wide, ["id"], "label"), ["id", "y_pred"]).count()
    assert agree > 590
    assert [r.feature for r in fo.importances(forest).orderBy(F.col("feature").cast("int")).collect()] == [str(i) for i in range(8)]


@pytest.mark.parametrize("node_values, depth", [(4_000_000, 12), (8 * 40, 12), (8 * 40, 3)])
def test_zeroed_features_as_if_rows_were_copied(spark, packed, monkeypatch, node_values, depth):
    monkeypatch.setattr(fo, "NODE_VALUES", node_values)
    train, test = packed.where("id % 4 > 0"), packed.where("id % 4 = 0")
    forest = fo.grow(train, ["id"], "label", "bytes", 3, trees=7, depth=depth)
    assert any(v is not None for t in forest.tops for v in t.votes) == (node_values < 4_000_000)
    found = fo.predict_zeroed(forest, test.repartition(3), ["id"], "label", tn.region_places(REGIONS, 2, 4))
    got = {(r.id, r.region): (r.y_true, r.y_pred) for r in found.collect()}
    assert found.count() == len(got) == 150 * 4
    expected = {}
    for r in tn.occluded(test, REGIONS, 4).select("region").distinct().collect():
        copies = tn.joined_bytes(tn.occluded(test, REGIONS, 4).where(F.col("region") == r.region), "bytes", 2)
        expected |= {(p.id, r.region): (p.y_true, p.y_pred) for p in fo.predict(forest, copies, ["id"], "label").collect()}
    assert got == expected
    assert len({tuple(v for (i, n), v in sorted(got.items()) if n == name) for name in ("none", "size", "rest", "front")}) > 2


def test_the_sweep_keeps_no_tree_on_the_driver(spark, monkeypatch):
    from packetloom.catalog import queries as qs

    monkeypatch.setattr(qs.md, "fit", lambda *a, **k: pytest.fail("a model of Spark's holds all its trees on the driver"))
    grow = fo.grow
    monkeypatch.setattr(fo, "grow", lambda *a, **k: grow(*a, **k | {"trees": 4}))
    drops = {r.region: r for r in qs.QUERIES["occlusion_sweep"](spark, "/root/testdata/sf0.01").collect()}
    assert set(drops) == set(tn.region_places()) and len(drops) == 22
    # addresses are masked: zeroing them changes nothing
    assert [drops[r].drop for r in ("ip_src", "ip_dst")] == pytest.approx([0, 0], abs=1e-12)


def test_drops_have_no_more_tasks_than_partitions(spark):
    rows = [("none", "a", "a", 5), ("none", "b", "a", 2), ("ip_ttl", "a", "a", 3), ("ip_ttl", "a", "b", 2), ("ip_ttl", "b", "a", 2)]
    counts = spark.createDataFrame(rows, "region string, y_true string, y_pred string, n long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        drops, _ = tn.drops_from_counts(counts)
        assert "CartesianProduct" not in drops._jdf.queryExecution().executedPlan().toString()
        found = drops.collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    # macro-F1: (10/12 + 0) / 2 untouched, (6/10 + 0) / 2 without the region
    assert [(r.region, r.drop) for r in found] == [("ip_ttl", pytest.approx(10 / 24 - 6 / 20))]
