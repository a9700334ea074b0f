import json

import pytest
from pyspark.sql import functions as F

from packetloom.functions import packets as pk
from packetloom.operators import experiments as ex
from packetloom.operators import labels as lb
from packetloom.operators import metrics as mt
from packetloom.operators import sampling as sp
from packetloom.operators import selection as sel
from packetloom.sources import configs, files, sinks, tables as tb


def test_scores_with_absent_classes(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "c")]
    counts = mt.confusion_counts(spark.createDataFrame(rows, "y_true string, y_pred string"))
    f1 = {r["class"]: r.f1 for r in mt.per_class(counts).collect()}
    assert f1 == {"a": pytest.approx(2 / 3), "b": 0.0, "c": 0.0}
    assert mt.overall(counts).first().macro_f1 == pytest.approx(2 / 9)
    fixed = mt.per_class(counts, classes=spark.createDataFrame([("a",), ("z",)], "class string"))
    assert {r["class"]: r.support for r in fixed.collect()} == {"a": 2, "z": 0}


def test_best_epoch_with_patience(spark):
    rows = [(e, v) for e, v in enumerate([0.1, 0.5, 0.4, 0.5, 0.9])]
    best = mt.best_epoch(spark.createDataFrame(rows, "epoch int, val_macro_f1 double"), 2).first()
    assert (best.best_epoch, best.best_val_macro_f1, best.stopped_at) == (1, 0.5, 3)


def test_seeds_pairs_and_votes(spark):
    runs = spark.createDataFrame([("d", "rf_x", 1, 0.5), ("d", "rf_y", 2, 0.4)], "dataset string, config string, seed int, macro_f1 double")
    assert ex.seed_aggregate(runs).where("config = 'rf_x'").first()["std"] == 0.0
    pair = spark.createDataFrame([("p", "d", "rf_x", "rf_y")], "name string, dataset string, config_a string, config_b string")
    assert ex.paired_difference(runs, pair).count() == 0
    occ = spark.createDataFrame([("d", 1, "r", -0.3), ("d", 1, "s", -0.1), ("d", 2, "r", -0.1), ("d", 2, "s", -0.2)],
                                "dataset string, seed int, region string, delta_macro_f1 double")
    assert all(r.tied and r.leads and r.votes == 1 for r in ex.region_votes(occ).collect())


def test_grid_sizes(spark):
    kinds = {r.kind: r["count"] for r in ex.experiment_grid(spark).groupBy("kind").count().collect()}
    assert kinds == {"byte": 370, "rf": 175, "occl": 65}
    assert ex.window_pairs(spark).count() == 16 and ex.probe_pairs(spark).count() == 8


def test_splits_cover_and_caps_are_stable(spark):
    rows = spark.range(1000).withColumn("c", F.when(F.col("id") % 10 == 0, "rare").otherwise("often"))
    split = sp.three_way_split(rows, "c", ["id"], 7)
    assert split.count() == 1000 and split.select("id").distinct().count() == 1000
    assert split.where("split = 'test' and c = 'rare'").count() == 25 and split.where("split = 'validation' and c = 'rare'").count() == 15
    small = {r.id for r in sp.cap_per_class(rows, "c", ["id"], 7, {"often": 50}).where("c = 'often'").collect()}
    large = {r.id for r in sp.cap_per_class(rows, "c", ["id"], 7, {"often": 90}).where("c = 'often'").collect()}
    assert len(small) == 50 and small < large
    again = {r.id for r in sp.cap_per_class(rows.repartition(7), "c", ["id"], 7, {"often": 50}).where("c = 'often'").collect()}
    assert again == small


def test_feature_selection(spark):
    rows = spark.range(50).select((F.col("id") * 1.0).alias("a"), F.lit(3.0).alias("k"), (F.col("id") * 2.0).alias("b"),
                                  F.when(F.col("id") == 1, float("inf")).otherwise((F.col("id") * 7) % 11 * 1.0).alias("z"))
    assert {r.feature: r.reason for r in sel.selection_report(rows, ["a", "k", "b", "z"]).collect()} == {
        "a": "correlated", "k": "constant", "b": "kept", "z": "kept"}
    with pytest.raises(ValueError):
        sel.feature_columns(rows, extra=["nope"], strict=True)


def test_host_names(spark):
    names = spark.createDataFrame([("cap172.31.0.9",), ("x",), ("c300.1.1.1",)], "n string")
    assert [r.h for r in names.select(pk.capture_host("n").alias("h")).collect()] == ["172.31.0.9", None, None]


def test_rules_file(spark, tmp_path):
    doc = {"attacks": [{"day": "Thuesday-20-02-2018", "label": "L", "start_time": "10:00", "end_time": "11:00", "attacker_ips": ["a"],
                        "victim_ips": ["v"], "victim_ports": [80], "known_issues": "odd"}], "days_excluded": {"Thuesday-20-02-2018": "why"}}
    (tmp_path / "rules.json").write_text(json.dumps(doc))
    profiles = configs.read_rules(spark, str(tmp_path / "rules.json"))
    row = configs.rules_of_day(configs.attack_rules(profiles), "Tuesday-20-02-2018").first()
    assert row.start_us == 1519138800 * 1_000_000 and row.end_us - row.start_us == 3600 * 1_000_000
    assert [r.issue for r in configs.known_issues(profiles, "Tuesday-20-02-2018").collect()] == ["why", "L: odd"]
    assert configs.claims_table(spark).count() == 17


def test_truth_file_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes(("﻿ts,src_ip,src_port,dst_ip,dst_port,proto,type\n5,a,-,b,2,ICMP, XSS \n,a,1,b,2,tcp,x\n").encode())
    rows = lb.prepare_ground_truth(tb.read_ground_truth(spark, str(tmp_path / "g.csv"))).collect()
    assert [(r.key, r.gt_us, r.type) for r in rows] == [("1|a:0|b:2", 5_000_000, "xss")]


def test_files_audit_and_parts(spark, tmp_path):
    import hashlib

    data = b"\x0a\x0d\x0d\x0arest"
    (tmp_path / "Benign").mkdir()
    (tmp_path / "Benign" / "a.pcap").write_bytes(data)
    (tmp_path / "Benign" / "junk.lnk").write_bytes(b"x")
    expected = spark.createDataFrame([("a.pcap", hashlib.md5(data).hexdigest()), ("b.pcap", "0")], "file string, md5 string")
    got = {r.file: (r.kind, r.intact) for r in files.audit_files(spark, str(tmp_path), expected).collect()}
    assert got == {"a.pcap": ("pcapng", True), "b.pcap": ("other", False)}
    assert [(r["class"], r.captures) for r in files.parts_with_captures(spark, str(tmp_path)).collect()] == [("Benign", 1)]


def test_parts_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([("x", "pct_100", 1), ("y", "pct_100", 2)], "part string, cut string, v int")
    assert sinks.write_table(table, path, ["part", "cut"]) and not sinks.write_table(table, path, force=False)
    ready = spark.createDataFrame([("x", True), ("y", False)], "part string, training_ready boolean")
    assert [r.v for r in tb.load_parts(spark, path, manifest=ready, cut="pct_100", columns=["v"]).collect()] == [1]
    assert tb.load_parts(spark, path, manifest=ready, include_untrainable=True).count() == 2
    flows = spark.createDataFrame([("Benign",), (None,)], "label string")
    manifest = sinks.build_manifest(sinks.part_stats(flows, flows), "x", True)
    sinks.write_manifest(manifest, str(tmp_path / "m"))
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row.stats.flow_rows == 2 and row.stats.unlabeled_flow_rows == 1 and row.labeling.training_ready


def test_ordered_cut_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "g")
    spark.range(10).selectExpr("id as flow_id", "cast(id as int) as packet_index", "'x' as other").write.parquet(path)
    plan = tb.read_first_packets(spark, path, 3, ["flow_id"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(packet_index,3)" in plan and "other" not in plan


def test_rows_follow_their_files_whatever_their_size(spark, tmp_path):
    for name, rows in (("a.csv", [("k", "first")]), ("b.csv", [("k", f"later{i}") for i in range(50_000)])):
        (tmp_path / name).write_text("key,value\n" + "".join(f"{k},{v}\n" for k, v in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = tb.in_file_order(spark.read.csv(str(tmp_path), header=True), "ord")
        got = rows.agg(F.min_by("value", "ord"), F.max_by("value", "ord"), F.countDistinct("ord")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == ("first", "later49999", 50_001)
