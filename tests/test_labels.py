import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import labels as lb
from packetloom.operators import ordered
from tests.plain import pair_greedily

SECOND = 1_000_000
HEAD = ("capture_file string, flow_id long, flow_src_ip string, flow_src_port int, flow_dst_ip string, flow_dst_port int, "
        "protocol int, flow_start_us long, matched boolean, label string, attempted_category int")
REGISTRY = ("row_ord long, flow_src_ip string, flow_src_port int, flow_dst_ip string, flow_dst_port int, protocol int, "
            "flow_start_us long, label string, attempted_category int")


def flow(i, at, src="a", dst="b", sport=1, dport=2):
    return ("c", i, src, sport, dst, dport, 6, at, False, None, -1)


def entry(i, at, label="x", src="a", dst="b"):
    return (i, src, 1, dst, 2, 6, at, label, -1)


def pairs(spark, entries, flows, limit=1000, **options):
    got = lb.fuzzy_match(spark.createDataFrame(flows, HEAD), spark.createDataFrame(entries, REGISTRY), max_key_rows=limit, **options)
    return sorted((r.row_ord, r.flow_id, r.delta_us) for r in got.collect())


def test_greedy_order_without_reuse(spark):
    got = pairs(spark, [entry(0, 0), entry(1, SECOND)], [flow(7, 900_000), flow(8, 1_100_000)])
    assert got == [(0, 7, 900_000), (1, 8, 100_000)]


def test_label_subset(spark):
    assert pairs(spark, [entry(0, 0), entry(1, 10, "y")], [flow(7, 100)], labels=["y"]) == [(1, 7, 90)]


@pytest.mark.parametrize("seed,limit", [(1, 10_000), (2, 12), (3, 30)])
def test_random_matching_light_and_heavy(spark, seed, limit):
    rnd = random.Random(seed)
    left = sorted({rnd.randrange(40 * SECOND) for _ in range(60)})
    right = sorted({rnd.randrange(40 * SECOND) for _ in range(60)} - set(left))
    expected = sorted(pair_greedily([(t, i) for i, t in enumerate(left)], [(t, i) for i, t in enumerate(right)], SECOND))
    got = pairs(spark, [entry(i, t) for i, t in enumerate(left)], [flow(i, t) for i, t in enumerate(right)], limit)
    assert got == expected


def truth(spark, rows):
    schema = "gt_ord long, key string, gt_us long, type string"
    return spark.createDataFrame(rows, schema)


def nearest(spark, flows, rows):
    out = lb.label_by_nearest(spark.createDataFrame(flows, HEAD), truth(spark, rows), {"normal": 0, "ddos": 2, "xss": 9})
    return {r.flow_id: (r.label, r.label_encoded, r.matched, r.match_level) for r in out.collect()}


KEY = "6|a:1|b:2"


def test_unique_key_is_accepted_at_any_distance(spark):
    assert nearest(spark, [flow(0, 0)], [(0, KEY, 900 * SECOND, "xss")])[0] == ("xss", 9, True, 1)


def test_repeated_key_needs_the_tolerance(spark):
    rows = [(0, KEY, 0, "xss"), (1, KEY, 0, "ddos"), (2, KEY, 100 * SECOND, "ddos")]
    got = nearest(spark, [flow(0, 5 * SECOND), flow(1, 5 * SECOND + 1), flow(2, 96 * SECOND)], rows)
    assert got == {0: ("xss", 9, True, 1), 1: ("normal", 0, False, 0), 2: ("ddos", 2, True, 1)}


def test_equal_gaps_go_to_the_earlier_row_and_ends_may_be_swapped(spark):
    rows = [(5, KEY, 2 * SECOND, "ddos"), (3, KEY, 6 * SECOND, "xss")]
    swapped = flow(0, 4 * SECOND, "b", "a", 2, 1)
    assert nearest(spark, [swapped], rows)[0][0] == "xss"


def test_nearest_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, KEY, rnd.randrange(100) * 700_000, rnd.choice(["xss", "ddos"])) for i in range(80)]
    flows = [flow(i, rnd.randrange(90 * SECOND)) for i in range(120)]
    got = nearest(spark, flows, rows)
    for f in flows:
        best = min(((abs(r[2] - f[7]), r[0], r[3]) for r in rows if abs(r[2] - f[7]) <= 5 * SECOND), default=None)
        assert got[f[1]][0] == (best[2] if best else "normal")


def rules(spark, rows):
    return spark.createDataFrame(rows, "rule_pos int, label string, attacker_ips array<string>, victim_ips array<string>, "
                                       "victim_ports array<int>, start_us long, end_us long")


def test_rule_policies_ports_and_margin(spark):
    table = rules(spark, [
        (0, "wide", ["a"], ["b"], None, 0, 1000 * SECOND), (1, "narrow", ["a"], ["b"], None, 100 * SECOND, 200 * SECOND),
        (2, "port", ["p"], ["q"], [80], 0, 10 * SECOND),
    ])
    flows = spark.createDataFrame([
        flow(0, 150 * SECOND), flow(1, 150 * SECOND, "b", "a"), flow(2, 1300 * SECOND), flow(3, 1300 * SECOND + 1),
        flow(4, 0, "p", "q", 5, 80), flow(5, 0, "p", "q", 80, 5), flow(6, 0, "q", "p", 80, 5),
    ], HEAD)
    get = lambda policy: [r.label for r in lb.label_by_rules(flows, table, policy).orderBy("flow_id").collect()]
    assert get("first") == ["wide", "wide", "wide", "Benign", "port", "Benign", "port"]
    assert get("narrowest")[:2] == ["narrow", "narrow"]
    with pytest.raises(ValueError):
        lb.label_by_rules(flows, table.limit(0))


def test_missing_aligned_flow_is_an_error(spark):
    flows = spark.createDataFrame([flow(0, 0)], HEAD)
    with pytest.raises(ValueError):
        lb.align_features(flows, spark.createDataFrame([flow(1, 0)], HEAD))


def test_registry_keeps_first_or_last(spark):
    table = spark.createDataFrame([entry(0, 5, "one"), entry(1, 5, "two")], REGISTRY)
    assert [lb.dedup_registry(table, k).first().label for k in ("first", "last")] == ["one", "two"]


def test_ranks_in_one_big_class(spark):
    rows = spark.range(5000).withColumn("c", F.lit("x"))
    ranked = ordered.ranked_within(rows, ["c"], F.col("id") % 1 + F.expr("id div 100"), [F.col("id")], "r", "n")
    assert ranked.where("r <> id + 1 or n <> 5000").count() == 0
