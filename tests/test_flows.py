import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import cuts as ct
from packetloom.operators import flows as fl
from packetloom.operators.features import PACKET_INPUTS, flow_features
from tests.plain import SCHEMA, fold_flows

SECOND = 1_000_000
A, B = ("10.0.0.1", 1000), ("10.0.0.2", 80)


def packet(ordinal, ts, src=A, dst=B, flags=16, protocol=6, capture="c"):
    return (capture, ordinal, ts, src[0], dst[0], src[1], dst[1], protocol, flags)


def group(spark, rows, **options):
    df = fl.group_into_flows(spark.createDataFrame(rows, SCHEMA), **options)
    return {(r.capture_file, r.capture_packet_index): (r.flow_id, r.packet_index, r.direction) for r in df.collect()}


CASES = {
    "timeout is inclusive": [packet(0, 0), packet(1, 120 * SECOND), packet(2, 120 * SECOND + 1)],
    "timeout counts from the flow start": [packet(i, i * 50 * SECOND) for i in range(6)],
    "one-sided fin": [packet(0, 0, flags=17), packet(1, 1), packet(2, 2, flags=17), packet(3, 3)],
    "fin both ways keeps initiator": [packet(0, 0, flags=17), packet(1, 1, B, A, 17), packet(2, 2, B, A), packet(3, 3)],
    "reset": [packet(0, 0), packet(1, 1, B, A, 4), packet(2, 2, B, A), packet(3, 3, flags=5), packet(4, 4)],
    "udp flags": [packet(0, 0, flags=5, protocol=17), packet(1, 1, flags=5, protocol=17)],
    "reply first after timeout": [packet(0, 0), packet(1, 200 * SECOND, B, A), packet(2, 201 * SECOND)],
    "equal times by ordinal": [packet(1, 5, B, A), packet(0, 5), packet(2, 5, flags=4), packet(3, 5)],
    "one address on both ends": [packet(0, 0, ("1.1.1.1", 9), ("1.1.1.1", 5)), packet(1, 1, ("1.1.1.1", 5), ("1.1.1.1", 9))],
}


@pytest.mark.parametrize("name", list(CASES))
def test_grouping_cases(spark, name):
    assert group(spark, CASES[name]) == fold_flows(CASES[name])


def test_far_end_is_chosen_by_address_alone(spark):
    rows = spark.createDataFrame([packet(0, 0, ("1.1.1.1", 9), ("1.1.1.1", 5))], SCHEMA)
    row = fl.group_into_flows(rows).first()
    assert (row.flow_src_port, row.flow_dst_port) == (9, 9)


def random_packets(seed, keys=5, count=400, skewed=False):
    rnd = random.Random(seed)
    clock = [0] * keys
    rows = []
    for i in range(count):
        k = 0 if skewed and rnd.random() < 0.6 else rnd.randrange(keys)
        clock[k] += rnd.choice([0, SECOND, 20 * SECOND, 60 * SECOND, 120 * SECOND, 121 * SECOND])
        ends = [(f"10.0.0.{k}", 1000 + k), ("10.1.0.1", 80)]
        if rnd.random() < 0.4:
            ends.reverse()
        rows.append(packet(i, clock[k], *ends, flags=rnd.choice([16, 16, 16, 17, 20, 2]), protocol=6 if k % 4 else 17))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_packets_and_order_insensitivity(spark, seed):
    rows = random_packets(seed)
    expected = fold_flows(rows)
    random.Random(seed).shuffle(rows)
    assert group(spark, rows) == expected


@pytest.mark.parametrize("seed,limit", [(1, 10), (2, 25), (3, 60)])
def test_heavy_keys_in_chunks_equal_the_plain_fold(spark, seed, limit):
    """One key holds most rows and is cut into many chunks."""
    rows = random_packets(seed, skewed=True)
    assert group(spark, rows, max_key_rows=limit) == fold_flows(rows)


def test_heavy_keys_from_many_input_partitions(spark):
    """Light keys must stay whole beside a heavy one, however the input is spread."""
    rows = random_packets(5, keys=40, count=3000, skewed=True)
    spread = spark.createDataFrame(rows, SCHEMA).repartition(16)
    got = fl.group_into_flows(spread, max_key_rows=300).collect()
    assert {(r.capture_file, r.capture_packet_index): (r.flow_id, r.packet_index, r.direction) for r in got} == fold_flows(rows)


def test_a_heavy_key_without_any_break(spark):
    """No gap, no end: every chunk waits for the state of the one before."""
    rows = [packet(i, i * 30 * SECOND, *((A, B) if i % 3 else (B, A))) for i in range(60)]
    assert group(spark, rows, max_key_rows=8) == fold_flows(rows)


def test_heavy_and_light_paths_agree_on_every_column(spark):
    rows = spark.createDataFrame(random_packets(9, skewed=True), SCHEMA)
    full = lambda limit: sorted(map(tuple, fl.group_into_flows(rows, max_key_rows=limit).collect()), key=str)
    assert full(12) == full(4_000_000)


def test_dedup_uses_numeric_order_and_valid_hosts(spark):
    low, high = ("172.31.0.9", 1), ("172.31.0.10", 2)
    rows = [
        packet(0, 0, low, high, capture="UCAP172.31.0.9"), packet(0, 0, low, high, capture="UCAP172.31.0.10"),
        packet(1, 0, high, ("8.8.8.8", 53), capture="UCAP172.31.0.10"),
        packet(2, 0, low, high, capture="no-address"), packet(3, 0, low, high, capture="UCAP172.31.0.300"),
    ]
    packets = spark.createDataFrame(rows, SCHEMA)
    grouped = fl.group_into_flows(packets)
    kept = fl.drop_cross_capture_duplicates(grouped, fl.capture_hosts(packets))
    assert sorted((r.capture_file, r.capture_packet_index) for r in kept.collect()) == [
        ("UCAP172.31.0.10", 1), ("UCAP172.31.0.300", 3), ("UCAP172.31.0.9", 0), ("no-address", 2)]
    drops = {r.capture_file: (r.dropped_flow_rows, r.dropped_packet_rows) for r in fl.cross_capture_drops(grouped).collect()}
    assert drops["UCAP172.31.0.10"] == (1, 1) and drops["no-address"] == (0, 0)


# --- cuts -----------------------------------------------------------------------------------

def test_cut_rules(spark):
    rows = spark.createDataFrame([packet(i, i * SECOND) for i in range(10)], SCHEMA)
    grouped = fl.group_into_flows(rows)
    size = lambda mode, value: ct.apply_cut(grouped, ct.Cut(mode, value)).count()
    assert [size("packet_pct", r) for r in (0.01, 0.1, 0.25, 1.0)] == [1, 1, 3, 10]
    assert [size("time_abs", s) for s in (0.1, 1, 100)] == [1, 2, 10]
    assert [size("packet_abs", k) for k in (1, 3, 50)] == [1, 3, 10]
    grid = {r["cut"]: r["count"] for r in ct.cut_grid(grouped).groupBy("cut").count().collect()}
    assert grid["pct_100"] == 10 and grid["packet_abs_3"] == 3 and len(grid) == len(ct.STANDARD_CUTS)


def test_cut_tags_and_validation():
    assert [c.tag for c in ct.STANDARD_CUTS][0] == "pct_010"
    assert ct.Cut("time_abs", 0.5).tag == "time_abs_500ms" and ct.parse_seconds("500ms") == 0.5
    for c in ct.STANDARD_CUTS:
        assert ct.parse_cut(c.tag) == c
    for mode, value in (("packet_pct", 0), ("packet_pct", 1.2), ("time_abs", 0), ("packet_abs", 1.5), ("time_pct", 0.5)):
        with pytest.raises(ValueError):
            ct.Cut(mode, value)


# --- features ----------------------------------------------------------------------------------

def features_of(spark, rows):
    schema = SCHEMA + ", payload_len int, ip_hdr_len int, tcp_win int"
    df = spark.createDataFrame([(*r, 10 * (i + 1), 20, 500 + i) for i, r in enumerate(rows)], schema)
    return flow_features(fl.group_into_flows(df, carry=PACKET_INPUTS)).first()


def test_single_packet_flow(spark):
    row = features_of(spark, [packet(0, 0)])
    assert row.flow_pkts_s == float("inf") and row.flow_byts_s == float("inf") and row.bwd_pkts_s == 0
    assert row.flow_duration == 0 and row.active_mean == 0 and row.init_bwd_win_byts == 0


def test_udp_has_no_window(spark):
    row = features_of(spark, [packet(0, 0, protocol=17)])
    assert (row.init_fwd_win_byts, row.init_bwd_win_byts) == (-1, -1)


def test_activity_splits_above_five_seconds_only(spark):
    row = features_of(spark, [packet(0, 0), packet(1, 5 * SECOND), packet(2, 10 * SECOND + 1), packet(3, 11 * SECOND, B, A)])
    assert row.idle_max == 5 * SECOND + 1 and row.idle_std == 0
    assert (row.active_max, row.active_min) == (5 * SECOND, 999_999)
    assert row.fwd_iat_tot == 10 * SECOND + 1 and row.bwd_iat_tot == 0 and row.down_up_ratio == pytest.approx(1 / 3)


def test_empty_input_keeps_the_layout(spark):
    from packetloom.operators.features import RAW_FLOW_COLUMNS, to_raw_flow_table

    schema = SCHEMA + ", payload_len int, ip_hdr_len int, tcp_win int"
    out = to_raw_flow_table(flow_features(fl.group_into_flows(spark.createDataFrame([], schema), carry=PACKET_INPUTS)), "d")
    assert out.count() == 0 and out.columns == [shown for _, shown in RAW_FLOW_COLUMNS] and len(out.columns) == 69


def test_plan_shuffles_packets_once_for_grouping_and_once_per_flow(spark, tmp_path):
    rows = spark.createDataFrame(random_packets(1), SCHEMA)
    path = str(tmp_path / "p")
    rows.selectExpr("*", "1 as payload_len", "20 as ip_hdr_len", "0 as tcp_win", "'x' as unused").write.parquet(path)
    cut = ct.apply_cut(fl.group_into_flows(spark.read.parquet(path), carry=PACKET_INPUTS), ct.Cut("packet_abs", 3))
    plan = flow_features(cut)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "unused" not in plan


def test_blocks_stay_small_around_a_long_key(monkeypatch):
    """A kernel gets one block at a time, a long key alone: the memory of a worker follows the block."""
    import pyarrow as pa

    from packetloom.operators import ordered

    seen = []

    class Recording(ordered.Kernel):
        def __call__(self, table, starts, carry, open_end):
            assert starts[0] == 0 and carry is None and not open_end
            seen.append((table.num_rows, len(starts)))
            return table, None

    assert ordered.BLOCK_ROWS <= 1 << 16
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 40)
    keys = [0] * 3 + [1] * 400 + [2 + i // 3 for i in range(900)]
    whole = pa.table({"k": keys, "v": list(range(len(keys)))})
    out = list(ordered._stream(iter(whole.to_batches(16)), ["k"], Recording(), whole.schema))
    assert pa.Table.from_batches(out).equals(whole)
    assert [n for n, own in seen if n > 40] == [400] and all(n <= 40 or own == 1 for n, own in seen)
