"""The stored packet base: one layout for cuts, labels and bytes."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows as fl
from packetloom.operators import tensors as tn
from packetloom.plans import builds
from packetloom.sources import store as st
from tests.test_flows import SCHEMA, random_packets


@pytest.fixture()
def base(spark):
    rows = spark.createDataFrame(random_packets(3), SCHEMA)
    frames = rows.where("capture_packet_index % 7 != 3").select("capture_file", "capture_packet_index", F.encode(F.rpad(F.lit("E"), 60, "x"), "utf-8").alias("ip_bytes"))
    return fl.group_into_flows(rows), frames


def chosen(packets):
    heads = packets.where("packet_index = 0").select(*fl.FLOW, "flow_total_packets")
    return heads.withColumn("label", F.when(F.col("flow_id") % 3 == 0, "a").otherwise("b - Attempted")).withColumn("attempted_category", F.lit(-1))


def rows_of(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_store_gives_what_it_was_given(spark, base, tmp_path):
    grouped, frames = base
    store = st.write_store(grouped, str(tmp_path / "s"), frames, 4)
    assert rows_of(store.packets, grouped.columns) == rows_of(grouped, grouped.columns)
    assert store.packets.where("ip_bytes is not null").count() == grouped.join(frames, ["capture_file", "capture_packet_index"]).count()
    assert store.flows().count() == grouped.where("packet_index = 0").count()


def test_later_session_opens_it_by_its_manifest(spark, base, tmp_path):
    path = str(tmp_path / "s")
    written = st.write_store(base[0], path, base[1], 4).packets
    before = rows_of(written, written.columns)
    spark.sql(f"drop table {st._name(path)}")
    assert rows_of(st.open_store(spark, path).packets, written.columns) == before
    described = {r.col_name: r.data_type for r in spark.sql(f"describe extended {st._name(path)}").collect()}
    assert described["Num Buckets"] == "4"


def test_half_a_store_does_not_open(spark, tmp_path):
    with pytest.raises(Exception):
        st.open_store(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("size", [4, 1 << 20])
@pytest.mark.parametrize("packets", [3, 9])
def test_bytes_equal_the_unstored_job(spark, base, tmp_path, monkeypatch, size, packets):
    monkeypatch.setattr(st, "SLICE", size)
    grouped, frames = base
    store = st.write_store(grouped, str(tmp_path / "s"), frames, 4)
    assert (store.packets.agg(F.max("slice")).first()[0] > 0) == (size == 4)
    columns = [*fl.FLOW, "pkt_order", "raw_bytes", "real_length", "found", "label", "timestamp_rel"]
    want = rows_of(builds.extract_bytes(grouped, chosen(grouped), frames, packets), columns)
    assert rows_of(builds.extract_stored_bytes(store, chosen(store.packets), packets), columns) == want


def test_packets_are_not_shuffled_again(spark, base, tmp_path):
    store = st.write_store(*[base[0], str(tmp_path / "s"), base[1], 4])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = spark.createDataFrame(chosen(store.packets).collect(), chosen(store.packets).schema)
        packed = tn.pack_flows(builds.extract_stored_bytes(store, tn.supported_flows(labels, 1)), 5, 60, None, key=st.KEY)
        lines = packed._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    depth = lines[scan].index("FileScan")
    above = [line for line in lines[:scan] if len(line) - len(line.lstrip(" :+-")) < depth]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not [line for line in above[join:] if "Exchange" in line] and not [line for line in above[:join] if "Exchange" in line]
    assert "mapInArrow" not in "".join(lines)


def test_supported_flows_keep_classes_with_enough_real_ones(spark):
    rows = [("c", 1, "a"), ("c", 2, "a"), ("c", 3, "a - Attempted"), ("c", 4, "b"), ("c", 5, "b - Attempted"), ("c", 6, None)]
    flows = spark.createDataFrame(rows, "capture_file string, flow_id long, label string")
    assert sorted(r.flow_id for r in tn.supported_flows(flows, 2).collect()) == [1, 2, 3]
