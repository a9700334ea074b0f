"""Registered queries against their SQL twins on the smallest given tables."""

import math
from collections import Counter

import duckdb
import pytest

from packetloom.catalog.oracles import ORACLES
from packetloom.catalog.queries import QUERIES
from packetloom.catalog.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "packet_fields_unified", "flow_grouping", "cross_capture_dedup", "cut_grid", "flow_features_full", "label_rules_narrowest",
    "label_nearest", "fuzzy_apply", "claim_audit", "exclusion_by_length", "within_day_split", "mask_strict", "store_summary", "byte_extraction", "tensor_pack",
    "per_class_metrics", "window_table", "registry_cuts",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(float(v)) else float(v)
    return str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    sql = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == sql
