"""Attack rules and audit claims from JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.classes import rule_day, weekday_date
from packetloom.functions.packets import est_clock_to_micros, utc_clock_to_micros
from packetloom.operators.reports import CLAIM_SCHEMA

RULES_SCHEMA = """
attacks array<struct<day string, label string, start_time string, end_time string, attacker_ips array<string>,
 victim_ips array<string>, victim_ports array<int>, known_issues string>>,
days_excluded map<string, string>
"""


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=RULES_SCHEMA, multiLine=True)


def attack_rules(profiles: DataFrame, clock: str = "est") -> DataFrame:
    """Rules in document order with absolute windows. ``clock``: ``est`` for HH:MM at
    UTC−5 on dated day names, ``utc`` for HH:MM:SS on weekday names."""
    rows = profiles.select(F.posexplode("attacks").alias("rule_pos", "a")).select("rule_pos", "a.*")
    if clock == "est":
        moment = lambda c: est_clock_to_micros("day", c)
    elif clock == "utc":
        moment = lambda c: utc_clock_to_micros(weekday_date("day"), c)
    else:
        raise ValueError(f"unknown clock {clock!r}")
    return rows.select(
        "rule_pos", "day", "label", "attacker_ips", "victim_ips", "victim_ports",
        moment("start_time").alias("start_us"), moment("end_time").alias("end_us"), "known_issues",
    )


def rules_of_day(rules: DataFrame, day: str) -> DataFrame:
    return rules.where(F.col("day") == rule_day(F.lit(day)))


def known_issues(profiles: DataFrame, day: str) -> DataFrame:
    """Why a day is excluded and what is known about its attacks, in that order."""
    name = rule_day(F.lit(day))
    excluded = profiles.select(F.lit(-1).alias("position"), F.try_element_at("days_excluded", name).alias("issue"))
    attacks = profiles.select(F.posexplode("attacks").alias("position", "a")).where(F.col("a.day") == name).select(
        "position", (F.concat(F.col("a.label"), F.lit(": "), F.nullif(F.col("a.known_issues"), F.lit("")))).alias("issue")
    )
    return excluded.unionByName(attacks).where(F.col("issue").isNotNull()).orderBy("position")


# Ten flood sources of one day.
FLOOD_SOURCES = (
    "18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135",
    "18.219.5.43", "18.216.200.189", "18.218.229.235", "18.218.11.51", "18.216.24.42",
)

# Claims about the captures, (category, day, label, kind, address, port,
# window start, window end, minimum total, maximum count).
REMOVED = "removed_attack"
FRIDAY, WEDNESDAY = "Friday-16-02-2018", "Wednesday-21-02-2018"
LATER_WEDNESDAY, THURSDAY = "Wednesday-28-02-2018", "Thursday-01-03-2018"
CLAIMS = [
    (REMOVED, FRIDAY, "DoS attacks-SlowHTTPTest", "port_exclusive", "13.59.126.31", 21, None, None, 100_000, None),
    *[(REMOVED, WEDNESDAY, "DDOS attack-LOIC-UDP+HOIC", "absent", ip, None, None, None, None, None) for ip in FLOOD_SOURCES],
    (REMOVED, WEDNESDAY, "HOIC victim window", "absent_in_window", "172.31.69.25", None, "18:11", "19:05", None, None),
    (REMOVED, WEDNESDAY, "LOIC-UDP victim window", "bounded_in_window", "172.31.69.25", None, "14:08", "14:43", None, 5_000),
    (REMOVED, LATER_WEDNESDAY, "Infilteration", "external_zero", "172.31.69.24", None, None, None, 10_000, None),
    (REMOVED, LATER_WEDNESDAY, "Infilteration C2", "absent", "13.58.225.34", None, None, None, None, None),
    (REMOVED, THURSDAY, "Infilteration", "absent", "172.31.69.24", None, None, None, None, None),
    (REMOVED, THURSDAY, "Infilteration C2", "absent", "13.58.225.34", None, None, None, None, None),
]


def claims_table(spark: SparkSession, claims=CLAIMS) -> DataFrame:
    """Claims with their windows as epoch microseconds."""
    rows = [(i, *c) for i, c in enumerate(claims)]
    raw = spark.createDataFrame(
        rows, "claim_id int, category string, day string, label string, kind string, ip string, port int, "
        "start_clock string, end_clock string, min_total long, max_count long",
    )
    names = [part.strip().split(" ")[0] for part in CLAIM_SCHEMA.split(",")]
    return raw.withColumns({
        "start_us": est_clock_to_micros("day", "start_clock"), "end_us": est_clock_to_micros("day", "end_clock"),
    }).select(*names)
