"""Operator 4: URL filters as a temporal list join.

A filter list is a log: dated entries that add or remove a host, a domain (with all below
it) or a URL prefix. Entries become validity intervals, from an addition to the next entry
for the same value, and every capture is evaluated against the intervals that were open
when it was fetched. DataFrame functions only.

A capture has a handful of keys: its host, each parent domain and each path prefix no deeper
than the deepest prefix listed. The as-of join is an equality join on the key whose
condition is the interval, so a busy host meets one short list of intervals; its captures can
be split over tasks by the adaptive skew join. Captures with equal URL and time are judged once.

Verdict: the longest matching value wins, an ``allow`` entry over a ``block`` entry of that
length. ``n_active`` counts the open entries that match.

Defined results: a capture with null URL, null time or a URL without a host matches nothing and
keeps verdict ``none``; entries with null value or date are ignored; at one instant a
removal beats an addition; an addition of what is listed already continues it; repeated
rows of captures are all kept, repeated entries count once. Columns of captures named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULTS = ("verdict", "entry", "n_active")


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"\.$", "")


def url_path(url: Column) -> Column:
    """Path without its first slash, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) from (list, kind, value, action, dated)."""
    known = entries.where("value is not null and value != '' and dated is not null").select("list", "kind", "value", "action", "dated").distinct()
    order = Window.partitionBy("list", "kind", "value").orderBy("dated", F.col("action") == "remove")
    return (
        known.withColumn("until", F.lead("dated").over(order)).where(F.col("action") == "add")
        .select("list", "kind", "value", F.col("dated").alias("since"), "until").where("until is null or until > since")
    )


def url_keys(url: Column, deepest: int) -> Column:
    """Array of (kind, value) under which a URL may be listed."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains)
    if deepest:
        steps = F.slice(F.split(url_path(url), "/"), 1, deepest)
        prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value")))
        keys = F.concat(keys, prefixes)
    return F.array_distinct(F.when(host != "", keys))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """All rows and columns of ``captures`` with verdict, entry and n_active."""
    valid = intervals(entries)
    depth = F.size(F.split("value", "/")) - 1
    deepest = valid.where("kind = 'prefix'").agg(F.max(depth)).first()[0] or 0  # one number
    cases = captures.select(F.col(url).alias("url"), F.col(at).alias("at")).where("url is not null and at is not null").distinct()
    keyed = cases.withColumn("key", F.explode(url_keys(F.col("url"), deepest))).select("url", "at", "key.kind", "key.value")
    active = keyed.join(valid, ["kind", "value"]).where((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    best = F.max(F.struct(F.length("value").alias("size"), (F.col("list") == "allow").alias("allow"), F.col("list"), F.concat_ws(":", "kind", "value").alias("entry")))
    judged = active.groupBy("url", "at").agg(best.alias("best"), F.count("*").alias("n_active"))
    judged = judged.select(F.col("url").alias("_url"), F.col("at").alias("_at"), F.col("best.list").alias("verdict"), F.col("best.entry").alias("entry"), "n_active")
    kept = captures.drop(*RESULTS)
    joined = kept.join(judged, (kept[url] == F.col("_url")) & (kept[at] == F.col("_at")), "left")
    return joined.select(*[kept[c] for c in kept.columns], F.coalesce("verdict", F.lit("none")).alias("verdict"), "entry", F.coalesce("n_active", F.lit(0)).alias("n_active"))
