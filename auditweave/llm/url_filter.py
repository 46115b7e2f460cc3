"""URL filtering by a temporal list join.

A list is given as dated changes: an entry was put on or taken off on a day. Changes become
validity intervals, and every capture is judged by the entries that were active on the day it was
fetched, not by today's list.

As-of join. A URL is looked up by its host, the host's parent domains and its path prefixes.
Intervals are entered under every month they touch, so the join is an equality on (pattern,
month) and a comparison with the few intervals of that month; a host with a third of all captures
is spread over months, and each (pattern, day) is looked up once however many captures share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def validity(changes: DataFrame) -> DataFrame:
    """``kind, pattern, list, valid_from, valid_to`` from ``kind, pattern, list, changed_on, listed``.

    kind is ``host``, ``domain`` (the host itself and all below it) or ``prefix`` (host and path up to a
    ``/``); valid_to is the day of removal, not included, or NULL. Of several changes on a day an
    addition counts. A removal without an addition before, and a second addition, change nothing.
    Rows with a NULL in any of the five columns are left out.
    """
    key = ["kind", "pattern", "list"]
    daily = changes.select(*key, F.col("changed_on").cast("date").alias("day"), "listed").dropna()
    # At most one row per day and entry, so the window holds no more rows than the calendar has days.
    daily = daily.groupBy(*key, "day").agg(F.max("listed").alias("listed"))
    in_time = Window.partitionBy(*key).orderBy("day")
    turns = daily.withColumn("before", F.coalesce(F.lag("listed").over(in_time), F.lit(False))).where("listed <> before")
    return (
        turns.withColumn("valid_to", F.lead("day").over(in_time)).where("listed")
        .select(*key, F.col("day").alias("valid_from"), "valid_to")
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _lookups(captures: DataFrame, depth: int) -> DataFrame:
    """One row per capture and pattern that could name it."""
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    steps = F.split(F.regexp_extract("url", _PATH, 1), "/")
    upto = F.least(F.size(steps) - 1, F.lit(depth))
    prefixes = F.when(upto > 0, F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")).alias("pattern"))))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")))
    every = F.concat(own, domains, F.coalesce(prefixes, F.slice(own, 1, 0)))
    return captures.where("host <> '' AND fetched_on IS NOT NULL").withColumn("l", F.explode(every)).select("*", "l.kind", "l.pattern").drop("l")


def filter_captures(captures: DataFrame, changes: DataFrame, allow_list: str = "allow") -> DataFrame:
    """``capture_id, url, fetched_on, host, n_active, n_blocking, first_list, kept`` per distinct capture.

    ``captures``: capture_id, url, fetched_on; more columns are ignored. ``changes``: see
    :func:`validity`. Dropped (kept = false) is a capture that an active entry names on any list but
    ``allow_list``, unless an active entry of that list names it. first_list: the smallest list name.

    NULL, empty or malformed URL, or NULL fetch day: named by nothing and kept, host NULL where there is
    none. Captures equal in all three columns are judged once. Empty tables: no row, or no entry.
    """
    key = ["capture_id", "url", "fetched_on"]
    intervals = validity(changes)
    depth = intervals.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    captures = captures.select("capture_id", "url", F.col("fetched_on").cast("date").alias("fetched_on")).distinct()
    captures = captures.withColumn("host", host_of(F.col("url")))
    lookups = _lookups(captures, depth)
    asked = lookups.select("kind", "pattern", "fetched_on").distinct().withColumn("month", _month(F.col("fetched_on")))
    # An open interval is entered up to the last month in which anything was fetched.
    last = captures.agg(F.max("fetched_on")).first()[0]
    until = F.coalesce(F.date_sub("valid_to", 1), F.greatest(F.col("valid_from"), F.lit(last).cast("date")))
    monthly = intervals.withColumn("month", F.explode(F.sequence(_month(F.col("valid_from")), _month(until))))
    active = (
        asked.join(monthly, ["kind", "pattern", "month"])
        .where("fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)")
        .select("kind", "pattern", "fetched_on", "list")
    )
    named = lookups.join(active, ["kind", "pattern", "fetched_on"]).groupBy(*key).agg(
        F.count("*").alias("n_active"), F.count_if(F.col("list") != allow_list).alias("n_blocking"), F.min("list").alias("first_list"))
    named = named.select(*(F.col(c).alias(f"__{c}") for c in key), "n_active", "n_blocking", "first_list")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    zero = F.lit(0).cast("bigint")
    return captures.join(named, same, "left").select(
        *key, F.when(F.col("host") != "", F.col("host")).alias("host"),
        F.coalesce("n_active", zero).alias("n_active"), F.coalesce("n_blocking", zero).alias("n_blocking"), "first_list",
        ((F.coalesce("n_blocking", zero) == 0) | (F.col("n_active") > F.col("n_blocking"))).alias("kept"))
