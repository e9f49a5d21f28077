"""Usage of records. The aggregates are the same for a batch of hits and for a stream of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataudit.functions.columns import is_blank, is_empty
from strataudit.functions.spread import collect_in_parts, distinct_keys, lacking

UNKNOWN_GROUP = "Unknown"


def _newest(value: Column, given: Column | None = None) -> Column:
    order = F.struct("ts", "event_id")
    return F.max_by(value, order if given is None else F.when(given, order))


def counters(hits: DataFrame) -> DataFrame:
    """Hits, last hit, last named reviewer and, where hits carry one, last reviewer group per record."""
    named = ~is_empty(F.col("reviewer"))
    group = [_newest(F.col("legal_reviewer_group")).alias("legal_reviewer_group")] if "legal_reviewer_group" in hits.columns else []
    return hits.groupBy("record_id").agg(
        F.count("*").alias("hit_count"), F.max("ts").alias("last_hit"), *group, _newest(F.col("reviewer"), named).alias("last_reviewer"))


def of_groups(counted: DataFrame) -> DataFrame:
    """Counters that carry the record's ``reviewer_group`` under the name that a hit has it."""
    return counted.select("record_id", "hit_count", "last_hit", F.col("reviewer_group").alias("legal_reviewer_group"), "last_reviewer")


def reviewer_hits(hits: DataFrame) -> DataFrame:
    """Who looked at which record, how often and when last: the reviewer set in rows."""
    return hits.filter(~is_empty(F.col("reviewer"))).groupBy("record_id", "reviewer").agg(
        F.count("*").alias("hit_count"), F.max("ts").alias("last_hit"))


def reviewer_sets(hits: DataFrame, limit: int = 10_000) -> DataFrame:
    """The reviewer set of each record as a sorted array, in parts above ``limit`` reviewers."""
    return collect_in_parts(hits.filter(~is_empty(F.col("reviewer"))), ["record_id"], "reviewer", "reviewers", limit)


def daily(hits: DataFrame, delay: str | None = None) -> DataFrame:
    """Hits per record and day. A stream needs ``delay``, the time to wait for late hits."""
    timed = hits.withWatermark("ts", delay) if delay else hits
    counted = timed.groupBy("record_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("hit_count"))
    return counted.select("record_id", F.col("w.start").alias("day"), "hit_count")


def never_reviewed(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Cached records without any hit."""
    records = cache.filter("part = 0").select("record_id")
    return lacking(records, distinct_keys(hits, record_id="record_id"))


def most_used(usage: DataFrame) -> DataFrame:
    return usage.orderBy(F.desc("hit_count"), "record_id")


def reviewer_groups(usage: DataFrame) -> DataFrame:
    """Records and lookups per reviewer group, most lookups first; blank groups are Unknown."""
    group = F.col("legal_reviewer_group")
    return usage.groupBy(F.when(is_blank(group), UNKNOWN_GROUP).otherwise(group).alias("reviewer_group")).agg(
        F.count("*").alias("unique_apps"), F.sum(F.coalesce("hit_count", F.lit(0))).alias("total_lookups"),
    ).orderBy(F.desc("total_lookups"), "reviewer_group")
