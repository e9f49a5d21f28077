"""Every operator as a query over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataudit.functions.columns import strip_spaces, to_bool
from strataudit.functions.json_text import json_dumps
from strataudit.functions.struct_text import owner, struct_pairs
from strataudit.functions.versions import compare_versions
from strataudit.operators import cache, counts, filters, hierarchy, prompts, reports, requests, reviews, rules, usage
from strataudit.operators.nesting import flat_from_documents, nest
from strataudit.plans.inputs import Inputs
from strataudit.schemas import DOCUMENT
from strataudit.session import work_path, work_table
from strataudit.sources import integrity, preflight, snapshots
from strataudit.sources.buckets import Store
from strataudit.streaming import usage as stream

NOW = dt.datetime(2024, 3, 1)
OVERFLOW_LIMIT = 12_000
OUTLIER_LIMIT = 60
LARGE_STORE_LIMIT = 6
LOGINS = ["FRANCE", "ASIA", "BUILDING"]
SEARCH_TERM = "R#00000012"
RECORD = "Customer#000000121"
TEMPLATE = "Review this record.\n"
DELIVERIES = 4
LATENESS = "5 days"

Query = Callable[[SparkSession, str], DataFrame]
_stores: dict[tuple[str, str], str] = {}


def documents(t: Inputs) -> DataFrame:
    return nest(*t.four)


def _cache_rows(docs: DataFrame, now: dt.datetime) -> DataFrame:
    return cache.split_overflow(cache.with_size(work_table(docs, "documents", compression="zstd")), now, OVERFLOW_LIMIT)


def store(t: Inputs) -> Store:
    """The record documents in a store of the session, loaded once for each folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _stores:
        root = work_path(t.spark, "cache")
        Store(t.spark, root).load(_cache_rows(documents(t), NOW), NOW)
        _stores[key] = root
    return Store(t.spark, _stores[key])


def stored_cache(t: Inputs) -> DataFrame:
    """One narrow row a stored record."""
    return store(t).keys()


def _doc_json(df: DataFrame, *columns: str) -> DataFrame:
    """Documents as JSON text, so that rows compare by value."""
    return df.select("record_id", "part", "n_parts", *columns,
                     F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"))


# Tables and choices

def dataset_preflight(t: Inputs) -> DataFrame:
    places = {n: f"{t.folder}/{n}.parquet" for n in ("orders", "lineitem", "archive")}
    return preflight.dataset_preflight(t.view("dataset_names"), places)


def integrity_report(t: Inputs) -> DataFrame:
    return integrity.integrity_report(*t.four)


def normalise_booleans(t: Inputs) -> DataFrame:
    apps = t.view("apps")
    return apps.select("record_id", "snapshot_date", "processes_sensitive_data",
                       to_bool(F.col("processes_sensitive_data")).alias("processes"),
                       to_bool(F.col("stores_sensitive_data")).alias("stores"))


def struct_text_pairs(t: Inputs) -> DataFrame:
    return struct_pairs(hierarchy.latest_snapshot(t.view("apps")), "record_id", "ownership")


def owner_extract(t: Inputs) -> DataFrame:
    return t.view("apps").select("record_id", "snapshot_date", owner("ownership").alias("owner"))


def filter_records(t: Inputs) -> DataFrame:
    return filters.by_records(t.view("apps"), t.view("lookups").select("record_id"))


def filter_owner_hierarchy(t: Inputs) -> DataFrame:
    return filters.by_owner(t.view("apps"), LOGINS)


def filter_owner_table(t: Inputs) -> DataFrame:
    logins = t.view("apps").filter("stores_sensitive_data = 'yes'").select("reports_to_level_1_login")
    return filters.by_owner(t.view("apps"), logins)


def filter_records_and_owner(t: Inputs) -> DataFrame:
    return filters.by_owner(filter_records(t), LOGINS)


def distinct_record_ids(t: Inputs) -> DataFrame:
    return filters.record_ids(t.view("apps"), LOGINS)


def filter_children(t: Inputs) -> DataFrame:
    return filters.children_of(t.view("objects"), filters.by_owner(t.view("apps"), LOGINS))


def objects_of_store(t: Inputs) -> DataFrame:
    _, _, objects, fields = t.four
    return filters.objects_of_stores(objects, fields, t.view("external"))


# Joins and counts

def hierarchy_left_join(t: Inputs) -> DataFrame:
    return hierarchy.flat_join(*t.four, orphans=False)


def hierarchy_join_with_orphans(t: Inputs) -> DataFrame:
    return hierarchy.flat_join(*t.four)


def owner_extract_join(t: Inputs) -> DataFrame:
    return hierarchy.extract(*t.four, logins=LOGINS)


def records_without_stores(t: Inputs) -> DataFrame:
    apps, stores, objects, _ = t.four
    return hierarchy.bare_records(apps, stores, objects)


def hierarchy_row_counts(t: Inputs) -> DataFrame:
    return hierarchy.row_counts(hierarchy.flat_join(*t.four))


def latest_snapshot(t: Inputs) -> DataFrame:
    return hierarchy.latest_snapshot(t.view("apps"))


def object_counts(t: Inputs) -> DataFrame:
    return counts.object_counts(t.view("objects"))


def outlier_records(t: Inputs) -> DataFrame:
    return counts.outlier_records(t.view("objects"), OUTLIER_LIMIT)


def large_stores(t: Inputs) -> DataFrame:
    return counts.large_stores(t.view("objects"), LARGE_STORE_LIMIT)


def extraction_summary(t: Inputs) -> DataFrame:
    return counts.extraction_summary(hierarchy.flat_join(*t.four), t.four[2])


# Documents and their snapshot

def nest_records(t: Inputs) -> DataFrame:
    return _doc_json(documents(t), "reviewer_group")


def nest_large_records(t: Inputs) -> DataFrame:
    """The same documents in parts of about 20 leaves, unfolded: the leaves must not depend on the parts."""
    return flat_from_documents(nest(*t.four, part_leaves=20)).filter("object_id IS NOT NULL").select(
        "record_id", "store_id", "object_id", "field_name").distinct()


def record_sizes(t: Inputs) -> DataFrame:
    return cache.record_bytes(documents(t))


def record_sizes_in_parts(t: Inputs) -> DataFrame:
    return cache.record_bytes(nest(*t.four, part_leaves=20))


def overflow_split(t: Inputs) -> DataFrame:
    return cache.split_overflow(cache.record_bytes(documents(t)), NOW, OVERFLOW_LIMIT).drop("last_updated")


def dry_run_report(t: Inputs) -> DataFrame:
    return cache.size_report(cache.record_bytes(documents(t)), OVERFLOW_LIMIT)


def _load_of(t: Inputs, chosen: DataFrame, now: dt.datetime) -> DataFrame:
    """Cache rows of some application rows."""
    _, stores, objects, fields = t.four
    children = filters.children_by_key(stores, chosen), filters.children_of(objects, chosen), filters.children_of(fields, chosen)
    return _cache_rows(nest(chosen, *children), now)


def _stored_rows(rows: Store) -> DataFrame:
    return rows.documents().select("record_id", "doc.description", "bytes", "is_overflow",
                                   F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


def cache_upsert(t: Inputs) -> DataFrame:
    """First load: the first snapshots. Second load: the records that have a second one."""
    apps, later = t.view("apps"), NOW + dt.timedelta(days=1)
    held = Store(t.spark, work_path(t.spark, "upsert"))
    held.load(_load_of(t, apps.filter("snapshot_date = '2024-01-01'"), NOW), NOW)
    held.load(_load_of(t, apps.filter("snapshot_date = '2024-01-02'"), later), later)
    return _stored_rows(held)


def cache_loads_at_once(t: Inputs) -> DataFrame:
    """After a first load two more at once: the second snapshots, and half a day older, records loaded again. Neither sees the other."""
    apps, later, between = t.view("apps"), NOW + dt.timedelta(days=1), NOW + dt.timedelta(hours=12)
    first = apps.filter("snapshot_date = '2024-01-01'")
    held = Store(t.spark, work_path(t.spark, "at-once"))
    held.load(_load_of(t, first, NOW), NOW)
    newer = held.prepare(_load_of(t, apps.filter("snapshot_date = '2024-01-02'"), later), later)
    older = held.prepare(_load_of(t, first.filter("stores_sensitive_data = 'yes'"), between), between)
    held.commit(newer)
    held.commit(older)
    return _stored_rows(held)


def lookup_exact(t: Inputs) -> DataFrame:
    return _doc_json(store(t).lookup(t.view("lookups").filter("NOT is_partial").select("record_id")))


def lookup_single(t: Inputs) -> DataFrame:
    return _doc_json(store(t).lookup([RECORD]))


def lookup_partial(t: Inputs) -> DataFrame:
    return _doc_json(store(t).search(SEARCH_TERM))


def lookup_terms(t: Inputs) -> DataFrame:
    """The records that each asked piece of an id finds."""
    return store(t).search_many(t.view("lookups").filter("is_partial").select(strip_spaces(F.col("record_id"))))


def overflow_read(t: Inputs) -> DataFrame:
    """All documents through one view, those kept apart included."""
    return _doc_json(store(t).documents(), "is_overflow")


def overflow_json_read(t: Inputs) -> DataFrame:
    """All documents, written as JSON text and read again."""
    bodies = store(t).documents().withColumn("body", json_dumps("doc", DOCUMENT)).drop("doc")
    return _doc_json(snapshots.read_json_documents(bodies), "is_overflow", "error")


def stats_count(t: Inputs) -> DataFrame:
    return cache.statistics("count", stored_cache(t))


def stats_list(t: Inputs) -> DataFrame:
    return cache.statistics("list", stored_cache(t))


def stats_cache(t: Inputs) -> DataFrame:
    return cache.statistics("cache-stats", stored_cache(t))


# Requests and usage

def request_outcomes(t: Inputs) -> DataFrame:
    return requests.outcomes(t.view("lookups"), stored_cache(t), store(t).grams()).select("event_id", "record_id", "is_partial", "status")


def _hits(t: Inputs) -> DataFrame:
    return requests.usage_hits(requests.exact_outcomes(t.view("lookups"), stored_cache(t)))


def _used(t: Inputs, rows: DataFrame) -> DataFrame:
    """Grouped rows of the records that exist."""
    return requests.of_known(rows, stored_cache(t))


def _counters(t: Inputs) -> DataFrame:
    return usage.of_groups(_used(t, usage.counters(requests.eligible(t.view("lookups")))))


def usage_counters(t: Inputs) -> DataFrame:
    return _counters(t)


def _deliveries(t: Inputs) -> DataFrame:
    """Request events with the number of the delivery that brings them: by time, but some come one later and some in the last."""
    events = t.spark.read.parquet(f"{t.folder}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(at).alias("a"), F.max(at).alias("z"))
    share = F.expr(f"(({DELIVERIES} * (unix_micros(CAST(ts AS timestamp)) - a)) DIV (z - a + 1))").cast("int")
    late = F.when(F.col("event_id") % 13 == 0, F.lit(DELIVERIES - 1)).when(F.col("event_id") % 11 == 0, share + 1).otherwise(share)
    return events.join(span).select(*events.columns, F.least(late, F.lit(DELIVERIES - 1)).alias("delivery"))  # one row beside all


def _streamed(t: Inputs, changes: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Deliveries of request files as a stream that is started anew for each, from its checkpoint; older batches are compacted."""
    root = work_path(t.spark, "usage")
    events = work_table(_deliveries(t), "deliveries")
    files = events.drop("delivery")
    for k in range(DELIVERIES):
        events.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{root}/files")
        source = stream.read_requests(t.spark, f"{root}/files", files.schema)
        stream.start_updates(changes(requests.eligible(t.stream_view("lookups", source))), f"{root}/table", f"{root}/checkpoint",
                             finish=finish).awaitTermination()
        if k == 1:
            stream.compact(t.spark, f"{root}/table", keys)
    return stream.latest_rows(t.spark, f"{root}/table", keys)


def usage_counters_stream(t: Inputs) -> DataFrame:
    """The same counters from a stream in several deliveries. State holds the hits by id; a batch's changed rows meet the records."""
    return _streamed(t, usage.counters, lambda rows: usage.of_groups(_used(t, rows)), ["record_id"])


def usage_daily_stream(t: Inputs) -> DataFrame:
    """Hits per day from the stream. Late hits count while their day is not closed; those that come later are left out."""
    timed = lambda hits: hits.withColumn("ts", F.col("ts").cast("timestamp"))
    days = _streamed(t, lambda hits: usage.daily(timed(hits), LATENESS), lambda rows: _used(t, rows).drop("reviewer_group"), ["record_id", "day"])
    return days.withColumn("day", F.col("day").cast("timestamp_ntz"))


def usage_reviewers(t: Inputs) -> DataFrame:
    sets = usage.reviewer_sets(_hits(t))
    return sets.select("record_id", "part", "n_parts", F.array_join("reviewers", ",").alias("reviewers"))


def usage_reviewer_hits(t: Inputs) -> DataFrame:
    return _used(t, usage.reviewer_hits(requests.eligible(t.view("lookups")))).drop("reviewer_group")


def usage_daily(t: Inputs) -> DataFrame:
    return _used(t, usage.daily(requests.eligible(t.view("lookups")))).drop("reviewer_group")


def usage_ranking(t: Inputs) -> DataFrame:
    return usage.most_used(_counters(t).select("record_id", "hit_count"))


def never_reviewed(t: Inputs) -> DataFrame:
    return usage.never_reviewed(stored_cache(t), _hits(t))


def stats_usage(t: Inputs) -> DataFrame:
    return cache.statistics("usage", stored_cache(t), _counters(t))


def stats_reviewer_groups(t: Inputs) -> DataFrame:
    return cache.statistics("reviewer-groups", stored_cache(t), _counters(t))


def version_lookup(t: Inputs) -> DataFrame:
    return requests.version_lookup(t.view("version_requests"), t.view("versions"))


def client_version_status(t: Inputs) -> DataFrame:
    return requests.client_status(t.view("clients"), t.view("versions"))


def version_compare(t: Inputs) -> DataFrame:
    return t.view("clients").select("client_id", "local_version",
                                    compare_versions("local_version", "'1.9.0'").alias("order"))


# Reviews

def report_names(t: Inputs) -> DataFrame:
    return reports.report_names(t.view("new_reports"), t.view("old_reports"))


def review_prompts(t: Inputs) -> DataFrame:
    return prompts.prompts(documents(t), TEMPLATE, t.view("prior"), checklist_only=True)


def review_prompts_in_pieces(t: Inputs) -> DataFrame:
    """The pieces of all prompts, of records in many parts; brought together here only to be compared."""
    docs = work_table(nest(*t.four, part_leaves=20), "documents", compression="zstd")
    pieces = prompts.prompt_pieces(docs, TEMPLATE, t.view("prior"), checklist_only=True)
    together = pieces.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("texts"))
    return together.select("record_id", F.array_join("texts.text", "").alias("prompt"))


def gate_sections(t: Inputs) -> DataFrame:
    return reviews.gate_sections(t.view("reviews"))


def gate_tables(t: Inputs) -> DataFrame:
    return reviews.gate_tables(t.view("reviews"))


def action_items(t: Inputs) -> DataFrame:
    return reviews.items(t.view("reviews"), ("action",)).drop("kind")


def checklist_items(t: Inputs) -> DataFrame:
    return reviews.items(t.view("reviews"), ("checklist",)).drop("kind")


def findings_summary(t: Inputs) -> DataFrame:
    return reviews.gate_summary(reviews.gate_findings(t.view("reviews")))


def findings_filtered(t: Inputs) -> DataFrame:
    return reviews.gate_summary(reviews.gate_findings(t.view("reviews"), gate=3, table="USERS"))


def findings_per_review(t: Inputs) -> DataFrame:
    found = reviews.findings(t.view("reviews"))
    items = F.expr("array_join(transform(action_items, it -> concat_ws('|', it.severity, it.description, it.table)), '; ')")
    return found.select("review_id", "record_id", "version", "error", "total_findings",
                        F.array_join(F.array_sort("affected_tables"), "; ").alias("affected_tables"), items.alias("action_items"))


def review_delta(t: Inputs) -> DataFrame:
    found = reviews.items(t.view("reviews"))
    return reviews.delta(found.filter("version = 2"), found.filter("version = 1"))


def gate_rule_checks(t: Inputs) -> DataFrame:
    return rules.gate_checks(*t.four)


def external_crossref(t: Inputs) -> DataFrame:
    return rules.crossref(t.view("stores"), t.view("external"))


ALL: list[Callable[[Inputs], DataFrame]] = [
    hierarchy_join_with_orphans, hierarchy_left_join, latest_snapshot, records_without_stores, hierarchy_row_counts,
    owner_extract_join, filter_records, filter_owner_hierarchy, filter_owner_table, filter_records_and_owner,
    distinct_record_ids, filter_children, objects_of_store, object_counts, outlier_records, large_stores,
    extraction_summary, nest_records, nest_large_records, normalise_booleans, struct_text_pairs, owner_extract,
    record_sizes, record_sizes_in_parts, overflow_split, dry_run_report, cache_upsert, cache_loads_at_once, lookup_exact, lookup_single,
    lookup_partial, lookup_terms, overflow_read, overflow_json_read, stats_count, stats_list, stats_cache, stats_usage, stats_reviewer_groups, request_outcomes,
    usage_counters, usage_counters_stream, usage_daily_stream, usage_reviewers, usage_reviewer_hits, usage_daily, usage_ranking,
    never_reviewed, version_lookup, version_compare, client_version_status, report_names, review_prompts, review_prompts_in_pieces,
    gate_sections, gate_tables, action_items, checklist_items, findings_summary, findings_filtered, findings_per_review,
    review_delta, gate_rule_checks, external_crossref, integrity_report, dataset_preflight,
]


def queries() -> dict[str, Query]:
    def over(build: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, folder: build(Inputs(spark, folder))

    return {build.__name__: over(build) for build in ALL}
