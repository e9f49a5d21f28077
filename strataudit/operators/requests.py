"""Outcomes of lookup and version requests, and the state of client versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataudit.functions.columns import is_empty, strip_spaces
from strataudit.functions.versions import compare_versions
from strataudit.operators.cache import terms_found

# The sources that must send their version.
VERSIONED_SOURCES = ("cli", "mcp")


def _status(found: Column, gated: Column) -> Column:
    unversioned = F.col("x_source").isin(*VERSIONED_SOURCES) & is_empty(F.col("x_tool_version"))
    return (F.when(F.col("key") == "", 400).when(gated & F.coalesce(unversioned, F.lit(False)), 426)
            .when(found.isNull(), 404).otherwise(200))


def _keyed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("key", F.coalesce(strip_spaces(F.col("record_id")), F.lit("")))


def exact_outcomes(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Status of exact lookups, with the reviewer group of the record; requests may be a stream."""
    records = cache.filter("part = 0").select(
        F.col("record_id").alias("key"), F.lit(True).alias("found"),
        F.col("reviewer_group").alias("legal_reviewer_group"))
    joined = _keyed(requests).filter("NOT coalesce(is_partial, false)").join(records, "key", "left")
    return joined.withColumn("status", _status(F.col("found"), F.lit(True))).drop("key", "found")


def partial_outcomes(requests: DataFrame, cache: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Status of partial lookups: found if any record id contains the term. ``grams`` is the index of the ids if there is one."""
    asked = _keyed(requests).filter("is_partial").withColumn("piece", F.lower("key"))
    found = terms_found(asked.select("piece"), cache, grams).withColumn("found", F.lit(True))
    joined = asked.join(found, "piece", "left")
    return joined.withColumns({
        "status": _status(F.col("found"), F.lit(False)), "legal_reviewer_group": F.lit(None).cast("string"),
    }).drop("key", "piece", "found")


def outcomes(requests: DataFrame, cache: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Each request with its status: 400 without id, 426 without version, 404 unknown, else 200."""
    return exact_outcomes(requests, cache).unionByName(partial_outcomes(requests, cache, grams))


def eligible(requests: DataFrame) -> DataFrame:
    """Exact lookups that count as usage if their record exists, under the id without padding; requests may be a stream.

    Grouping these and asking for the records afterwards (``of_known``) joins one row a group, however often a record is asked for.
    """
    asked = _keyed(requests).filter("NOT coalesce(is_partial, false)")
    return asked.filter(_status(F.lit(True), F.lit(True)) == 200).withColumn("record_id", F.col("key")).drop("key")


def of_known(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows whose record exists, with its ``reviewer_group``."""
    return rows.join(cache.filter("part = 0").select("record_id", "reviewer_group"), "record_id")


def usage_hits(outcome: DataFrame) -> DataFrame:
    """The requests that count as usage: exact lookups of a record that was found, under its id without padding."""
    return outcome.filter("status = 200 AND NOT coalesce(is_partial, false)").withColumn("record_id", strip_spaces(F.col("record_id")))


def version_lookup(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Status and versions for each asked tool name."""
    keyed = requests.withColumn("tool_name", F.coalesce(strip_spaces(F.col("tool_name")), F.lit("")))
    known = versions.select("tool_name", "latest_version", "minimum_required_version", F.lit(True).alias("found"))
    answer = lambda c: F.when(F.col("found"), F.coalesce(c, F.lit(""))).alias(c)
    return keyed.join(known, "tool_name", "left").select(
        *requests.columns,
        F.when(F.col("tool_name") == "", 400).when(F.col("found").isNull(), 404).otherwise(200).alias("status"),
        answer("latest_version"), answer("minimum_required_version"))


def client_status(clients: DataFrame, versions: DataFrame) -> DataFrame:
    """blocked, update_available, up_to_date or error for each client."""
    latest, minimum = F.col("latest_version"), F.col("minimum_required_version")
    joined = clients.join(versions, "tool_name", "left")
    return joined.select(
        *clients.columns, latest, minimum,
        F.when(is_empty(latest) | is_empty(minimum), "error")
        .when(compare_versions("local_version", "minimum_required_version") < 0, "blocked")
        .when(compare_versions("local_version", "latest_version") < 0, "update_available")
        .otherwise("up_to_date").alias("status"))
