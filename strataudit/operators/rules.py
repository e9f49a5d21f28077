"""Checks of the review gates that the tables alone can answer, and the comparison with outside scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataudit.functions.columns import is_blank, to_bool
from strataudit.functions.spread import distinct_keys, lacking
from strataudit.operators.hierarchy import (
    latest_snapshot, unique_fields, unique_objects, unique_stores, with_orphan_store,
)
from strataudit.schemas import ORPHAN_STORE

# Fixed value: parts of field names that suggest sensitive data.
SENSITIVE_WORDS = ("email", "phone", "address", "ssn", "birth", "passport")


def _violations(df: DataFrame, rules: dict[tuple[int, str, str], Column], *where: str) -> DataFrame:
    """Rows that break a rule (gate, name, severity). All rules over one table are tested in one pass."""
    broken = [F.when(test, F.struct(F.lit(g).alias("gate"), F.lit(n).alias("rule"), F.lit(v).alias("severity")))
              for (g, n, v), test in rules.items()]
    place = [F.col(c) if c in where else F.lit(None).cast("string").alias(c) for c in ("store_id", "object_id", "field_name")]
    return df.select("record_id", F.inline(F.array_compact(F.array(*broken))), *place)


def gate_checks(
    apps: DataFrame, stores: DataFrame, objects: DataFrame, fields: DataFrame,
    words: tuple[str, ...] = SENSITIVE_WORDS,
) -> DataFrame:
    """One row (record_id, gate, rule, severity, store_id, object_id, field_name) per violation.

    Works on the flat tables, so that a store or record of any size is checked in many tasks.
    """
    app = latest_snapshot(apps.filter("record_id <> ''"))
    store = unique_stores(stores.filter("store_id <> ''")).filter(F.col("store_id") != ORPHAN_STORE).select(
        F.col("application_name").alias("record_id"), "store_id", to_bool(F.col("has_sensitive_data")).alias("store_flag"))
    keyed = with_orphan_store(objects.filter("object_id <> ''"))
    obj = unique_objects(keyed).select(
        F.col("application_name").alias("record_id"), F.col("data_store_id").alias("store_id"), "object_id",
        to_bool(F.col("has_sensitive_data")).alias("object_flag"), "retention_days")
    named = fields.filter("field_name <> ''")

    known = distinct_keys(app, record_id="record_id")
    store = store.join(known, "record_id")
    in_orphan = F.col("store_id") == ORPHAN_STORE
    lost = obj.filter(in_orphan).join(known, "record_id").withColumn("store_flag", F.lit(False))
    placed = obj.filter(~in_orphan).join(store, ["record_id", "store_id"]).unionByName(lost)

    days = F.regexp_extract(F.trim("retention_days"), r"\A\+?(\d+)\z", 1).try_cast("decimal(38,0)")
    no_days = is_blank(F.col("retention_days"))
    suspicious: Column = F.lower("field_name").rlike("|".join(words))
    hints = unique_fields(named).filter(suspicious).select(
        F.col("application_name").alias("record_id"), "object_id", "field_name")
    hinted = hints.join(placed, ["record_id", "object_id"])

    whole = F.lit(True)
    no_objects = lacking(store, distinct_keys(keyed, record_id="application_name", store_id="data_store_id"))
    no_fields = lacking(placed, distinct_keys(named, record_id="application_name", object_id="object_id"))
    unset = is_blank(F.col("processes_sensitive_data")) | is_blank(F.col("stores_sensitive_data"))
    checks = [
        _violations(app, {(1, "missing_description", "HIGH"): is_blank(F.col("app_description")),
                          (1, "flags_not_set", "MEDIUM"): unset}),
        _violations(no_objects, {(1, "store_without_objects", "MEDIUM"): whole}, "store_id"),
        _violations(no_fields, {(1, "object_without_fields", "LOW"): whole}, "store_id", "object_id"),
        _violations(placed, {(1, "missing_retention", "HIGH"): F.col("store_flag") & no_days,
                             (4, "unreasonable_retention", "MEDIUM"): ~no_days & F.coalesce(days <= 0, F.lit(True)),
                             (4, "sensitive_without_retention", "HIGH"): F.col("object_flag") & no_days},
                    "store_id", "object_id"),
        _violations(hinted, {(3, "unflagged_object", "HIGH"): ~F.col("object_flag"),
                             (3, "unflagged_store", "HIGH"): ~F.col("store_flag") & ~in_orphan},
                    "store_id", "object_id", "field_name"),
    ]
    return reduce(DataFrame.unionByName, checks)


def crossref(stores: DataFrame, external: DataFrame) -> DataFrame:
    """External findings (application_name, store_id, detected_sensitive) against the attested stores.

    missing_store: seen outside, not attested. contradicted: the two disagree on sensitive data.
    """
    attested = unique_stores(stores).select(
        "application_name", "store_id", to_bool(F.col("has_sensitive_data")).alias("attested_sensitive"),
        F.lit(True).alias("found"))
    seen = external.groupBy("application_name", "store_id").agg(F.max("detected_sensitive").alias("detected_sensitive"))
    both = seen.join(attested, ["application_name", "store_id"], "left")
    issue = (F.when(F.col("found").isNull(), "missing_store")
             .when(F.col("detected_sensitive") != F.col("attested_sensitive"), "contradicted"))
    return both.withColumn("issue", issue).filter("issue IS NOT NULL").select(
        "application_name", "store_id", "issue", "detected_sensitive", "attested_sensitive")
